"""Product analytics over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import product
from lattica.session import table

#: Event kinds of the test table as actions (fixed values).
ACTIONS = {"view": "view", "click": "edit", "purchase": "create", "signup": "login", "error": "delete"}


def actions(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id"), kinds[F.col("event_type")].alias("action"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"), F.col("value"))


_CASE = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 5 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 0 END"

def _searches(spark, d):
    c = table(spark, d, "conversations")
    return c.where("role = 'user'").select(product.normalized_query("text").alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), (F.length("text") % 7 % 3).alias("results"), F.length("text").cast("double").alias("latency"))


def _clicks(spark, d):
    c = table(spark, d, "conversations")
    return c.where("role = 'assistant'").select(product.normalized_query("text").alias("query"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))


def _content(spark, d):
    age = (F.col("doc_id") % 700).cast("double")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 13).alias("links"), (F.col("doc_id") % 6).alias("fields"), (F.col("doc_id") % 4).alias("tags"), age.alias("age"))
    return docs.withColumn("score", product.quality_score("n_chars", "links", "fields", F.col("age"), "tags"))


_ACT = "(SELECT user_id, event_id, value, ts, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'create' WHEN 'signup' THEN 'login' WHEN 'error' THEN 'delete' END AS action FROM events)"
_NQ = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_SQ = f"(SELECT {_NQ} AS query, conv_id * 1000 + turn AS ord, length(text) % 7 % 3 AS results, CAST(length(text) AS DOUBLE) AS latency FROM conversations WHERE role = 'user')"
_CK = f"(SELECT {_NQ} AS query, conv_id * 1000 + turn AS ord FROM conversations WHERE role = 'assistant')"
_SC = "(SELECT doc_id, floor((least(30.0, n_chars / 2000 * 30) + least(25.0, (doc_id % 13) / 10 * 25) + least(20.0, (doc_id % 6) / 5 * 20) + greatest(0.0, 15 * (1 - (doc_id % 700) / 365)) + least(10.0, (doc_id % 4) / 5 * 10)) * 10 + 0.5) / 10 AS score FROM documents)"

QUERIES = {
    "user_engagement": (
        lambda spark, d: product.engagement(actions(spark, d), limit=10),
        f"""SELECT user_id, CAST(sum({_CASE}) AS BIGINT) AS score, count(*) AS actions,
            count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS creates
            FROM events GROUP BY user_id ORDER BY score DESC, user_id LIMIT 10""",
    ),
    "users_active_series": (lambda s, d: product.active_series(actions(s, d)), "WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), x AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS day FROM p) SELECT day, count(DISTINCT user_id) FILTER (d = day) AS dau, count(DISTINCT user_id) FILTER (d > day - 7) AS wau, count(DISTINCT user_id) AS mau FROM x JOIN p ON d <= day AND d > day - 30 GROUP BY day"),
    "users_active_day": (lambda s, d: product.active_users(actions(s, d), "2024-01-20", 7), "SELECT count(DISTINCT user_id) AS users FROM events WHERE ts >= '2024-01-14' AND ts < '2024-01-21'"),
    "users_heatmap": (lambda s, d: product.heatmap(actions(s, d)), "SELECT h.r AS hour, w.r AS dow, count(event_id) AS n FROM range(24) h(r) CROSS JOIN range(7) w(r) LEFT JOIN events ON hour(ts) = h.r AND dayofweek(ts) = w.r GROUP BY 1, 2"),
    "users_retention": (lambda s, d: product.retention(actions(s, d)).withColumn("share", F.round("share", 6)), "WITH f AS (SELECT user_id, date_trunc('week', min(ts))::TIMESTAMP AS c FROM events GROUP BY 1), a AS (SELECT c, (epoch_us(ts) // 1000 - epoch_us(c) // 1000) // 604800000 AS week, user_id FROM events JOIN f USING (user_id)), z AS (SELECT c, count(*) AS size FROM f GROUP BY 1) SELECT strftime(c, '%G-W%V') AS cohort, week, count(DISTINCT user_id) AS active, size, round(count(DISTINCT user_id) / size, 6) AS share FROM a JOIN z USING (c) WHERE week BETWEEN 0 AND 8 GROUP BY c, week, size"),
    "users_sessions": (lambda s, d: product.session_stats(actions(s, d).withColumn("sid", F.col("user_id") % 40).withColumn("ms", F.unix_millis("ts")), "sid", "ms", ["event_id"]), "SELECT user_id % 40 AS sid, min(epoch_us(ts) // 1000) AS start, arg_max(epoch_us(ts) // 1000, event_id) AS \"end\", count(*) AS n FROM events GROUP BY 1"),
    "users_report": (lambda s, d: product.report(actions(s, d), "2024-01-28", 7), f"SELECT CASE WHEN ts >= '2024-01-22' THEN 'current' ELSE 'previous' END AS period, count(*) AS actions, count(DISTINCT user_id) AS users, count(*) FILTER (action = 'create') AS creates, count(*) FILTER (action = 'edit') AS edits, count(*) FILTER (action = 'view') AS views FROM {_ACT} WHERE ts >= '2024-01-15' AND ts < '2024-01-29' GROUP BY 1"),
    "content_most_viewed": (lambda s, d: product.most(actions(s, d).withColumn("node", F.col("event_id") % 50), "view", "node"), "SELECT event_id % 50 AS node, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY n DESC, node LIMIT 10"),
    "content_quality": (lambda s, d: _content(s, d).select("doc_id", "score"), f"SELECT * FROM {_SC}"),
    "content_quality_distribution": (lambda s, d: product.score_buckets(_content(s, d), "score"), f"SELECT r AS bucket, count(doc_id) AS n FROM range(5) x(r) LEFT JOIN {_SC} ON least(CAST(floor(score / 20) AS BIGINT), 4) = r GROUP BY 1"),
    "content_stale": (lambda s, d: _content(s, d).where("age > 90").orderBy(F.desc("age"), "doc_id").limit(50).select("doc_id", "age"), "SELECT doc_id, CAST(doc_id % 700 AS DOUBLE) AS age FROM documents WHERE doc_id % 700 > 90 ORDER BY age DESC, doc_id LIMIT 50"),
    "content_tag_usage": (lambda s, d: table(s, d, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(50), "SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY 1 ORDER BY n DESC, tag LIMIT 50"),
    "content_growth": (lambda s, d: product.growth(table(s, d, "orders"), "o_orderdate", "month").withColumn("bucket", F.date_format("bucket", "yyyy-MM")), "SELECT strftime(m, '%Y-%m') AS bucket, count(o_orderkey) AS new, CAST(sum(count(o_orderkey)) OVER (ORDER BY m) AS BIGINT) AS total FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders) LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m"),
    "search_query_stats": (lambda s, d: product.query_stats(_searches(s, d), "query", "results", "latency").withColumn("latency", F.round("latency", 6)).withColumn("results", F.round("results", 6)), f"SELECT query, count(*) AS n, count(*) FILTER (results = 0) AS zero, round(avg(latency), 6) AS latency, round(avg(results), 6) AS results FROM {_SQ} GROUP BY 1"),
    "search_click_through": (lambda s, d: product.click_through(_searches(s, d), _clicks(s, d)).withColumn("ctr", F.round("ctr", 6)), f"WITH f AS (SELECT query, count(*) AS searches, min(ord) AS o FROM {_SQ} GROUP BY 1) SELECT f.query, searches, count(k.ord) AS clicks, round(count(k.ord) / searches, 6) AS ctr FROM f LEFT JOIN {_CK} k ON k.query = f.query AND k.ord > f.o GROUP BY f.query, searches"),
    "search_suggest": (lambda s, d: product.suggest(product.query_stats(_searches(s, d), "query", "results", "latency"), "e", 8).select("query", "n"), f"SELECT query, count(*) AS n FROM {_SQ} WHERE starts_with(query, 'e') GROUP BY 1 ORDER BY n DESC, query LIMIT 8"),
    "search_trending": (lambda s, d: product.trending(_searches(s, d).withColumn("ms", F.col("ord")), 100000, 20000, 60000), f"SELECT query, recent, old, CASE WHEN old = 0 THEN 'inf'::DOUBLE ELSE recent / (old * (20000 / 60000)) END AS growth FROM (SELECT query, count(*) FILTER (ord > 80000) AS recent, count(*) FILTER (ord <= 80000) AS old FROM {_SQ} WHERE ord BETWEEN 20001 AND 100000 GROUP BY 1) WHERE recent > 0 AND (old = 0 OR recent / (old * (20000 / 60000)) > 1)"),
    "search_zero_rate": (lambda s, d: _searches(s, d).agg(F.count("*").alias("searches"), F.round(F.count_if(F.col("results") == 0) / F.count("*"), 6).alias("zero_rate"), F.round(F.avg("latency"), 6).alias("latency")), f"SELECT count(*) AS searches, round(count(*) FILTER (results = 0) / count(*), 6) AS zero_rate, round(avg(latency), 6) AS latency FROM {_SQ}"),
}
