"""Queries over records, queues, timings and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import dedup as D
from lattica.operators import records as X
from lattica.session import table as T


def _r(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _jobs(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderkey") % 17 == 0, "dead").otherwise("pending")
    return T(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("queue"), state.alias("state"), (F.col("o_orderkey") % 4).alias("tries"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"), F.col("o_totalprice").alias("price"), "o_custkey")


_J = "(SELECT o_orderkey, o_orderpriority AS queue, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 17 = 0 THEN 'dead' ELSE 'pending' END AS state, o_orderkey % 4 AS tries, epoch_ms(o_orderdate) AS ms, o_totalprice AS price, o_custkey FROM orders)"


def _ev(s, d):
    return T(s, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


_E = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)"


def _flat_and_back(s, d):
    nested = T(s, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("at")).alias("who"))
    flat = X.flat_fields(nested)
    back = X.nested_fields(flat)
    return flat.join(back.select("c_custkey", F.col("who.at.nation").alias("again")), "c_custkey").select("c_custkey", F.col("`who.name`").alias("name"), F.col("`who.at.nation`").alias("nation"), "again")


QUERIES = {
    "object_pick_omit": (lambda s, d: X.omit(X.pick(T(s, d, "part"), ["p_partkey", "p_name", "none", "p_size"]), ["p_size"]), "SELECT p_partkey, p_name FROM part"),
    "object_flat_nested": (_flat_and_back, "SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_nationkey AS again FROM customer"),
    "object_map_keys_values": (lambda s, d: T(s, d, "nation").select("n_nationkey", X.map_values(X.map_keys(F.create_map(F.lit("a"), F.col("n_nationkey"), F.lit("A"), F.col("n_regionkey")), F.lower), lambda v: v * 2).alias("m")).select("n_nationkey", F.size("m").cast("long").alias("n"), F.col("m")["a"].cast("long").alias("v")), "SELECT n_nationkey, CAST(1 AS BIGINT) AS n, CAST(2 * n_regionkey AS BIGINT) AS v FROM nation"),
    "array_compact_flatten": (lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(X.compact(X.flatten(F.array(F.split("p_name", "a"), F.split("p_type", " ")))), "|").alias("t")), "SELECT p_partkey, array_to_string(list_filter(list_concat(string_split(p_name, 'a'), string_split(p_type, ' ')), lambda x: x <> ''), '|') AS t FROM part"),
    "event_sampling": (lambda s, d: X.sampled(T(s, d, "events"), ["user_id"], 0.2).select("event_id", "user_id"), None),
    "queue_stats": (lambda s, d: _r(X.queue_stats(_jobs(s, d), "state", "tries", "queue")), f"SELECT queue, count(*) AS jobs, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'dead') AS dead, count(*) FILTER (tries > 1) AS retried, round(count(*) FILTER (state = 'dead') / count(*), 6) AS dead_share FROM {_J} GROUP BY 1"),
    "queue_dead_letters": (lambda s, d: X.dead_letters_by_reason(_jobs(s, d).where("state = 'dead'"), "queue", "ms"), f"SELECT queue, count(*) AS n, min(ms) AS oldest, max(ms) AS newest FROM {_J} WHERE state = 'dead' GROUP BY 1"),
    "queue_next_jobs": (lambda s, d: X.next_jobs(_jobs(s, d).where("state = 'pending'"), "price", "ms", 946_684_800_000, ["o_orderkey"], 25).select("o_orderkey"), f"SELECT o_orderkey FROM {_J} WHERE state = 'pending' AND ms <= 946684800000 ORDER BY price DESC, ms, o_orderkey LIMIT 25"),
    "version_stats": (lambda s, d: _r(X.version_stats(_jobs(s, d), "o_custkey", "ms")), f"WITH p AS (SELECT o_custkey, count(*) AS n, min(ms) AS lo, max(ms) AS hi FROM {_J} GROUP BY 1) SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS versions, max(n) AS most, round(avg(n), 6) AS mean, min(lo) AS oldest, max(hi) AS newest FROM p"),
    "timing_stats": (lambda s, d: _r(X.timing_stats(_ev(s, d), "event_type", "value"), 4), f"SELECT event_type, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(stddev_pop(value), 4) AS deviation FROM {_E} GROUP BY 1"),
    "metric_snapshots": (lambda s, d: X.snapshot_series(_ev(s, d), "event_type", "ms", "value", 86_400_000), f"SELECT event_type, ms // 86400000 * 86400000 AS bucket, arg_max(value, ms) AS value FROM {_E} GROUP BY 1, 2"),
    "alert_groups": (lambda s, d: X.alert_groups(_ev(s, d).where("event_type = 'error'"), ["user_id"], "ms", "value"), f"SELECT user_id, count(*) AS n, min(ms) AS first, max(ms) AS last, max(value) AS severity FROM {_E} WHERE event_type = 'error' GROUP BY 1"),
    "content_age": (lambda s, d: _r(X.content_age(T(s, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 700).cast("double").alias("age")), "lang", "age", T(s, d, "labels").select("doc_id", (F.col("quality") * 30).cast("double").alias("edit")), "doc_id", "edit")), "WITH l AS (SELECT doc_id, min(quality * 30) AS e FROM labels GROUP BY 1), a AS (SELECT lang, CAST(least(doc_id % 700, coalesce(e, doc_id % 700)) AS DOUBLE) AS age FROM documents LEFT JOIN l USING (doc_id)) SELECT lang, count(*) AS n, round(avg(age), 6) AS mean_age, max(age) AS most_age FROM a GROUP BY 1"),
    "dictionary_codes": (lambda s, d: X.dictionary_codes(T(s, d, "part"), "p_type"), "SELECT p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS code FROM part GROUP BY 1"),
    "dedup_combined": (lambda s, d: D.combined(T(s, d, "part"), "p_name", ["p_type", "p_brand"], ["p_partkey"]).select("p_partkey"), "WITH t AS (SELECT min(p_partkey) AS k FROM part GROUP BY trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))) SELECT min(p_partkey) AS p_partkey FROM part SEMI JOIN t ON p_partkey = k GROUP BY lower(p_type), lower(p_brand)"),
}
