"""Queries of influence, flows, triads, migrations, seeded draws, and scores and predicates over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import draws as R
from lattica.functions import scalar as X
from lattica.functions import text as N
from lattica.operators import spread as P
from lattica.operators.migration import Migrations
from lattica.plans.graphs import _G, _N, _r, trade
from lattica.session import table as T

#: Scores and modifiers of the sentiment query: frequent words of the documents, as a caller's own lexicon (fixed values).
_LEXICON = {"of": 0.5, "and": 2.0, "der": -1.5, "que": 3.0}
_NEGATIONS, _MORE, _LESS = ("to", "is"), ("that",), ("la",)


def _sentiment(s, d):
    words = T(s, d, "documents").select("doc_id", N.word_tokens("text").alias("w"))
    scored = words.where(F.exists("w", lambda w: w.isin(*_LEXICON)))
    return _r(scored.select("doc_id", N.sentiment(F.col("w"), _LEXICON, _NEGATIONS, _MORE, _LESS).alias("score")))


def _listed(words):
    return ", ".join(f"'{w}'" for w in words)


_SCORE = "CASE w " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in _LEXICON.items()) + " END"
_SENTIMENT = f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 2) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t), s AS (SELECT doc_id, i, w, {_SCORE} AS v FROM w WHERE w IN ({_listed([*_LEXICON, *_NEGATIONS, *_MORE, *_LESS])})),
g AS (SELECT *, coalesce(count(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM s),
x AS (SELECT doc_id, g, max(v) AS v, count(*) FILTER (w IN ({_listed(_NEGATIONS)})) AS k, arg_max(CASE WHEN w IN ({_listed(_MORE)}) THEN 1.8 ELSE 0.5 END, i) FILTER (w IN ({_listed([*_MORE, *_LESS])})) AS f FROM g GROUP BY 1, 2)
SELECT doc_id, round(sum(v * (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * coalesce(f, 1.0))::DOUBLE, 6) AS score FROM x WHERE v IS NOT NULL GROUP BY 1"""


def _migrated(s, d):
    plan = (
        Migrations()
        .step("1", "2", lambda df: df.withColumnRenamed("name", "label"))
        .step("2", "3", lambda df: df.withColumn("cents", F.round(F.col("price") * 100).cast("long")).drop("price"))
        .step("3", "4", lambda df: df.withColumn("label", F.upper("label")))
        .rule("4", F.col("cents") >= 100_000)
    )
    rows = T(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return plan.valid(plan.migrate(rows, "1", "4"), "4")


def _flow(s, d):
    return trade(s, d).select("source", "target", (F.col("weight") - F.when(F.col("source") % 5 == 0, 0.0).when(F.col("source") % 5 == 1, 4.0).otherwise(-0.5)).alias("flow"))


_F = "f AS (SELECT source, target, weight AS room, weight - CASE source % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 4.0 ELSE -0.5 END AS flow FROM g)"

QUERIES = {
    "text_sentiment_documents": (_sentiment, _SENTIMENT),
    "fn_predicates_mixed": (
        lambda s, d: T(s, d, "pages").select("page_id", X.is_url(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.reverse("url"))).alias("u"), X.is_json(F.concat(F.lit('{"a":'), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("page_id").cast("string")), F.lit("}"))).alias("j"), X.is_numeric(F.concat(F.element_at(F.array(F.lit(""), F.lit("-"), F.lit("x"), F.lit("+.")), (F.col("page_id") % 4 + 1).cast("int")), "page_id")).alias("n"), X.is_hex_color(F.concat(F.lit("#"), F.substring(F.md5("url"), 1, 4))).alias("c")),
        "SELECT page_id, regexp_matches(CASE WHEN page_id % 2 = 0 THEN url ELSE reverse(url) END, '^https?://[^\\s/]+') AS u, json_valid('{\"a\":' || CASE WHEN page_id % 3 = 0 THEN '' ELSE page_id::VARCHAR END || '}') AS j, page_id % 4 <> 2 AS n, false AS c FROM pages",
    ),
    "schema_migration": (_migrated, "SELECT p_partkey, upper(p_name) AS label, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS cents FROM part WHERE floor(p_retailprice * 100 + 0.5) >= 100000"),
    "graph_triad_types": (
        lambda s, d: P.triad_types(trade(s, d)),
        f"WITH {_G}, {_N}, l AS (SELECT DISTINCT source AS u, target AS v FROM g WHERE source <> target), h AS (SELECT x.id AS i, y.id AS j, (l.u IS NOT NULL)::INT AS e FROM n x CROSS JOIN n y LEFT JOIN l ON l.u = x.id AND l.v = y.id), "
        "t AS (SELECT p.e AS uv, q.e AS vu, r.e AS uw, s.e AS wu, y.e AS vw, z.e AS wv FROM h p JOIN h q ON q.i = p.j AND q.j = p.i JOIN h r ON r.i = p.i AND r.j > p.j JOIN h s ON s.i = r.j AND s.j = r.i JOIN h y ON y.i = p.j AND y.j = r.j JOIN h z ON z.i = y.j AND z.j = y.i WHERE p.i < p.j), "
        "k AS (SELECT *, uv * vu + uw * wu + vw * wv AS m, uv + vu + uw + wu + vw + wv AS e, greatest(uv * (1 - vu) + uw * (1 - wu), vu * (1 - uv) + vw * (1 - wv), wu * (1 - uw) + wv * (1 - vw)) AS o, greatest(vu * (1 - uv) + wu * (1 - uw), uv * (1 - vu) + wv * (1 - vw), uw * (1 - wu) + vw * (1 - wv)) AS i, "
        "(uv * vu * (uw * (1 - wu) + vw * (1 - wv)) + uw * wu * (uv * (1 - vu) + wv * (1 - vw)) + vw * wv * (vu * (1 - uv) + wu * (1 - uw))) AS away FROM t), "
        "c AS (SELECT CASE WHEN m = 0 AND e = 0 THEN '003' WHEN m = 0 AND e = 1 THEN '012' WHEN m = 1 AND e = 2 THEN '102' WHEN m = 0 AND e = 2 THEN '021' || CASE WHEN o = 2 THEN 'D' WHEN i = 2 THEN 'U' ELSE 'C' END WHEN m = 0 THEN CASE WHEN o = 1 THEN '030C' ELSE '030T' END WHEN m = 1 AND e = 3 THEN CASE WHEN away = 0 THEN '111D' ELSE '111U' END "
        "WHEN m = 1 THEN '120' || CASE WHEN o = 2 THEN 'D' WHEN i = 2 THEN 'U' ELSE 'C' END WHEN m = 2 AND e = 4 THEN '201' WHEN m = 2 THEN '210' ELSE '300' END AS type FROM k) "
        f"SELECT a.type, count(c.type) AS n FROM (SELECT unnest([{_listed(P.TRIADS)}]) AS type) a LEFT JOIN c USING (type) GROUP BY 1",
    ),
    "graph_cascade_trace": (
        lambda s, d: P.cascade_trace(trade(s, d), [0, 5]),  # all weights are 1 or more, so every edge is live
        f"WITH RECURSIVE {_G}, w AS (SELECT unnest([0, 5]) AS id, 0 AS round UNION SELECT g.target, w.round + 1 FROM w JOIN g ON g.source = w.id WHERE w.round < 30) SELECT CAST(min(round) AS INTEGER) AS round, id FROM w GROUP BY id",
    ),
    "graph_greedy_seeds": (lambda s, d: _r(P.greedy_seeds(trade(s, d).withColumn("weight", F.col("weight") / 6), 3, 40)), None),
    "graph_threshold_spread": (lambda s, d: _r(P.threshold_spread(trade(s, d), [0, 5], 40)), None),
    "graph_flow_faults": (
        lambda s, d: _r(P.flow_faults(_flow(s, d), trade(s, d), 0, 21)),
        f"WITH {_G}, {_F}, e AS (SELECT source AS id, flow AS x FROM f UNION ALL SELECT target, -flow FROM f) SELECT CASE WHEN flow < 0 THEN 'negative' ELSE 'capacity' END AS rule, source, target, round(CASE WHEN flow < 0 THEN flow ELSE flow - room END, 6)::DOUBLE AS by FROM f WHERE flow < 0 OR flow - room > 1e-9 UNION ALL SELECT 'conservation', id, NULL, round(sum(x), 6)::DOUBLE FROM e WHERE id NOT IN (0, 21) GROUP BY id HAVING abs(sum(x)) > 1e-9",
    ),
    "graph_total_flow": (lambda s, d: P.total_flow(_flow(s, d), 7), f"WITH {_G}, {_F} SELECT coalesce(sum(flow), 0)::DOUBLE AS total FROM f WHERE source = 7 AND flow > 0"),
    "graph_flow_paths": (lambda s, d: P.flow_paths(trade(s, d).select("source", "target", F.col("weight").alias("flow")), 0, 21), None),
    "random_draws": (lambda s, d: T(s, d, "events").select("event_id", R.uniform(7, "event_id").alias("u"), R.normal(7, "event_id").alias("g"), R.exponential(7, "event_id", rate=2.0).alias("e"), R.poisson(7, "event_id", mean=3.0).alias("p"), R.power_law(7, "event_id").alias("w"), R.choice(7, ["a", "b", "c"], "event_id", weights=[1.0, 2.0, 1.0]).alias("c")), None),
}
