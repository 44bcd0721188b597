"""Dataflow stages, index-like queries and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import structures as X
from lattica.operators.dataflow import Flow
from lattica.session import table as T


def _flow(s, d):
    return Flow(T(s, d, "events").select("event_id", "user_id", "event_type", "value"), ("event_id",))


def _matrix(s, d):
    return T(s, d, "supplier").where("s_suppkey < 36").select((F.col("s_suppkey") % 6).alias("i"), F.floor(F.col("s_suppkey") / 6).alias("j"), F.round(F.col("s_acctbal") / 1000, 0).alias("v"))


def _r(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_M = "m AS (SELECT s_suppkey % 6 AS i, s_suppkey // 6 AS j, round(s_acctbal / 1000, 0) AS v FROM supplier WHERE s_suppkey < 36)"


def _bloom(s, d):
    parts = T(s, d, "part")
    held = parts.where("p_size < 5").select("p_partkey")
    shape = X.bloom_shape_of(held, "p_partkey", 1e-9)
    return X.bloom_test(parts.select("p_partkey"), "p_partkey", X.bloom_build(held, "p_partkey", *shape), *shape)


QUERIES = {
    "flow_map_filter": (lambda s, d: _flow(s, d).filter(F.col("value") > 10).map(double=F.when(F.col("event_type") != "error", F.round(F.col("value") * 2, 6))).df, "SELECT event_id, round(value * 2, 6) AS double FROM events WHERE value > 10 AND event_type <> 'error'"),
    "flow_flat_map": (lambda s, d: _flow(s, d).flat_map(F.split("event_type", ""), "c").reduce(n=F.count("*"), kinds=F.count_distinct("c")).df, "SELECT count(*) AS n, count(DISTINCT c) AS kinds FROM (SELECT unnest(string_split(event_type, '')) AS c FROM events)"),
    "flow_take_skip": (lambda s, d: _flow(s, d).skip(10).take(20).df.select("event_id"), "SELECT event_id FROM events ORDER BY event_id LIMIT 20 OFFSET 10"),
    "flow_distinct_by": (lambda s, d: _flow(s, d).distinct_by("event_type").df.select("event_id", "event_type"), "SELECT min(event_id) AS event_id, event_type FROM events GROUP BY 2"),
    "flow_batches": (lambda s, d: _flow(s, d).batch(5, "event_id").select("batch", "n"), "SELECT CAST(i // 5 AS BIGINT) AS batch, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1"),
    "flow_dead_letters": (lambda s, d: _flow(s, d).on_error("n", F.col("event_type").try_cast("int"), "dead-letter").rejected.select("event_id"), "SELECT event_id FROM events"),
    "flow_group": (lambda s, d: _flow(s, d).group("user_id", "event_type").select("user_id", F.array_join("items", ",").alias("items")), "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items FROM events GROUP BY 1"),
    "bloom_filter": (_bloom, "SELECT p_partkey FROM part WHERE p_size < 5"),
    "index_kth": (lambda s, d: X.kth_smallest(T(s, d, "orders").select("o_totalprice"), "o_totalprice", 500), "SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 1 OFFSET 499"),
    "index_rank": (lambda s, d: X.rank_of(T(s, d, "orders"), "o_totalprice", 100000.0), "SELECT count(*) AS rank FROM orders WHERE o_totalprice < 100000"),
    "index_nearest": (lambda s, d: _r(X.nearest(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 123456.0, ["o_orderkey"], 5)), "SELECT o_orderkey, o_totalprice, round(abs(o_totalprice - 123456), 6) AS distance FROM orders ORDER BY abs(o_totalprice - 123456), o_orderkey LIMIT 5"),
    "index_range_scan": (lambda s, d: X.range_scan(T(s, d, "orders"), "o_orderkey", 100, 160).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 160"),
    "index_range_metrics": (lambda s, d: _r(X.range_metrics(T(s, d, "supplier"), "s_suppkey", "s_acctbal", s.createDataFrame([(1, 10), (5, 80)], "lo long, hi long"))), "SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, round(sum(s_acctbal), 6) AS sum, min(s_acctbal) AS min, max(s_acctbal) AS max FROM (VALUES (1, 10), (5, 80)) q(lo, hi) JOIN supplier ON s_suppkey BETWEEN lo AND hi GROUP BY 1, 2"),
    "encode_run_lengths": (lambda s, d: X.run_lengths(T(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type"), "WITH n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM n) SELECT user_id, run, event_type, count(*) AS length FROM r GROUP BY 1, 2, 3"),
    "grid_neighbours": (lambda s, d: X.grid_neighbours(T(s, d, "supplier"), "s_acctbal", "s_nationkey", "s_suppkey", 150.0), "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey AND power(x.s_acctbal - y.s_acctbal, 2) + power(x.s_nationkey - y.s_nationkey, 2) <= 22500"),
    "matrix_multiply": (lambda s, d: X.multiply(_matrix(s, d), X.transpose(_matrix(s, d))), f"WITH {_M} SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM m x JOIN m y ON x.j = y.j GROUP BY 1, 2"),
    "matrix_add_trace": (lambda s, d: _r(X.trace_norm(X.add(_matrix(s, d), X.transpose(_matrix(s, d))))), f"WITH {_M}, t AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, v FROM m) GROUP BY 1, 2) SELECT round(sum(CASE WHEN i = j THEN v ELSE 0 END), 6) AS trace, round(sqrt(sum(v * v)), 6) AS frobenius FROM t"),
    "matrix_facts": (lambda s, d: X.dense_facts(_matrix(s, d).where("i < 3 and j < 3").withColumn("g", F.lit(1)), "g").select(F.round("determinant", 4).alias("determinant")), f"WITH {_M}, c AS (SELECT max(v) FILTER (i = 0 AND j = 0) AS a, max(v) FILTER (i = 0 AND j = 1) AS b, max(v) FILTER (i = 0 AND j = 2) AS c, max(v) FILTER (i = 1 AND j = 0) AS d, max(v) FILTER (i = 1 AND j = 1) AS e, max(v) FILTER (i = 1 AND j = 2) AS f, max(v) FILTER (i = 2 AND j = 0) AS g, max(v) FILTER (i = 2 AND j = 1) AS h, max(v) FILTER (i = 2 AND j = 2) AS k FROM m) SELECT round(a * (e * k - f * h) - b * (d * k - f * g) + c * (d * h - e * g), 4) AS determinant FROM c"),
    "polynomial": (lambda s, d: _r(T(s, d, "part").select("p_partkey", X.polynomial_value([1.0, -2.0, 0.5], F.col("p_size").cast("double")).alias("y"))), "SELECT p_partkey, CAST(1 - 2 * p_size + 0.5 * p_size * p_size AS DOUBLE) AS y FROM part"),
}
