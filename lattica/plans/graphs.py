"""Graph queries: a small trade graph between nations and a large bipartite graph of customers and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators import graph_algorithms as A
from lattica.operators import joins as J
from lattica.session import cut, table


def trade(spark, d):
    """Each nation's three largest customers of other nations; the weight is the rank."""
    sold = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = sold.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.round(F.sum("l_extendedprice"), 2).alias("w"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("w"), "target"))
    top = sums.withColumn("weight", rank.cast("double")).where("weight <= 3")
    return cut(top.select((F.col("source") * 100 + F.col("target")).alias("id"), "source", "target", F.when(F.col("weight") == 1, "first").otherwise("other").alias("type"), "weight"))


def bought(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("source"), (F.col("l_partkey") + 10_000_000).alias("target")).distinct().withColumn("weight", F.lit(1.0)).withColumn("type", F.lit("bought"))


def forward(spark, d):
    return trade(spark, d).where("source < target")


def _r(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_G = """g AS (SELECT source, target, CAST(r AS DOUBLE) AS weight, CASE r WHEN 1 THEN 'first' ELSE 'other' END AS type FROM (
  SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY w DESC, target) AS r FROM (
    SELECT s_nationkey AS source, c_nationkey AS target, round(sum(l_extendedprice), 2) AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)) WHERE r <= 3)"""
_N = "n AS (SELECT source AS id FROM g UNION SELECT target FROM g)"
_B = "g AS (SELECT DISTINCT o_custkey AS source, l_partkey + 10000000 AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_U = "u AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM g WHERE source <> target), b AS (SELECT u, v FROM u UNION ALL SELECT v, u FROM u), dg AS (SELECT u AS id, count(*) AS d FROM b GROUP BY 1)"


def _rounds(k, first, step):
    """CTEs r0 to rk, each made from the one before."""
    return ", ".join([f"r0 AS MATERIALIZED ({first})", *[f"r{i} AS MATERIALIZED ({step.format(p=f'r{i - 1}')})" for i in range(1, k + 1)]])


def _page_rank(graph, k):
    return f"WITH {graph}, {_N}, l AS (SELECT DISTINCT source, target FROM g), o AS (SELECT source, count(*) AS d FROM l GROUP BY 1), c AS (SELECT count(*) AS c FROM n), " + _rounds(k, "SELECT id, 1.0::DOUBLE / c AS r FROM n, c", "SELECT n.id, 0.15 / c + 0.85 * coalesce(x, 0) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT l.target AS id, sum(p.r / o.d) AS x FROM l JOIN o USING (source) JOIN {p} p ON p.id = l.source GROUP BY 1) USING (id)") + f" SELECT id, round(r, 9) AS rank FROM r{k}"


def _hits(k):
    parts = ["a0 AS (SELECT id, 1.0::DOUBLE AS x FROM n)", "h0 AS (SELECT id, 1.0::DOUBLE AS x FROM n)"]
    for i in range(1, k + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT n.id, coalesce(sum(h.x), 0) AS x FROM n LEFT JOIN l ON l.target = n.id LEFT JOIN h{i - 1} h ON h.id = l.source GROUP BY 1))")
        parts.append(f"h{i} AS MATERIALIZED (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT n.id, coalesce(sum(a.x), 0) AS x FROM n LEFT JOIN l ON l.source = n.id LEFT JOIN a{i} a ON a.id = l.target GROUP BY 1))")
    return f"WITH {_G}, {_N}, l AS (SELECT DISTINCT source, target FROM g), " + ", ".join(parts) + f" SELECT h.id, round(h.x, 6) AS hub, round(a.x, 6) AS authority FROM h{k} h JOIN a{k} a USING (id)"


_DIST = "d AS (SELECT source AS s, target AS id, 1 AS depth FROM g UNION SELECT d.s, g.target, depth + 1 FROM d JOIN g ON g.source = d.id WHERE depth < 12), m AS (SELECT s, id, min(depth) AS depth FROM d WHERE s <> id GROUP BY 1, 2)"
_LOOP = "SELECT n.id, least(p.w, min(q.w + g.weight)) AS w FROM n"

QUERIES = {
    "graph_neighbors": (lambda s, d: G.neighbors(trade(s, d), [3, 7], "both"), f"WITH {_G} SELECT DISTINCT id FROM (SELECT target AS id FROM g WHERE source IN (3, 7) UNION SELECT source FROM g WHERE target IN (3, 7))"),
    "graph_neighbors_typed": (lambda s, d: G.neighbors(trade(s, d), [3, 7], "out", ["first"]), f"WITH {_G} SELECT DISTINCT target AS id FROM g WHERE source IN (3, 7) AND type = 'first'"),
    "graph_degrees": (lambda s, d: G.degrees(trade(s, d)), f"WITH {_G}, {_N} SELECT id, (SELECT count(*) FROM g WHERE target = id) AS in_degree, (SELECT count(*) FROM g WHERE source = id) AS out_degree, (SELECT count(*) FROM g WHERE target = id) + (SELECT count(*) FROM g WHERE source = id) AS degree FROM n"),
    "graph_degree_histogram": (lambda s, d: G.degree_histogram(bought(s, d)), f"WITH {_B} SELECT degree, count(*) AS n FROM (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM g UNION ALL SELECT target FROM g) GROUP BY 1) GROUP BY 1"),
    "graph_statistics": (lambda s, d: G.graph_statistics(trade(s, d), G.vertices(trade(s, d))), f"WITH {_G}, {_N}, a AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM g) AS edges) SELECT nodes, edges, floor(edges / (nodes * (nodes - 1)) * 10000 + 0.5) / 10000 AS density, floor(2 * edges / nodes * 100 + 0.5) / 100 AS avg_degree FROM a"),
    "graph_subgraph": (lambda s, d: G.subgraph(trade(s, d), s.range(12).withColumnRenamed("id", "id")).select("source", "target"), f"WITH {_G} SELECT source, target FROM g WHERE source < 12 AND target < 12"),
    "graph_traverse": (lambda s, d: G.traverse(trade(s, d), 0, 3), f"WITH RECURSIVE {_G}, t AS (SELECT 0 AS id, 0 AS depth, [0] AS path UNION ALL SELECT g.target, depth + 1, list_append(path, g.target) FROM t JOIN g ON g.source = t.id WHERE depth < 3 AND NOT list_contains(path, g.target)) SELECT DISTINCT id, depth FROM t"),
    "graph_paths": (lambda s, d: G.paths_between(trade(s, d), 0, 21, 1, 6).select("hops", F.array_join("path", ">").alias("path")), f"WITH RECURSIVE {_G}, t AS (SELECT 0 AS id, 0 AS hops, [0] AS path UNION ALL SELECT g.target, hops + 1, list_append(path, g.target) FROM t JOIN g ON g.source = t.id WHERE hops < 6 AND t.id <> 21 AND NOT list_contains(path, g.target)) SELECT hops, array_to_string(path, '>') AS path FROM t WHERE id = 21 AND hops >= 1"),
    "graph_bfs": (lambda s, d: G.bfs(trade(s, d), 0).select("id", "depth"), f"WITH RECURSIVE {_G}, {_DIST} SELECT id, depth FROM m WHERE s = 0 UNION ALL SELECT 0, 0"),
    "graph_bfs_both_typed": (lambda s, d: G.bfs(trade(s, d), 4, 6, "both", ["first"]).select("id", "depth"), f"WITH RECURSIVE {_G}, f AS (SELECT source, target FROM g WHERE type = 'first' UNION SELECT target, source FROM g WHERE type = 'first'), d AS (SELECT 4 AS id, 0 AS depth UNION SELECT target, depth + 1 FROM d JOIN f ON source = id WHERE depth < 6) SELECT id, min(depth) AS depth FROM d GROUP BY 1"),
    "graph_shortest_path": (lambda s, d: G.shortest_path(trade(s, d), 1, 20).select("depth"), f"WITH RECURSIVE {_G}, {_DIST} SELECT depth FROM m WHERE s = 1 AND id = 20"),
    "graph_bidirectional": (lambda s, d: s.createDataFrame([(G.bidirectional_distance(trade(s, d), 1, 20, 12),)], "depth int").where("depth is not null"), f"WITH RECURSIVE {_G}, {_DIST} SELECT depth FROM m WHERE s = 1 AND id = 20"),
    "graph_pattern": (lambda s, d: J.pattern_join(G.vertices(trade(s, d)).withColumn("type", F.lit("nation")), trade(s, d), {"a": "nation", "b": None, "c": None}, [("a", "b", "first", "outbound"), ("b", "c", None, "any")]).select("a", "b", "c"), f"WITH {_G} SELECT x.source AS a, x.target AS b, y.target AS c FROM g x JOIN (SELECT source, target FROM g UNION ALL SELECT target, source FROM g) y ON x.target = y.source WHERE x.type = 'first'"),
    "graph_pagerank": (lambda s, d: _r(A.page_rank(trade(s, d), rounds=12, tolerance=None), 9), _page_rank(_G, 12)),
    "graph_pagerank_large": (lambda s, d: _r(A.page_rank(bought(s, d), rounds=5, tolerance=None), 9), _page_rank(_B, 5)),
    "graph_pagerank_converged": (lambda s, d: A.rank_nodes(A.page_rank(trade(s, d)), "rank", 5).select("id"), _page_rank(_G, 60).replace("SELECT id, round(r, 9) AS rank FROM r60", "SELECT id FROM r60 ORDER BY r DESC, id LIMIT 5")),
    "graph_hits": (lambda s, d: _r(A.hits(trade(s, d), 6)), _hits(6)),
    "graph_eigenvector": (lambda s, d: _r(A.eigenvector(trade(s, d), 8)), f"WITH {_G}, {_N}, l AS (SELECT DISTINCT source, target FROM g), " + _rounds(8, "SELECT id, 1.0::DOUBLE AS x FROM n", "SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT n.id, coalesce(sum(p.x), 0) AS x FROM n LEFT JOIN l ON l.target = n.id LEFT JOIN {p} p ON p.id = l.source GROUP BY 1)") + " SELECT id, round(x, 6) AS score FROM r8"),
    "graph_closeness": (lambda s, d: _r(A.closeness(trade(s, d)).select("id", "closeness", "harmonic")), f"WITH RECURSIVE {_G}, {_N}, {_DIST}, c AS (SELECT count(*) - 1 AS c FROM n) SELECT n.id, round(coalesce(count(m.id) / sum(depth) * count(m.id) / c, 0), 6) AS closeness, round(coalesce(sum(1 / depth), 0) / c, 6) AS harmonic FROM n CROSS JOIN c LEFT JOIN m ON m.s = n.id GROUP BY n.id, c"),
    "graph_betweenness": (lambda s, d: _r(A.betweenness(trade(s, d))), f"WITH RECURSIVE {_G}, {_N}, {_DIST}, p AS (SELECT source AS s, target AS t, [source, target] AS path FROM g UNION ALL SELECT p.s, g.target, list_append(path, g.target) FROM p JOIN g ON g.source = p.t JOIN m ON m.s = p.s AND m.id = g.target AND m.depth = len(path)), q AS (SELECT p.s, p.t, path, count(*) OVER (PARTITION BY p.s, p.t) AS k FROM p JOIN m ON m.s = p.s AND m.id = p.t AND m.depth = len(path) - 1), v AS (SELECT unnest(path[2:-2]) AS id, 1.0 / k AS x FROM q WHERE len(path) > 2), c AS (SELECT count(*) AS c FROM n) SELECT n.id, round(coalesce(sum(x), 0) / ((c - 1) * (c - 2)), 6) AS betweenness FROM n CROSS JOIN c LEFT JOIN v USING (id) GROUP BY n.id, c"),
    "graph_triangles": (lambda s, d: A.triangles(trade(s, d)), f"WITH {_G}, {_U} SELECT p.u AS x, p.v AS y, q.v AS z FROM u p JOIN u q ON p.v = q.u JOIN u r ON r.u = p.u AND r.v = q.v"),
    "graph_clustering": (lambda s, d: _r(A.triangle_counts(trade(s, d))), f"WITH {_G}, {_U}, t AS (SELECT unnest([p.u, p.v, q.v]) AS id FROM u p JOIN u q ON p.v = q.u JOIN u r ON r.u = p.u AND r.v = q.v) SELECT dg.id, count(t.id) AS triangles, round(CASE WHEN d > 1 THEN 2 * count(t.id) / (d * (d - 1)) ELSE 0 END, 6) AS clustering FROM dg LEFT JOIN t USING (id) GROUP BY dg.id, d"),
    "graph_motifs": (lambda s, d: _r(A.motif_profile(trade(s, d))), f"WITH {_G}, {_U}, t AS (SELECT count(*) AS t FROM u p JOIN u q ON p.v = q.u JOIN u r ON r.u = p.u AND r.v = q.v) SELECT t AS triangles, CAST(sum(d * (d - 1) // 2) AS BIGINT) AS wedges, CAST(sum(d) // 2 AS BIGINT) AS paths, count(*) FILTER (d >= 2) AS stars, round(3 * t / sum(d * (d - 1) // 2), 6) AS transitivity FROM dg, t GROUP BY t"),
    "graph_squares": (lambda s, d: A.squares(trade(s, d)), f"WITH {_G}, {_U}, c AS (SELECT x.v AS u, y.v AS v, count(*) AS k FROM b x JOIN b y ON x.u = y.u AND x.v < y.v GROUP BY 1, 2) SELECT CAST(coalesce(sum(k * (k - 1) // 2), 0) AS BIGINT) AS squares FROM c ANTI JOIN u USING (u, v)"),
    "graph_similarity": (lambda s, d: _r(A.common_neighbors(trade(s, d))), f"WITH {_G}, {_U} SELECT x.v AS u, y.v AS v, count(*) AS common, round(sum(CASE WHEN m.d > 1 THEN 1 / ln(m.d) ELSE 0 END), 6) AS adamic_adar, round(sum(1 / m.d), 6) AS resource_allocation, round(count(*) / (p.d + q.d - count(*)), 6) AS jaccard, p.d * q.d AS preferential FROM b x JOIN b y ON x.u = y.u AND x.v < y.v JOIN dg m ON m.id = x.u JOIN dg p ON p.id = x.v JOIN dg q ON q.id = y.v GROUP BY x.v, y.v, p.d, q.d"),
    "graph_link_prediction": (lambda s, d: A.predict_links(trade(s, d), "common", 15), f"WITH {_G}, {_U}, c AS (SELECT x.v AS u, y.v AS v, count(*) AS score FROM b x JOIN b y ON x.u = y.u AND x.v < y.v GROUP BY 1, 2) SELECT u, v, score FROM c ANTI JOIN u USING (u, v) ORDER BY score DESC, u, v LIMIT 15"),
    "graph_link_ensemble": (lambda s, d: _r(A.ensemble_links(trade(s, d), ["common", "preferential"], 12)), f"WITH {_G}, {_U}, c AS (SELECT x.v AS u, y.v AS v, count(*) AS k, p.d * q.d AS f FROM b x JOIN b y ON x.u = y.u AND x.v < y.v JOIN dg p ON p.id = x.v JOIN dg q ON q.id = y.v GROUP BY x.v, y.v, p.d, q.d), e AS (SELECT * FROM c ANTI JOIN u USING (u, v)) SELECT u, v, round((k / max(k) OVER () + f / max(f) OVER ()) / 2, 6) AS score FROM e ORDER BY (k / max(k) OVER () + f / max(f) OVER ()) / 2 DESC, u, v LIMIT 12"),
    "graph_katz": (lambda s, d: _r(A.katz(trade(s, d), hops=4), 12), f"WITH {_G}, {_U}, " + _rounds(3, "SELECT u, v, 1.0::DOUBLE AS w FROM b", "SELECT p.u, b.v, sum(p.w) AS w FROM {p} p JOIN b ON p.v = b.u GROUP BY 1, 2") + " SELECT u, v, round(sum(k), 12) AS katz FROM (SELECT u, v, w * 0.005 AS k FROM r0 UNION ALL SELECT u, v, w * power(0.005, 2) FROM r1 UNION ALL SELECT u, v, w * power(0.005, 3) FROM r2 UNION ALL SELECT u, v, w * power(0.005, 4) FROM r3) WHERE u < v GROUP BY 1, 2"),
    "graph_simrank": (lambda s, d: _r(A.simrank(trade(s, d), rounds=3)), f"WITH {_G}, {_N}, l AS (SELECT DISTINCT source, target FROM g), i AS (SELECT target AS id, count(*) AS d FROM l GROUP BY 1), " + _rounds(3, "SELECT id AS a, id AS b, 1.0::DOUBLE AS s FROM n", "SELECT x.target AS a, y.target AS b, 0.8 * sum(p.s) / (any_value(ia.d) * any_value(ib.d)) AS s FROM {p} p JOIN l x ON x.source = p.a JOIN l y ON y.source = p.b JOIN i ia ON ia.id = x.target JOIN i ib ON ib.id = y.target WHERE x.target <> y.target GROUP BY 1, 2 UNION ALL SELECT id, id, 1.0 FROM n") + " SELECT a, b, round(s, 6) AS s FROM r3"),
    "graph_weak_components": (lambda s, d: A.weak_components(trade(s, d).where("type = 'first'")), f"WITH RECURSIVE {_G}, f AS (SELECT source, target FROM g WHERE type = 'first' UNION SELECT target, source FROM g WHERE type = 'first'), r AS (SELECT DISTINCT source AS id, source AS x FROM f UNION SELECT r.id, f.target FROM r JOIN f ON f.source = r.x) SELECT id, min(x) AS component FROM r GROUP BY 1"),
    "graph_strong_components": (lambda s, d: A.strong_components(trade(s, d).where("type = 'first'")), f"WITH RECURSIVE {_G}, f AS (SELECT source, target FROM g WHERE type = 'first'), v AS (SELECT source AS id FROM f UNION SELECT target FROM f), r AS (SELECT id, id AS x FROM v UNION SELECT r.id, f.target FROM r JOIN f ON f.source = r.x) SELECT p.id, min(p.x) AS component FROM r p JOIN r q ON p.id = q.x AND p.x = q.id GROUP BY 1"),
    "graph_communities": (lambda s, d: _r(A.modularity(trade(s, d), cut(A.label_propagation(trade(s, d), 4)))), None),
    "graph_spanning_tree": (lambda s, d: A.spanning_forest(trade(s, d)).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")), None),
    "graph_topological_levels": (lambda s, d: A.topological_levels(forward(s, d)), f"WITH RECURSIVE {_G}, f AS (SELECT source, target FROM g WHERE source < target), v AS (SELECT source AS id FROM f UNION SELECT target FROM f), t AS (SELECT id, 0 AS level FROM v UNION SELECT f.target, level + 1 FROM t JOIN f ON f.source = t.id) SELECT id, max(level) AS level FROM t GROUP BY 1"),
    "graph_dijkstra": (lambda s, d: A.weighted_distances(trade(s, d), 0).select("id", "distance"), f"WITH {_G}, {_N}, " + _rounds(14, "SELECT id, CASE WHEN id = 0 THEN 0.0::DOUBLE END AS w FROM n", "SELECT id, min(w) AS w FROM (SELECT id, w FROM {p} UNION ALL SELECT g.target, p.w + g.weight FROM {p} p JOIN g ON g.source = p.id) GROUP BY 1") + " SELECT id, w AS distance FROM r14 WHERE w IS NOT NULL"),
    "graph_all_pairs": (lambda s, d: A.all_pairs(trade(s, d)), f"WITH {_G}, " + _rounds(14, "SELECT source AS u, target AS v, weight AS d FROM g", "SELECT u, v, min(d) AS d FROM (SELECT u, v, d FROM {p} UNION ALL SELECT p.u, g.target, p.d + g.weight FROM {p} p JOIN g ON g.source = p.v WHERE p.u <> g.target) GROUP BY 1, 2") + " SELECT u, v, d FROM r14"),
    "graph_random_walks": (lambda s, d: A.random_walks(trade(s, d), 6, 2), None),
    "graph_walk_pairs": (lambda s, d: A.walk_pairs(cut(A.random_walks(trade(s, d), 6, 2)), 3), None),
    "graph_max_flow": (lambda s, d: A.max_flow(trade(s, d), 0, 21), None),
    "graph_k_shortest": (lambda s, d: A.k_shortest(trade(s, d), 0, 21, 4).select("rank", "cost"), f"WITH RECURSIVE {_G}, t AS (SELECT 0 AS id, 0.0::DOUBLE AS cost, [0] AS path UNION ALL SELECT g.target, cost + weight, list_append(path, g.target) FROM t JOIN g ON g.source = t.id WHERE len(path) < 11 AND t.id <> 21 AND NOT list_contains(path, g.target)) SELECT row_number() OVER (ORDER BY cost) AS rank, cost FROM t WHERE id = 21 ORDER BY cost LIMIT 4"),
    "graph_cut_metrics": (lambda s, d: _r(A.cut_metrics(trade(s, d), G.vertices(trade(s, d)).select("id", (F.col("id") % 2).alias("part")))), f"WITH {_G}, {_N} SELECT (SELECT count(*) FROM g WHERE source % 2 <> target % 2) AS cut, (SELECT sum(weight) FROM g WHERE source % 2 <> target % 2) AS cut_weight, round((SELECT max(c) / avg(c) FROM (SELECT count(*) AS c FROM n GROUP BY id % 2)), 6) AS balance"),
    "graph_influence": (lambda s, d: A.influence_spread(trade(s, d).withColumn("weight", F.lit(0.3)), [0, 5], 30), None),
    "graph_degree_seeds": (lambda s, d: A.degree_seeds(bought(s, d), 10), f"WITH {_B} SELECT source AS id, count(*) AS out_degree FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
}
