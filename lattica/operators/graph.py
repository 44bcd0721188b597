"""Property graphs as (id, type) nodes and (source, target, type, weight) edges: adjacency, traversal, matching.

Parallel edges count in degrees and are united in adjacency. Loops are driver-side iterations over
DataFrames; each round's frontier is checkpointed, so lineage stays short and executors may be lost.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import cut


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct (u, v) steps: along edges (out), against them (in) or both ways."""
    out = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    back = edges.select(F.col("target").alias("u"), F.col("source").alias("v"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each connected pair once as u < v, without loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()


def neighbors(edges: DataFrame, ids: list, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    kept = edges.where(F.col("type").isin(types)) if types else edges
    return oriented(kept, direction).where(F.col("u").isin(ids)).select(F.col("v").alias("id")).distinct()


def edges_between(edges: DataFrame, a, b) -> DataFrame:
    return edges.where((F.col("source") == a) & (F.col("target") == b))


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ends = lambda c: nodes.select(F.col("id").alias(c))
    return edges.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every vertex; parallel edges count, a loop counts on both sides."""
    flags = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    return flags.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n"))


def graph_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, density (4 decimals) and average degree 2E/N (2 decimals)."""
    half = lambda c, d: F.floor(c * 10**d + 0.5) / 10**d
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    both = n.crossJoin(e)  # one row each
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return both.select("nodes", "edges", half(density, 4).alias("density"), half(F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0), 2).alias("avg_degree"))


def traverse(edges: DataFrame, start, depth: int = 3, direction: str = "out", node_filter: Column | None = None) -> DataFrame:
    """Distinct (id, depth) over simple paths from ``start``; a node may be met at several depths."""
    steps = cut(oriented(edges, direction))
    paths = steps.sparkSession.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path"))
    found = paths.select("id", F.lit(0).alias("depth"))
    for k in range(1, depth + 1):
        paths = paths.join(steps, F.col("id") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        paths = cut(paths.select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path")))
        found = found.union(paths.select("id", F.lit(k)))
    return found.distinct()


def paths_between(edges: DataFrame, start, end, least: int, most: int, direction: str = "out") -> DataFrame:
    """All simple paths of ``least`` to ``most`` hops."""
    steps = cut(oriented(edges, direction))
    paths = steps.sparkSession.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path"))
    found = None
    for k in range(1, most + 1):
        paths = paths.where(F.col("id") != F.lit(end)).join(steps, F.col("id") == F.col("u")).where(~F.array_contains("path", F.col("v")))
        paths = cut(paths.select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path")))
        if k >= least:
            here = paths.where(F.col("id") == F.lit(end)).select(F.lit(k).alias("hops"), "path")
            found = here if found is None else found.union(here)
    return found


def bfs(edges: DataFrame, start, max_depth: int = 10, direction: str = "out", types: list[str] | None = None) -> DataFrame:
    """(id, depth, path): hop distances with the smallest path of each node."""
    steps = cut(oriented(edges.where(F.col("type").isin(types)) if types else edges, direction))
    front = steps.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("depth"), F.array(F.lit(start)).alias("path"))
    seen = front
    for k in range(1, max_depth + 1):
        new = front.join(steps, F.col("id") == F.col("u")).select(F.col("v").alias("id"), F.concat("path", F.array("v")).alias("path"))
        new = new.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        front = cut(new.select("id", F.lit(k).alias("depth"), "path"))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def shortest_path(edges: DataFrame, start, end, max_hops: int = 10, direction: str = "out") -> DataFrame:
    return bfs(edges, start, max_hops, direction).where(F.col("id") == F.lit(end)).select("depth", "path")


def bidirectional_distance(edges: DataFrame, start, end, most: int | None = None) -> int | None:
    """Hops between two nodes, at any distance unless a most is named, or None: two frontiers grow in turn until they
    meet or one has nowhere to go; a driver-read scalar a round."""
    ahead, back = cut(oriented(edges, "out")), cut(oriented(edges, "in"))
    spark = edges.sparkSession
    fronts = [spark.range(1).select(F.lit(x).alias("id"), F.lit(0).alias("d")) for x in (start, end)]
    seen = list(fronts)
    for k in count() if most is None else range(most + 1):
        met = seen[0].alias("a").join(seen[1].alias("b"), "id").agg(F.min(F.col("a.d") + F.col("b.d")).alias("d")).first()["d"]
        if met is not None:
            return int(met)
        side = k % 2
        new = fronts[side].join(ahead if side == 0 else back, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct().join(seen[side].select("id"), "id", "left_anti")
        fronts[side] = cut(new.select("id", F.lit(k // 2 + 1).alias("d")))
        if not fronts[side].limit(1).count():
            break
        seen[side] = seen[side].union(fronts[side])
        if k % 16 > 13:
            seen[side] = cut(seen[side])
    return None


def all_distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, direction: str = "out") -> DataFrame:
    """(source, id, depth) hop distances from many sources at once, itself left out, at any depth unless one is named."""
    steps = cut(oriented(edges, direction))
    front = sources.select(F.col("id").alias("s"), "id")
    seen = front.select("s", "id", F.lit(0).alias("depth"))
    for k in count(1) if max_depth is None else range(1, max_depth + 1):
        new = front.join(steps, F.col("id") == F.col("u")).select("s", F.col("v").alias("id")).distinct().join(seen.select("s", "id"), ["s", "id"], "left_anti")
        front = cut(new)
        if not front.limit(1).count():
            break
        seen = seen.union(front.select("s", "id", F.lit(k)))
        if k % 8 == 0:
            seen = cut(seen)
    return seen.where("depth > 0").withColumnRenamed("s", "source")
