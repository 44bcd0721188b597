"""Further graph measures: censuses, Markov chains, evaluation, partitioning, biased walks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import all_distances, oriented, undirected, vertices
from lattica.operators.graph_algorithms import common_neighbors
from lattica.operators.joins import numbered
from lattica.operators.records import path_statistics
from lattica.session import cut


def dyad_census(edges: DataFrame) -> DataFrame:
    """Mutual, asymmetric and null pairs; triads without links between two of three nodes follow from these."""
    e = oriented(edges).where("u <> v")
    pairs = e.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n"))
    n = vertices(edges).agg(F.count("*").alias("v"))
    counts = pairs.agg(F.count_if(F.col("n") == 2).alias("mutual"), F.count_if(F.col("n") == 1).alias("asymmetric"))
    return counts.crossJoin(n).select("mutual", "asymmetric", (F.col("v") * (F.col("v") - 1) / 2 - F.col("mutual") - F.col("asymmetric")).cast("long").alias("none"))


def triad_census(edges: DataFrame) -> DataFrame:
    """(links, mutual, n) of all connected triples: how many directed edges and mutual pairs a triple has, and how
    many such triples there are. Triples are found through wedges, so unconnected ones cost nothing."""
    e = cut(oriented(edges).where("u <> v"))
    pairs = cut(e.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("k")))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    x, y = both.alias("x"), both.alias("y")
    wedges = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.sort_array(F.array("x.a", "x.b", "y.b")).alias("t")).distinct()
    sides = wedges.select("t", F.explode(F.array(F.struct(F.col("t")[0].alias("a"), F.col("t")[1].alias("b")), F.struct(F.col("t")[0].alias("a"), F.col("t")[2].alias("b")), F.struct(F.col("t")[1].alias("a"), F.col("t")[2].alias("b")))).alias("p"))
    joined = sides.select("t", "p.a", "p.b").join(pairs, ["a", "b"], "left")
    kinds = joined.groupBy("t").agg(F.sum(F.coalesce("k", F.lit(0))).alias("links"), F.count_if(F.col("k") == 2).alias("mutual"), F.count("k").alias("sides"))
    return kinds.groupBy("sides", "links", "mutual").agg(F.count("*").alias("n"))


def stationary(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, share): power iteration of the random walk over undirected neighbours."""
    steps = cut(oriented(edges, "both"))
    degree = steps.groupBy("u").agg(F.count("*").alias("d"))
    links = cut(steps.join(degree, "u"))
    nodes = cut(vertices(edges))
    share = nodes.select("id", F.lit(1.0 / max(nodes.count(), 1)).alias("share"))
    for k in range(rounds):
        got = links.join(share, links.u == share.id).groupBy("v").agg(F.sum(F.col("share") / F.col("d")).alias("s"))
        share = nodes.join(got, nodes.id == got.v, "left").select("id", F.coalesce("s", F.lit(0.0)).alias("share"))
        if k % 5 == 4:
            share = cut(share)
    return share


def hitting_time(walks: DataFrame, target) -> DataFrame:
    """Mean first step at which walks (start, walk, step, id) meet a node, and the share of walks that do."""
    first = walks.groupBy("start", "walk").agg(F.min(F.when(F.col("id") == target, F.col("step"))).alias("hit"))
    return first.groupBy("start").agg(F.avg("hit").alias("steps"), (F.count("hit") / F.count("*")).alias("share"))


def link_auc(edges: DataFrame, by: str, held_out: DataFrame, seed: int = 42, per_edge: int = 1) -> DataFrame:
    """Share of (held-out edge, random non-edge) pairs whose edge scores higher; ties count half. Non-edges take a
    held-out edge's source and the node that a hash of (seed, edge) picks."""
    scores = cut(common_neighbors(edges).select("u", "v", F.col(by).cast("double").alias("s")))
    linked = undirected(edges.select("source", "target").union(held_out.select("source", "target")))
    names = cut(numbered(vertices(edges), ["id"], "_n").select(F.col("id").alias("other"), "_n"))
    drawn = held_out.select("source", "target", F.explode(F.sequence(F.lit(1), F.lit(per_edge))).alias("k"))
    drawn = drawn.withColumn("_n", F.pmod(F.xxhash64(F.lit(seed), "source", "target", "k"), F.lit(max(names.count(), 1))))
    pairs = drawn.join(names, "_n").where("other <> source").select("source", "target", "other")
    bad = linked.select("u", "v", F.lit(True).alias("linked"))
    pairs = pairs.join(bad, (F.least("source", "other") == F.col("u")) & (F.greatest("source", "other") == F.col("v")), "left").where("linked is null").select("source", "target", "other")

    def scored(df: DataFrame, end: str, name: str) -> DataFrame:
        s = scores.withColumnRenamed("s", name)
        return df.join(s, (F.least("source", end) == s.u) & (F.greatest("source", end) == s.v), "left").drop("u", "v").fillna(0.0, [name])

    both = scored(scored(pairs, "target", "p"), "other", "q")
    return both.agg(F.avg(F.when(F.col("p") > F.col("q"), 1.0).when(F.col("p") == F.col("q"), 0.5).otherwise(0.0)).alias("auc"), F.count("*").alias("pairs"))


def bisect(edges: DataFrame, most_nodes: int = 20_000, rounds: int = 10) -> DataFrame:
    """(id, part) of a two-way split by swapping pairs of largest gain; sequential, so one task of checked size."""
    if vertices(edges).count() > most_nodes:
        raise ValueError(f"bisect takes graphs of at most {most_nodes} nodes")
    pairs = edges.where("source <> target").groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("weight").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, v, w in zip(pdf["u"], pdf["v"], pdf["w"]):
            near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = float(w)
        order = sorted(near)
        part = {x: i % 2 for i, x in enumerate(order)}
        for _ in range(rounds):
            gain = {x: sum(w if part[y] != part[x] else -w for y, w in near[x].items()) for x in order}
            sides = [sorted((x for x in order if part[x] == p), key=lambda x: (-gain[x], x))[:20] for p in (0, 1)]
            best = max(((gain[a] + gain[b] - 2 * near[a].get(b, 0.0), -i, -j, a, b) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1])), default=None)
            if best is None or best[0] <= 1e-12:
                break
            part[best[3]], part[best[4]] = 1, 0
        return pd.DataFrame({"id": order, "part": [part[x] for x in order]})

    return pairs.groupBy(F.lit(1).alias("g")).applyInPandas(run, f"id {dict(edges.dtypes)['source']}, part int")


def biased_walks(edges: DataFrame, length: int, per_node: int, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """node2vec walks: going back weighs 1/p, staying near the last node 1, moving away 1/q; the draw is a hash of
    (seed, start, walk, step)."""
    steps = cut(oriented(edges, "both"))
    near = cut(steps.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("n")))
    at = vertices(edges).select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), "id", F.lit(None).cast(dict(edges.dtypes)["source"]).alias("last"), F.array().cast(f"array<{dict(edges.dtypes)['source']}>").alias("ln"))
    out = at.select("start", "walk", F.lit(0).alias("step"), "id")
    for k in range(1, length):
        weight = lambda v: F.when(F.col("last").isNull(), 1.0).when(v == F.col("last"), 1 / p).when(F.array_contains("ln", v), 1.0).otherwise(1 / q)
        rows = at.join(near, at.id == near.u).withColumn("w", F.transform("n", weight))
        total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
        draw = F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(k)), F.lit(1 << 30)) / float(1 << 30) * total
        pick = F.aggregate(F.arrays_zip("n", "w"), F.struct(draw.alias("left"), F.lit(None).cast(dict(edges.dtypes)["source"]).alias("v")), lambda a, x: F.when(a["v"].isNotNull() | (a["left"] >= x["w"]), F.struct((a["left"] - x["w"]).alias("left"), a["v"].alias("v"))).otherwise(F.struct(a["left"].alias("left"), x["n"].alias("v"))))
        at = cut(rows.select("start", "walk", F.coalesce(pick["v"], F.element_at("n", -1)).alias("id2"), F.col("id").alias("last"), F.col("n").alias("ln")).withColumnRenamed("id2", "id"))
        out = out.union(at.select("start", "walk", F.lit(k), "id"))
    return out


def top_similar(edges: DataFrame, by: str, k: int) -> DataFrame:
    """(id, other, score, place): each node's ``k`` most similar nodes by a score of ``common_neighbors``, ties by id."""
    pairs = common_neighbors(edges).select("u", "v", F.col(by).alias("score"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("other")), F.struct(F.col("v").alias("id"), F.col("u").alias("other")))).alias("p"), "score").select("p.*", "score")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return both.withColumn("place", place).where(F.col("place") <= k)


def sampled_paths(edges: DataFrame, sources: int = 50, seed: int = 42) -> DataFrame:
    """(mean_path, diameter, pairs) over undirected distances from the ``sources`` nodes of least hash; of a graph
    with no more nodes than that, the exact figures."""
    starts = vertices(edges).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sources)
    return path_statistics(all_distances(edges, cut(starts), direction="both"), "depth")
