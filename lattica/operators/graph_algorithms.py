"""Graph algorithms over (source, target, weight) edges as loops of joins and combined aggregates.

Adjacency is distinct unless weights count. Kernels that are sequential by nature (flow, partitioning) run in
one task per component and check a stated size first.
"""

from __future__ import annotations

import heapq
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import all_distances, degrees, oriented, undirected, vertices
from lattica.session import cut


# ---- centrality -----------------------------------------------------------------------------------------


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, redistribute: bool = False) -> DataFrame:
    """(id, rank); dangling mass is lost unless ``redistribute``. Without a tolerance all rounds run."""
    steps = oriented(edges)
    out = steps.groupBy("u").agg(F.count("*").alias("d"))
    links = cut(steps.join(out, "u"))
    nodes = cut(vertices(edges))
    n = max(nodes.count(), 1)
    ranks = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        got = links.join(ranks, links.u == ranks.id).groupBy("v").agg(F.sum(F.col("rank") / F.col("d")).alias("got"))
        base = (1 - damping) / n
        if redistribute:
            base = F.lit(base) + damping / n * (1 - F.coalesce(got.agg(F.sum("got").alias("g")).select("g").scalar(), F.lit(0.0)))
        new = ranks.join(got, ranks.id == got.v, "left").select("id", F.col("rank").alias("old"), (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tolerance is not None:
            new = cut(new)
            change = new.agg(F.max(F.abs(F.col("rank") - F.col("old"))).alias("c")).first()["c"]
        elif k % 5 == 4:
            new = cut(new)
        ranks = new.select("id", "rank")
        if tolerance is not None and (change or 0) < tolerance:
            break
    return ranks


def _normalised(df: DataFrame, column: str) -> DataFrame:
    norm = F.sqrt(df.agg(F.sum(F.col(column) * F.col(column)).alias("s")).select("s").scalar())
    return df.withColumn(column, F.when(norm > 0, F.col(column) / norm).otherwise(0.0))


def hits(edges: DataFrame, rounds: int = 20, weighted: bool = False) -> DataFrame:
    """(id, hub, authority), L2-normalised each round; authorities first, hubs from the new authorities."""
    links = cut(edges.groupBy(F.col("source").alias("u"), F.col("target").alias("v")).agg(F.sum("weight").alias("w")) if weighted else oriented(edges).withColumn("w", F.lit(1.0)))
    nodes = cut(vertices(edges))
    hubs, authorities = nodes.select("id", F.lit(1.0).alias("hub")), nodes.select("id", F.lit(1.0).alias("authority"))
    for _ in range(rounds):
        got = links.join(hubs, links.u == hubs.id).groupBy("v").agg(F.sum(F.col("hub") * F.col("w")).alias("x"))
        authorities = cut(_normalised(nodes.join(got, nodes.id == got.v, "left").select("id", F.coalesce("x", F.lit(0.0)).alias("authority")), "authority"))
        sent = links.join(authorities, links.v == authorities.id).groupBy("u").agg(F.sum(F.col("authority") * F.col("w")).alias("x"))
        hubs = cut(_normalised(nodes.join(sent, nodes.id == sent.u, "left").select("id", F.coalesce("x", F.lit(0.0)).alias("hub")), "hub"))
    return hubs.join(authorities, "id")


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Power iteration over in-neighbours, L2-normalised."""
    links, nodes = cut(oriented(edges)), cut(vertices(edges))
    scores = nodes.select("id", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        got = links.join(scores, links.u == scores.id).groupBy("v").agg(F.sum("score").alias("x"))
        scores = cut(_normalised(nodes.join(got, nodes.id == got.v, "left").select("id", F.coalesce("x", F.lit(0.0)).alias("score")), "score"))
    return scores


def closeness(edges: DataFrame, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """Closeness r/sum(d) * r/(n-1), harmonic sum(1/d)/(n-1) and Lin's r^2/((n-1) sum(d))."""
    nodes = cut(vertices(edges))
    n = max(nodes.count() - 1, 1)
    far = all_distances(edges, nodes, max_depth, direction).groupBy("source").agg(F.count("*").alias("r"), F.sum("depth").alias("s"), F.sum(1 / F.col("depth")).alias("h"))
    out = nodes.join(far, nodes.id == far.source, "left").fillna(0, ["r", "s", "h"])
    ratio = F.when(F.col("s") > 0, F.col("r") / F.col("s")).otherwise(0.0)
    return out.select("id", (ratio * F.col("r") / n).alias("closeness"), (F.col("h") / n).alias("harmonic"), (ratio * F.col("r") / n).alias("lin"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, max_depth: int | None = None, normalised: bool = True) -> DataFrame:
    """Brandes over all sources (or some, scaled): path counts level by level, then dependencies back."""
    steps, nodes = cut(oriented(edges)), cut(vertices(edges))
    n = nodes.count()
    chosen = cut(sources if sources is not None else nodes)
    scale = n / max(chosen.count(), 1) / (((n - 1) * (n - 2)) if normalised and n > 2 else 1)
    front = chosen.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma"))
    seen, levels = front.select("s", "id"), [front]
    for _ in count() if max_depth is None else range(max_depth):
        new = front.join(steps, F.col("id") == F.col("u")).join(seen.select("s", F.col("id").alias("v")), ["s", "v"], "left_anti").groupBy("s", "v").agg(F.sum("sigma").alias("sigma"))
        front = cut(new.select("s", F.col("v").alias("id"), "sigma"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = cut(seen.union(front.select("s", "id")))
    below = levels[-1].withColumn("delta", F.lit(0.0))
    total = None
    for level in reversed(levels[:-1]):
        b = below.select("s", F.col("id").alias("v"), F.col("sigma").alias("sv"), "delta")
        part = level.join(steps, F.col("id") == F.col("u")).join(b, ["s", "v"]).groupBy("s", "id").agg(F.sum(F.col("sigma") / F.col("sv") * (1 + F.col("delta"))).alias("delta"))
        below = cut(level.join(part, ["s", "id"], "left").select("s", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        add = below.where("s <> id").groupBy("id").agg(F.sum("delta").alias("b"))
        total = add if total is None else total.union(add)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    summed = total.groupBy("id").agg(F.sum("b").alias("b"))
    return nodes.join(summed, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


# ---- motifs ---------------------------------------------------------------------------------------------


def _ranked(edges: DataFrame) -> DataFrame:
    """Undirected pairs directed from the lower to the higher degree, so that wedges stay few at hubs."""
    pairs = cut(undirected(edges))
    d = pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = pairs.join(d.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
    low = F.struct("du", "u") < F.struct("dv", "v")
    return cut(both.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("b")))


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once, as x < y < z."""
    e = _ranked(edges)
    wedges = e.alias("p").join(e.alias("q"), (F.col("p.a") == F.col("q.a")) & (F.col("p.b") != F.col("q.b"))).select(F.col("p.a").alias("o"), F.col("p.b").alias("a"), F.col("q.b").alias("b"))
    found = wedges.join(e, ["a", "b"]).select(F.sort_array(F.array("o", "a", "b")).alias("t")).distinct()
    return found.select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


def triangle_counts(edges: DataFrame) -> DataFrame:
    """(id, triangles, clustering) of every vertex with an undirected neighbour."""
    per = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d = undirected(edges).select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    t = F.coalesce("t", F.lit(0))
    return d.join(per, "id", "left").select("id", t.alias("triangles"), F.when(F.col("d") > 1, 2 * t / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def motif_profile(edges: DataFrame) -> DataFrame:
    """Triangles, wedges, 3T/wedges and stars by undirected degree."""
    d = undirected(edges).select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    w = d.agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("wedges"), F.floor(F.sum("d") / 2).alias("paths"), F.count_if(F.col("d") >= 2).alias("stars"))
    t = triangles(edges).agg(F.count("*").alias("triangles"))
    return w.crossJoin(t).select("triangles", "wedges", "paths", "stars", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(0.0).alias("transitivity"))


def squares(edges: DataFrame) -> DataFrame:
    """C(common, 2) summed over non-adjacent pairs."""
    c = common_neighbors(edges)
    linked = undirected(edges)
    return c.join(linked, ["u", "v"], "left_anti").agg(F.coalesce(F.sum(F.col("common") * (F.col("common") - 1) / 2), F.lit(0.0)).cast("long").alias("squares"))


# ---- similarity and link prediction ---------------------------------------------------------------------


def common_neighbors(edges: DataFrame) -> DataFrame:
    """All link-prediction scores of pairs u < v with a common undirected neighbour."""
    pairs = cut(undirected(edges))
    steps = cut(pairs.union(pairs.select("v", "u")))
    d = cut(steps.groupBy("u").agg(F.count("*").alias("d")))
    middle = steps.join(d, "u").select(F.col("u").alias("m"), F.col("v").alias("x"), F.col("d").alias("dm"))
    wedges = middle.alias("a").join(middle.alias("b"), (F.col("a.m") == F.col("b.m")) & (F.col("a.x") < F.col("b.x"))).select(F.col("a.x").alias("u"), F.col("b.x").alias("v"), F.col("a.dm").alias("dm"))
    sums = wedges.groupBy("u", "v").agg(F.count("*").alias("common"), F.sum(F.when(F.col("dm") > 1, 1 / F.log("dm")).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / F.col("dm")).alias("resource_allocation"))
    both = sums.join(d.withColumnRenamed("d", "du"), "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    return both.select("u", "v", "common", "adamic_adar", "resource_allocation", (F.col("common") / (F.col("du") + F.col("dv") - F.col("common"))).alias("jaccard"), (F.col("du") * F.col("dv")).alias("preferential"))


def predict_links(edges: DataFrame, by: str, k: int) -> DataFrame:
    """The best unlinked pairs by one score."""
    return common_neighbors(edges).join(undirected(edges), ["u", "v"], "left_anti").select("u", "v", F.col(by).alias("score")).orderBy(F.desc("score"), "u", "v").limit(k)


def ensemble_links(edges: DataFrame, by: list[str], k: int) -> DataFrame:
    """Mean of scores, each divided by its largest."""
    scored = cut(common_neighbors(edges).join(undirected(edges), ["u", "v"], "left_anti"))
    tops = scored.agg(*[F.max(b).alias(f"_{b}") for b in by])
    mean = sum((F.col(b) / F.col(f"_{b}") for b in by), F.lit(0.0)) / len(by)
    return scored.crossJoin(F.broadcast(tops)).select("u", "v", mean.alias("score")).orderBy(F.desc("score"), "u", "v").limit(k)


def katz(edges: DataFrame, beta: float = 0.005, hops: int = 5) -> DataFrame:
    """Sum over hops of beta^k times the number of walks between pairs u < v."""
    pairs = undirected(edges)
    steps = cut(pairs.union(pairs.select("v", "u")))
    walks, total = steps.select("u", "v", F.lit(1.0).alias("w")), None
    for k in range(1, hops + 1):
        part = walks.select("u", "v", (F.col("w") * beta**k).alias("katz"))
        total = part if total is None else total.union(part)
        if k < hops:
            walks = cut(walks.alias("a").join(steps.alias("b"), F.col("a.v") == F.col("b.u")).groupBy(F.col("a.u").alias("u"), F.col("b.v").alias("v")).agg(F.sum("w").alias("w")))
    return total.where("u < v").groupBy("u", "v").agg(F.sum("katz").alias("katz"))


def simrank(edges: DataFrame, decay: float = 0.8, rounds: int = 5) -> DataFrame:
    """Pairs whose in-neighbours are similar; (u, u) is 1."""
    steps, nodes = cut(oriented(edges)), cut(vertices(edges))
    into = cut(steps.groupBy("v").agg(F.count("*").alias("d")))
    same = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("s"))
    scores = same
    for _ in range(rounds):
        x = scores.join(steps.select(F.col("u").alias("a"), F.col("v").alias("p")), "a").groupBy("p", "b").agg(F.sum("s").alias("s"))
        y = x.join(steps.select(F.col("u").alias("b"), F.col("v").alias("q")), "b").where("p <> q").groupBy("p", "q").agg(F.sum("s").alias("s"))
        y = y.join(into.select(F.col("v").alias("p"), F.col("d").alias("dp")), "p").join(into.select(F.col("v").alias("q"), F.col("d").alias("dq")), "q")
        scores = cut(y.select(F.col("p").alias("a"), F.col("q").alias("b"), (decay * F.col("s") / (F.col("dp") * F.col("dq"))).alias("s")).union(same))
    return scores


# ---- components, communities, trees, orders -------------------------------------------------------------


def weak_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id reachable when directions are ignored."""
    labels = cut((nodes.select("id") if nodes is not None else vertices(edges)).distinct().select("id", F.col("id").alias("component")))
    steps = cut(oriented(edges, "both"))
    while True:
        near = steps.join(labels, steps.v == labels.id).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near, labels.id == near.u, "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("low"))
        up = labels.select(F.col("id").alias("at"), F.col("component").alias("jump"))
        moved = cut(low.join(up, low.low == up["at"], "left").select("id", F.least("low", F.coalesce("jump", "low")).alias("next"), "component"))
        labels = moved.select("id", F.col("next").alias("component"))
        if not moved.where("next <> component").limit(1).count():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) by colouring: the smallest forward colour, then backward reach within a colour."""
    steps = cut(oriented(edges).where("u <> v"))
    left = cut(vertices(edges))
    done: DataFrame | None = None
    while left.limit(1).count():
        live = cut(steps.join(left.select(F.col("id").alias("u")), "u", "left_semi").join(left.select(F.col("id").alias("v")), "v", "left_semi"))
        colour = left.select("id", F.col("id").alias("c"))
        while True:
            got = live.join(colour, live.u == colour.id).groupBy("v").agg(F.min("c").alias("m"))
            new = cut(colour.join(got, colour.id == got.v, "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n")))
            colour = new.select("id", F.col("n").alias("c"))
            if not new.where("n <> c").limit(1).count():
                break
        colour = cut(colour)
        inside = cut(live.join(colour.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv"))
        reached = cut(colour.where("id = c"))
        front = reached
        while True:
            front = cut(inside.join(front.select(F.col("id").alias("v")), "v").select(F.col("u").alias("id"), F.col("cu").alias("c")).distinct().join(reached.select("id"), "id", "left_anti"))
            if not front.limit(1).count():
                break
            reached = cut(reached.union(front))
        part = reached.select("id", F.col("c").alias("component"))
        done = part if done is None else done.union(part)
        left = cut(left.join(reached.select("id"), "id", "left_anti"))
    smallest = done.groupBy("component").agg(F.min("id").alias("low"))
    return done.join(smallest, "component").select("id", F.col("low").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Synchronous: every node takes its neighbours' most frequent label, ties the smallest."""
    steps, labels = cut(oriented(edges, "both").where("u <> v")), vertices(edges).select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = steps.join(labels, steps.v == labels.id).groupBy("u", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("u").agg(F.max(F.struct(F.col("n"), (-F.col("label")).alias("neg"))).alias("b"))
        labels = cut(labels.join(best, labels.id == best.u, "left").select("id", F.coalesce(-F.col("b.neg"), "label").alias("label")))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Contribution of each community: internal/(2E) - (degree/(2E))^2 over distinct undirected neighbours."""
    steps = oriented(edges, "both")
    of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    joined = steps.join(of("u"), "u").join(of("v"), "v")
    two = 2.0 * edges.count() or 1.0
    sums = joined.groupBy(F.col("lu").alias("label")).agg(F.count_if(F.col("lu") == F.col("lv")).alias("i"), F.count("*").alias("d"))
    return sums.select("label", (F.col("i") / two - F.pow(F.col("d") / two, 2)).alias("modularity"))


def spanning_forest(edges: DataFrame, maximum: bool = False) -> DataFrame:
    """Boruvka: each component takes its cheapest outgoing edge until none is left; ties by endpoints."""
    sign = -1 if maximum else 1
    e = cut(edges.where("source <> target").groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.min(sign * F.col("weight")).alias("w")))
    labels = vertices(edges).select("id", F.col("id").alias("c"))
    picked: DataFrame | None = None
    while True:
        of = lambda x, labels=labels: labels.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
        cross = e.join(of("u"), "u").join(of("v"), "v").where("cu <> cv")
        best = cross.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("w", "u", "v").alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        new = cut(best.select("e.u", "e.v", "e.w").distinct())
        if not new.limit(1).count():
            break
        picked = new if picked is None else cut(picked.union(new))
        labels = weak_components(picked.select(F.col("u").alias("source"), F.col("v").alias("target")), vertices(edges)).withColumnRenamed("component", "c")
    if picked is None:
        return e.limit(0)
    return picked.select("u", "v", (sign * F.col("w")).alias("weight"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(id, level) by peeling sources; nodes on or behind cycles are missing, so a shorter result means a cycle."""
    steps, left = cut(oriented(edges)), cut(vertices(edges))
    out, k = None, 0
    while True:
        sources = cut(left.join(steps.select(F.col("v").alias("id")), "id", "left_anti"))
        if not sources.limit(1).count():
            break
        part = sources.select("id", F.lit(k).alias("level"))
        out = part if out is None else out.union(part)
        left = cut(left.join(sources, "id", "left_anti"))
        steps = cut(steps.join(sources.select(F.col("id").alias("u")), "u", "left_anti"))
        k += 1
    return out if out is not None else left.limit(0).select("id", F.lit(0).alias("level"))


def weighted_distances(edges: DataFrame, start, max_rounds: int | None = None) -> DataFrame:
    """Bellman-Ford relaxation: (id, distance, path) for non-negative weights; unreachable nodes are missing."""
    e = cut(edges.groupBy("source", "target").agg(F.min("weight").alias("w")))
    best = e.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0.0).alias("distance"), F.array(F.lit(start)).alias("path"))
    for _ in count() if max_rounds is None else range(max_rounds):
        more = best.join(e, best.id == e.source).where(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), F.concat("path", F.array("target")).alias("path"))
        new = cut(best.withColumn("old", F.lit(True)).unionByName(more.withColumn("old", F.lit(False))).groupBy("id").agg(F.min(F.struct("distance", "path")).alias("m"), F.min(F.when(F.col("old"), F.col("distance"))).alias("had")))
        best = new.select("id", "m.distance", "m.path")
        if not new.where("had is null or m.distance < had").limit(1).count():
            break
    return best


def all_pairs(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """Min-plus squaring: weighted distances between all pairs up to 2^rounds hops."""
    d = cut(edges.where("source <> target").groupBy(F.col("source").alias("u"), F.col("target").alias("v")).agg(F.min("weight").alias("d")))
    for _ in range(rounds):
        two = d.alias("a").join(d.alias("b"), F.col("a.v") == F.col("b.u")).where("a.u <> b.v").select(F.col("a.u").alias("u"), F.col("b.v").alias("v"), (F.col("a.d") + F.col("b.d")).alias("d"))
        new = cut(d.union(two).groupBy("u", "v").agg(F.min("d").alias("d")))
        changed = new.join(d.withColumnRenamed("d", "o"), ["u", "v"], "left").where("o is null or d < o").limit(1).count()
        d = new
        if not changed:
            break
    return d


# ---- walks and kernels ----------------------------------------------------------------------------------


def random_walks(edges: DataFrame, length: int, per_node: int, seed: int = 42) -> DataFrame:
    """(start, walk, step, id): each step takes the neighbour that a hash of (seed, walk, step) picks."""
    near = cut(oriented(edges, "both").groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("n")))
    at = vertices(edges).select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"), "id")
    out = at.select("start", "walk", F.lit(0).alias("step"), "id")
    for k in range(1, length):
        pick = F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(k)), F.size("n")).cast("int")
        at = cut(at.join(near, at.id == near.u).select("start", "walk", F.element_at("n", pick + 1).alias("id")))
        out = out.union(at.select("start", "walk", F.lit(k), "id"))
    return out


def walk_pairs(walks: DataFrame, window: int = 5) -> DataFrame:
    """How often two nodes stand at most ``window`` steps apart in a walk."""
    a, b = walks.alias("a"), walks.alias("b")
    near = (F.col("a.start") == F.col("b.start")) & (F.col("a.walk") == F.col("b.walk")) & (F.col("b.step") > F.col("a.step")) & (F.col("b.step") <= F.col("a.step") + window)
    return a.join(b, near).groupBy(F.col("a.id").alias("u"), F.col("b.id").alias("v")).agg(F.count("*").alias("n"))


def _augment(capacity: dict, s, t) -> float:
    """Edmonds-Karp on a residual network."""
    flow = 0.0
    while True:
        came, queue = {s: None}, [s]
        for u in queue:
            for v in sorted(capacity.get(u, {})):
                if v not in came and capacity[u][v] > 1e-12:
                    came[v] = u
                    queue.append(v)
        if t not in came:
            return flow
        path, v = [], t
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        step = min(capacity[u][v] for u, v in path)
        for u, v in path:
            capacity[u][v] -= step
            capacity.setdefault(v, {}).setdefault(u, 0.0)
            capacity[v][u] += step
        flow += step


def max_flow(edges: DataFrame, source, sink, most_edges: int = 1_000_000) -> DataFrame:
    """(flow, cut_size) of one source and sink; a kernel of one task that checks the size of the network."""
    summed = edges.groupBy("source", "target").agg(F.sum("weight").alias("c"))
    if summed.count() > most_edges:
        raise ValueError(f"max_flow takes networks of at most {most_edges} edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity: dict = {}
        for u, v, c in zip(pdf["source"], pdf["target"], pdf["c"]):
            capacity.setdefault(u, {})[v] = float(c)
        original = {u: dict(x) for u, x in capacity.items()}
        flow = _augment(capacity, source, sink)
        reach, queue = {source}, [source]
        for u in queue:
            for v, c in capacity.get(u, {}).items():
                if c > 1e-12 and v not in reach:
                    reach.add(v)
                    queue.append(v)
        crossing = sum(1 for u in reach for v in original.get(u, {}) if v not in reach)
        return pd.DataFrame({"flow": [flow], "cut_size": [crossing]})

    return summed.groupBy(F.lit(1).alias("g")).applyInPandas(run, "flow double, cut_size long")


def k_shortest(edges: DataFrame, start, end, k: int, most_edges: int = 1_000_000) -> DataFrame:
    """(rank, cost, path) of the k cheapest loopless paths: best-first expansion in one task, size checked."""
    cheapest = edges.where("source <> target").groupBy("source", "target").agg(F.min("weight").alias("w"))
    if cheapest.count() > most_edges:
        raise ValueError(f"k_shortest takes graphs of at most {most_edges} edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, v, w in zip(pdf["source"], pdf["target"], pdf["w"]):
            near.setdefault(u, []).append((v, float(w)))
        back: dict = {}
        for u, v, w in zip(pdf["source"], pdf["target"], pdf["w"]):
            back.setdefault(v, []).append((u, float(w)))
        left, heap = {}, [(0.0, end)]
        while heap:  # exact remaining cost, so that expansion is best first
            d, u = heapq.heappop(heap)
            if u not in left:
                left[u] = d
                for v, w in back.get(u, []):
                    heapq.heappush(heap, (d + w, v))
        heap, found = [(left[start], 0.0, [start])] if start in left else [], []
        while heap and len(found) < k:
            _, cost, path = heapq.heappop(heap)
            if path[-1] == end:
                found.append((len(found) + 1, cost, path))
                continue
            for v, w in near.get(path[-1], []):
                if v in left and v not in path:
                    heapq.heappush(heap, (cost + w + left[v], cost + w, [*path, v]))
        return pd.DataFrame(found, columns=["rank", "cost", "path"])

    kind = dict(edges.dtypes)["source"]
    return cheapest.groupBy(F.lit(1).alias("g")).applyInPandas(run, f"rank long, cost double, path array<{kind}>")


def cut_metrics(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Cut size, cut weight and balance (largest part over the mean) of an assignment (id, part)."""
    of = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"p{c}"))
    crossing = edges.join(of("source"), "source").join(of("target"), "target").where("psource <> ptarget").agg(F.count("*").alias("cut"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cut_weight"))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).agg((F.max("n") / F.avg("n")).alias("balance"))
    return crossing.crossJoin(sizes)


def influence_spread(edges: DataFrame, seeds: list, simulations: int = 100, seed: int = 42) -> DataFrame:
    """Independent cascade: an edge is live in a run if a hash of (seed, run, edge) falls under its weight (1 at
    most); the mean number of nodes that the seeds reach over live edges."""
    spark = edges.sparkSession
    runs = spark.range(simulations).withColumnRenamed("id", "run")
    chance = F.pmod(F.xxhash64(F.lit(seed), "run", "source", "target"), F.lit(1 << 30)) / float(1 << 30)
    live = cut(edges.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).where(chance < F.least(F.col("weight"), F.lit(1.0))).select("run", F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    front = runs.select("run", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("id"))
    seen = front
    while True:
        front = cut(front.join(live, (front.run == live.run) & (front.id == live.u)).select(front.run, F.col("v").alias("id")).distinct().join(seen, ["run", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen.groupBy("run").agg(F.count("*").alias("n")).agg(F.avg("n").alias("spread"))


def degree_seeds(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).select("id", "out_degree").orderBy(F.desc("out_degree"), "id").limit(k)


def rank_nodes(scores: DataFrame, by: str, k: int) -> DataFrame:
    """The k best with 1-based ranks, ties by id."""
    top = scores.orderBy(F.desc(by), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "id")).cast("long"))  # k rows
