"""Spread of influence, checks of flows, and the census of all sixteen kinds of triads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import oriented, vertices
from lattica.session import cut, stored

#: Names of the triad kinds (fixed values).
TRIADS = ["003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300"]


def _chance(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def _seeds(edges: DataFrame, seeds: list) -> DataFrame:
    kind = dict(edges.dtypes)["source"]
    return edges.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(seeds)], f"id {kind}")


def threshold_spread(edges: DataFrame, seeds: list, simulations: int = 100, seed: int = 42) -> DataFrame:
    """Linear threshold: a node's threshold in a run is a hash of (seed, run, node); it joins once the share of its
    incoming weight that comes from active nodes reaches it. Gives the mean number of active nodes. Runs until no
    node joins; no seeds give 0. Parallel edges count with their largest weight."""
    links = edges.where("source <> target").groupBy("source", "target").agg(F.max("weight").alias("w"))
    total = links.groupBy("target").agg(F.sum("w").alias("t"))
    shares = cut(links.join(total, "target").select(F.col("source").alias("u"), F.col("target").alias("v"), F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("share")))
    runs = edges.sparkSession.range(simulations).withColumnRenamed("id", "run")
    active = cut(runs.crossJoin(F.broadcast(_seeds(edges, seeds))))
    while True:
        met = active.join(shares, active.id == shares.u).groupBy("run", F.col("v").alias("id")).agg(F.sum("share").alias("s"))
        fresh = cut(met.where(F.col("s") >= _chance(seed, "run", "id") - 1e-12).select("run", "id").join(active, ["run", "id"], "left_anti"))
        if not fresh.limit(1).count():
            break
        active = cut(active.union(fresh))
    return active.agg((F.count("*") / float(simulations)).alias("spread"))


def cascade_trace(edges: DataFrame, seeds: list, run: int = 0, seed: int = 42) -> DataFrame:
    """(round, id) of one run of the independent cascade, the seeds in round 0; an edge is live as in
    ``influence_spread``."""
    chance = _chance(seed, F.lit(run).cast("long"), "source", "target")
    live = cut(edges.where(chance < F.least("weight", F.lit(1.0))).select(F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    seen = front = cut(_seeds(edges, seeds).select(F.lit(0).alias("round"), "id"))
    step = 0
    while front.limit(1).count():
        step += 1
        reached = front.join(live, front.id == live.u).select(F.col("v").alias("id")).distinct()
        front = cut(reached.join(seen, "id", "left_anti").select(F.lit(step).alias("round"), "id"))
        seen = cut(seen.union(front))
    return seen


def greedy_seeds(edges: DataFrame, k: int, simulations: int = 100, seed: int = 42, most_pairs: int = 2_000_000_000) -> DataFrame:
    """(place, id, gain): greedy choice of seeds by the mean number of further nodes that a node reaches over the
    live edges of all runs, ties by the smaller id. What every node reaches in every run is made once; as that grows
    with the square of the nodes, its largest size is checked against ``most_pairs``."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["source"]
    nodes = cut(vertices(edges))
    if nodes.count() ** 2 * simulations > most_pairs:
        raise ValueError(f"greedy_seeds takes at most {most_pairs} (node, node, run) triples; degree_seeds has no bound")
    chance = _chance(seed, "run", "source", "target")
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long")))
    live = cut(edges.withColumn("run", runs).where(chance < F.least("weight", F.lit(1.0))).select("run", F.col("source").alias("u"), F.col("target").alias("v")).distinct())
    reach = front = stored(nodes.withColumn("run", runs).select("run", F.col("id").alias("s"), "id"))
    while True:
        ahead = front.alias("f").join(live.alias("l"), (F.col("f.run") == F.col("l.run")) & (F.col("f.id") == F.col("l.u"))).select("f.run", "f.s", F.col("l.v").alias("id")).distinct()
        front = stored(ahead.join(reach, ["run", "s", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        reach = stored(reach.union(front))
    chosen: list[tuple] = []
    for place in range(1, k + 1):
        gains = reach.where(~F.col("s").isin([c[1] for c in chosen])) if chosen else reach
        best = gains.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s").first()
        if best is None:
            left = nodes.where(~F.col("id").isin([c[1] for c in chosen])).orderBy("id").first()
            if left is None:
                break
            chosen.append((place, left["id"], 0.0))
            continue
        chosen.append((place, best["s"], best["n"] / simulations))
        covered = reach.where(F.col("s") == F.lit(best["s"])).select("run", "id")
        reach = stored(reach.join(covered, ["run", "id"], "left_anti"))
    return spark.createDataFrame(chosen, f"place int, id {kind}, gain double")


def total_flow(flow: DataFrame, source) -> DataFrame:
    """Sum of the positive flow (source, target, flow) that leaves a node; 0 where none does."""
    return flow.where((F.col("source") == F.lit(source)) & (F.col("flow") > 0)).agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("total"))


def flow_faults(flow: DataFrame, edges: DataFrame, source, sink, slack: float = 1e-9) -> DataFrame:
    """(rule, source, target, by): flows below 0 or above the summed capacity (``weight``) of their edges, and
    nodes but the two ends that receive and send different amounts (``source`` names the node). A valid flow has no rows."""
    kind = dict(edges.dtypes)["source"]
    room = edges.groupBy(F.col("source").alias("u"), F.col("target").alias("v")).agg(F.sum("weight").alias("room"))
    sent = flow.join(room, (F.col("source") == F.col("u")) & (F.col("target") == F.col("v")), "left")
    over = F.col("flow") - F.coalesce("room", F.lit(0.0))
    broken = sent.select(F.when(F.col("flow") < 0, "negative").when(over > slack, "capacity").alias("rule"), "source", "target", F.when(F.col("flow") < 0, F.col("flow")).otherwise(over).alias("by")).where("rule is not null")
    ends = flow.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("flow").alias("x")), F.struct(F.col("target").alias("id"), (-F.col("flow")).alias("x")))).alias("e")).select("e.*")
    kept = ends.where((F.col("id") != F.lit(source)) & (F.col("id") != F.lit(sink))).groupBy("id").agg(F.sum("x").alias("by")).where(F.abs("by") > slack)
    return broken.union(kept.select(F.lit("conservation"), F.col("id"), F.lit(None).cast(kind), "by"))


def flow_paths(flow: DataFrame, source, sink, most_edges: int = 200_000) -> DataFrame:
    """(rank, path, flow): simple paths from source to sink that carry the flow, each by its narrowest edge; the
    next edge is the smallest target with flow left. Sequential, so one task of checked size; circular flow is left."""
    used = flow.where("flow > 0").groupBy("source", "target").agg(F.sum("flow").alias("flow"))
    if used.count() > most_edges:
        raise ValueError(f"flow_paths takes at most {most_edges} edges with flow")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left: dict = {}
        for u, v, x in zip(pdf["source"], pdf["target"], pdf["flow"]):
            left.setdefault(u, {})[v] = float(x)
        found = []
        while True:
            came, stack = {}, [(source, None)]
            while stack and sink not in came:
                u, last = stack.pop()
                if u not in came:
                    came[u] = last
                    stack.extend((v, u) for v in sorted((v for v, x in left.get(u, {}).items() if x > 1e-12 and v not in came), reverse=True))
            if sink not in came or sink == source:
                break
            path = [sink]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            least = min(left[u][v] for u, v in zip(path, path[1:]))
            for u, v in zip(path, path[1:]):
                left[u][v] -= least
            found.append((len(found) + 1, path, least))
        return pd.DataFrame(found, columns=["rank", "path", "flow"])

    kind = dict(flow.dtypes)["source"]
    return used.groupBy(F.lit(1).alias("g")).applyInPandas(run, f"rank long, path array<{kind}>, flow double")


def triad_types(edges: DataFrame) -> DataFrame:
    """(type, n) for all sixteen standard triad kinds, absent ones with 0. Only triples with two linked pairs or more
    are made; those with fewer follow from the numbers of nodes and pairs. Letters as usual: D out of one node, U
    into one node, C a chain; 111D has its single link into the mutual pair."""
    links = cut(oriented(edges).where("u <> v"))
    pair = lambda u, v: (F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    pairs = cut(links.groupBy(*pair("u", "v")).agg(F.max(F.col("u") < F.col("v")).alias("up"), F.max(F.col("u") > F.col("v")).alias("down")))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    x, y = both.alias("x"), both.alias("y")
    wedges = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.sort_array(F.array("x.a", "x.b", "y.b")).alias("t")).distinct()
    sides = wedges.select("t", F.explode(F.array(*[F.struct(F.col("t")[i].alias("a"), F.col("t")[j].alias("b")) for i, j in ((0, 1), (0, 2), (1, 2))])).alias("p"))
    known = sides.select("t", "p.a", "p.b").join(pairs, ["a", "b"])
    mutual = F.col("up") & F.col("down")
    one = F.when(~mutual, F.struct(F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("d")))
    made = known.groupBy("t").agg(F.count_if(mutual).alias("m"), F.collect_list(one).alias("one"), F.max(F.when(mutual, F.array("a", "b"))).alias("pair"))
    m, n, outs, ins = F.col("m"), F.size("one"), F.size(F.array_distinct("one.s")), F.size(F.array_distinct("one.d"))
    letter = F.when(outs == 1, "D").when(ins == 1, "U").otherwise("C")
    kind = (
        F.when((m == 0) & (n == 2), F.concat(F.lit("021"), letter))
        .when((m == 0) & (n == 3), F.when(outs == 3, "030C").otherwise("030T"))
        .when((m == 1) & (n == 1), F.when(F.array_contains("pair", F.col("one.d")[0]), "111D").otherwise("111U"))
        .when((m == 1) & (n == 2), F.concat(F.lit("120"), letter))
        .when((m == 2) & (n == 0), "201").when((m == 2) & (n == 1), "210").otherwise("300")
    )
    kinds = cut(made.groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.sum(n).alias("s")))
    v = vertices(edges).agg(F.count("*").cast("decimal(38,0)").alias("v"))
    dyads = pairs.agg(F.count_if(mutual).cast("decimal(38,0)").alias("mutual"), F.count_if(~mutual).cast("decimal(38,0)").alias("single"))
    met = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    rest = v.crossJoin(dyads).crossJoin(met).select("*", (F.col("single") * (F.col("v") - 2) - F.col("s")).alias("n012"), (F.col("mutual") * (F.col("v") - 2) - F.col("m")).alias("n102"))
    empty = F.floor(F.col("v") * (F.col("v") - 1) * (F.col("v") - 2) / 6) - F.col("n") - F.col("n012") - F.col("n102")
    few = rest.select(F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.greatest(c, F.lit(0)).cast("long").alias("n")) for t, c in (("003", empty), ("012", F.col("n012")), ("102", F.col("n102")))])).alias("f")).select("f.*")
    names = edges.sparkSession.createDataFrame([(t,) for t in TRIADS], "type string")
    return names.join(kinds.select("type", "n").union(few), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
