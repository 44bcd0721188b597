"""Influence, flows, triads, migrations and draws on small inputs, against brute force where results are not plain."""

from __future__ import annotations

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lattica.functions import draws as R
from lattica.operators import spread as P
from lattica.operators.graph_algorithms import influence_spread
from lattica.operators.migration import Migrations


def edge_frame(spark, links, weight=1.0):
    return spark.createDataFrame([(u, v, float(w[0]) if w else weight) for u, v, *w in links], "source long, target long, weight double")


def test_spreads_reach_the_end_of_a_long_chain(spark):
    chain = edge_frame(spark, [(i, i + 1) for i in range(24)])
    assert influence_spread(chain, [0], 1).first()["spread"] == 25
    assert P.threshold_spread(chain, [0], 2).first()["spread"] == 25
    assert P.cascade_trace(chain, [0]).agg(F.max("round")).first()[0] == 24
    assert P.threshold_spread(chain, [], 2).first()["spread"] == 0


def test_greedy_seeds_cover_what_others_do_not(spark):
    stars = edge_frame(spark, [(0, i) for i in range(10, 15)] + [(1, i) for i in range(11, 16)] + [(2, 20), (2, 21)])
    assert [tuple(r) for r in P.greedy_seeds(stars, 3, 2).orderBy("place").collect()] == [(1, 0, 6.0), (2, 2, 3.0), (3, 1, 2.0)]
    with pytest.raises(ValueError):
        P.greedy_seeds(stars, 1, 2, most_pairs=10)


def test_triads_equal_enumeration(spark):
    draw = random.Random(3)
    links = {(u, v) for u, v in itertools.permutations(range(9), 2) if draw.random() < 0.3}
    names = dict.fromkeys(P.TRIADS, 0)
    for trio in itertools.combinations(range(9), 3):
        inside = [(u, v) for u, v in itertools.permutations(trio, 2) if (u, v) in links]
        mutual = {frozenset(e) for e in inside if e[::-1] in inside}
        single = [e for e in inside if e[::-1] not in inside]
        name = f"{len(mutual)}{len(single)}{3 - len(mutual) - len(single)}"
        if name in ("021", "120"):
            name += "D" if single[0][0] == single[1][0] else "U" if single[0][1] == single[1][1] else "C"
        elif name == "111":
            name += "D" if single[0][1] in next(iter(mutual)) else "U"
        elif name == "030":
            name += "C" if len({e[0] for e in single}) == 3 else "T"
        names[name] += 1
    assert {r["type"]: r["n"] for r in P.triad_types(edge_frame(spark, sorted(links))).collect()} == names


def test_flows_are_judged_and_taken_apart(spark):
    room = edge_frame(spark, [(0, 1, 3), (0, 2, 2), (1, 3, 2), (1, 2, 1), (2, 3, 3)])
    flow = room.withColumnRenamed("weight", "flow")
    assert P.flow_faults(flow, room, 0, 3).count() == 0
    assert P.total_flow(flow, 0).first()["total"] == 5 and P.total_flow(flow, 9).first()["total"] == 0
    paths = P.flow_paths(flow, 0, 3).collect()
    assert sum(r["flow"] for r in paths) == 5 and [r["path"] for r in paths][0] == [0, 1, 2, 3]
    bad = spark.createDataFrame([(0, 1, 4.0), (1, 3, -1.0), (5, 6, 1.0)], "source long, target long, flow double")
    assert sorted(r["rule"] for r in P.flow_faults(bad, room, 0, 3).collect()) == ["capacity", "capacity", "conservation", "conservation", "conservation", "negative"]


def test_migrations_take_the_shortest_chain(spark):
    add = lambda n: lambda df: df.withColumn("x", F.col("x") + n)
    plan = Migrations().step("a", "b", add(1)).step("b", "c", add(10)).step("c", "d", add(100)).step("a", "c", add(1000)).rule("d", F.col("x") > 111)
    assert plan.path("a", "d") == ["a", "c", "d"] and plan.path("d", "a") is None and plan.path("b", "b") == ["b"]
    rows = spark.createDataFrame([(0, "a"), (0, "b"), (5, "d")], "x long, v string")
    made = plan.migrate_mixed(rows, "v", ["a", "b", "d"], "d")
    assert sorted(tuple(r) for r in made.collect()) == [(5, "d"), (110, "d"), (1100, "d")]
    assert sorted(r["x"] for r in plan.valid(made, "d").collect()) == [1100]
    with pytest.raises(ValueError):
        plan.migrate(rows, "d", "a")


def test_draws_have_their_moments_and_ignore_partitions(spark):
    made = lambda n: spark.range(4000, numPartitions=n).select("id", R.uniform(1, "id").alias("u"), R.normal(1, "id", mean=5.0, deviation=2.0).alias("g"), R.exponential(1, "id", rate=4.0).alias("e"), R.poisson(1, "id", mean=3.0).alias("p"), R.choice(1, ["a", "b"], "id", weights=[1.0, 3.0]).alias("c"))
    rows = made(3).orderBy("id").collect()
    assert rows == made(7).orderBy("id").collect()
    mean = lambda c: statistics.fmean(r[c] for r in rows)
    assert mean("u") == pytest.approx(0.5, abs=0.03) and mean("g") == pytest.approx(5, abs=0.2) and mean("e") == pytest.approx(0.25, abs=0.03) and mean("p") == pytest.approx(3, abs=0.2)
    assert statistics.pstdev(r["g"] for r in rows) == pytest.approx(2, abs=0.15)
    assert sum(r["c"] == "b" for r in rows) / 4000 == pytest.approx(0.75, abs=0.04)
