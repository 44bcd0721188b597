"""Running aggregates over sorted ranges, codes, template filters and graph paths against plain versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lattica.functions import filters
from lattica.operators import more_graph, records
from lattica.operators.dataflow import Flow


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max"])
def test_running_equals_a_plain_loop(spark, kind):
    values = [None if i % 7 == 3 else (i * 37) % 101 - 50 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(5)
    got = {r["i"]: r["x"] for r in Flow(df, ("i",)).running("x", "v", kind).df.collect()}
    seen: list[int] = []
    for i, v in enumerate(values):
        seen += [] if v is None else [v]
        assert got[i] == {"sum": sum, "count": len, "min": min, "max": max}[kind](seen), (i, kind)


def test_running_of_nothing_and_of_leading_nulls(spark):
    assert Flow(spark.createDataFrame([], "i long, v long"), ("i",)).running("x", "v").df.count() == 0
    nulls = spark.createDataFrame([(i, None) for i in range(20)], "i long, v long")
    assert {r["x"] for r in Flow(nulls, ("i",)).running("x", "v").df.collect()} == {None}


def test_codes_follow_frequency_then_value(spark):
    df = spark.createDataFrame([(c,) for c in "bbaaccc" + "d"], "v string")
    assert sorted(tuple(r) for r in records.dictionary_codes(df, "v").select("code", "value", "n").collect()) == [(0, "c", 3), (1, "a", 2), (2, "b", 2), (3, "d", 1)]


def test_filters_chain_and_treat_nulls_as_empty(spark):
    df = spark.createDataFrame([("  It's <b>a_b</b>  c ", -2.5, [3, 10, None]), (None, None, None)], "t string, x double, a array<int>")
    scope = {"t": F.col("t"), "x": F.col("x"), "a": F.col("a")}
    shown = df.select(filters.render("{{ t|trim|escape }};{{t | slugify}};{{ x | round }};{{ a | sort | join('|') }};{{ t | default('no }') }};{{ t | title | wordcount }}", scope).alias("s"))
    assert [r["s"] for r in shown.collect()] == ["It&#39;s &lt;b&gt;a_b&lt;/b&gt;  c;its-ba-bb-c;-2.0;10|3|;  It's <b>a_b</b>  c ;3", ";;;;no };0"]
    with pytest.raises(ValueError, match="nothing"):
        filters.render("{{ t | nothing }}", scope)


def test_paths_of_a_chain_and_of_two_parts(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(100, 101)], "source long, target long").withColumn("weight", F.lit(1.0)).withColumn("type", F.lit("x"))
    r = more_graph.sampled_paths(chain).first()
    pairs = [abs(a - b) for a in range(7) for b in range(7) if a != b] + [1, 1]
    assert (r["diameter"], r["pairs"]) == (6, len(pairs)) and abs(r["mean_path"] - sum(pairs) / len(pairs)) < 1e-9
    best = {(x["id"], x["other"]) for x in more_graph.top_similar(chain, "jaccard", 1).collect()}
    assert (0, 2) in best and (6, 4) in best and not {i for i, _ in best} & {100, 101}
