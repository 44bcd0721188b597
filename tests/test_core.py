"""Operators on small frames with hand-made results: null keys, ties, duplicates, empty inputs, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lattica.functions import scalar as X
from lattica.functions import text as N
from lattica.operators import dedup as D
from lattica.operators import graph as G
from lattica.operators import graph_algorithms as A
from lattica.operators import joins as J
from lattica.operators import predicates as P
from lattica.operators import sets as S
from lattica.operators import timeseries as TS
from lattica.operators import windows as W
from lattica.operators.builder import Query
from lattica.operators.dataflow import Flow
from lattica.sources import readers as R
from lattica.sources import sinks as K
from lattica.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edge_frame(spark, pairs):
    return spark.createDataFrame([(i, a, b, "t", float(w)) for i, (a, b, *w) in enumerate((*p, 1)[:3] for p in pairs) for w in w[:1]], "id long, source long, target long, type string, weight double")


def test_null_keys_join_each_other(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "id int, k int")
    b = spark.createDataFrame([(None, "x"), (None, "y"), (5, "z")], "k2 int, v string")
    assert J.equi_join(a, b, [("k", "k2")]).count() == 3
    assert J.equi_join(a.where("id = 3"), b, [("k", "k2")], "left").count() == 0


def test_many_to_many_merge_join(spark):
    left = spark.createDataFrame([(1,), (1,)], "id int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id2 int, v string")
    assert J.equi_join(left, right, [("id", "id2")], hint="merge").count() == 4


def test_predicates_escape_and_group(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("%",)], "s string")
    assert rows(df.where(P.contains("s", "_"))) == [("a_b",)] and df.where(P.starts_with("s", "%")).count() == 1
    assert df.where(P.contains("s", "_", wildcards=True)).count() == 3
    assert df.where(P.in_list("s", [])).count() == 0 and df.where(P.not_in_list("s", [])).count() == 3
    n = spark.range(10)
    assert n.where(P.flat([("or", F.col("id") == 1), ("or", F.col("id") > 5), ("and", F.col("id") < 8)])).count() == 3


def test_builder_is_immutable_and_orders_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, 1)], "id int, v int")
    base = Query(df)
    assert [r.id for r in base.order_by("v").build().collect()] == [3, 2, 1]
    assert [r.id for r in base.order_by("v", "desc").build().collect()] == [1, 2, 3]
    assert base.where_null("v").build().count() == 1 and base.build().count() == 3


def test_windows_from_the_first_event(spark):
    df = spark.createDataFrame([(1, 7), (2, 57), (3, 107), (4, 157), (5, 207)], "v int, ts long")
    got = W.tumbling(df, "ts", 100).groupBy("window_start").agg(F.sort_array(F.collect_list("v")).alias("v"))
    assert rows(got) == [(7, [1, 2]), (107, [3, 4]), (207, [5])]
    s = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 21, 3)], "k string, ts long, id long")
    assert W.session_bounds(s, "ts", 10, ["k"], ["id"]).count() == 3
    assert rows(W.dedupe_events(spark.createDataFrame([("a", t, t) for t in (0, 300, 600, 900)], "k string, ts long, id long"), "ts", 500, ["k"], ["id"]).select("id")) == [(0,), (600,)]


def test_sliding_windows_end_with_the_last_open_one(spark):
    df = spark.createDataFrame([(0,), (5,), (12,)], "ts long")
    got = W.sliding(df, "ts", 10, 5).groupBy("window_start", "window_end").agg(F.count("*").alias("n"))
    assert rows(got) == [(-5, 5, 1), (0, 10, 2), (5, 15, 2)]


def test_gaps_rates_and_averages(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 30, 3.0), ("a", 200, 9.0)], "k string, ms long, value double")
    assert rows(TS.fill_gaps(df, 10, ["k"]).where("filled").select("ms", "value")) == [(10, 1.0), (20, 2.0)]
    assert [r[0] for r in rows(TS.exponential_average(df, 0.5, ["k"], ["ms"]).select("ema"))] == [0.0, 1.5, 5.25]
    assert TS.summary(df.limit(0)).first()["avg"] == 0.0
    assert rows(TS.rate(df, 100, 10, ["k"]).select("ms", "rate")) == [(30, 1.0), (200, pytest.approx(6 / 170 * 10))]


def test_set_operations_keep_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(S.intersection(a, b, ["k"])) == [(1,), (1,)] and rows(S.difference(a, b, ["k"])) == [(2,)]
    assert rows(S.first_by(spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k int, v string, o int"), ["k"], ["o"])) == [(1, "a", 1)]


def test_graph_corner_cases(spark):
    cycle = edge_frame(spark, [(0, 1), (1, 2), (2, 0)])
    ranks = [r["rank"] for r in A.page_rank(cycle).collect()]
    assert ranks == pytest.approx([1 / 3] * 3, abs=1e-3)
    assert rows(A.strong_components(edge_frame(spark, [(0, 1), (1, 0), (1, 2)]))) == [(0, 0), (1, 0), (2, 2)]
    assert A.topological_levels(cycle).count() == 0
    loops = edge_frame(spark, [(0, 0), (0, 1), (0, 1)])
    assert rows(G.degrees(loops)) == [(0, 1, 3, 4), (1, 2, 0, 2)] and A.triangles(loops).count() == 0
    assert A.spanning_forest(edge_frame(spark, [(0, 1, 5), (1, 0, 2), (1, 2, 1)])).agg(F.sum("weight")).first()[0] == 3.0
    flow = A.max_flow(edge_frame(spark, [(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)]), 0, 3).first()
    assert flow["flow"] == 5.0
    assert A.weak_components(cycle.limit(0)).count() == 0


def test_betweenness_of_a_chain(spark):
    got = dict(rows(A.betweenness(edge_frame(spark, [(0, 1), (1, 2), (2, 3)]), normalised=False)))
    assert got == {0: 0.0, 1: 2.0, 2: 2.0, 3: 0.0}


def test_text_functions(spark):
    df = spark.createDataFrame([("Not good. It is 3.5 by Dr. Who! Fine é <b>x</b>",)], "t string")
    one = df.select(N.sentences("t").alias("s"), N.sentiment(N.word_tokens("t")).alias("x"), N.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j")).first()
    assert one["s"] == ["Not good.", "It is 3.5 by Dr. Who!", "Fine é <b>x</b>"] and one["x"] == -2.0 and one["j"] == 1.0
    assert df.select(N.clean("t")).first()[0].endswith("Fine é x")


def test_expressions(spark):
    scope = {"a": F.lit(4), "s": F.lit("4"), "z": F.lit(0)}
    df = spark.range(1)
    value = lambda e: df.select(X.expression(e, scope)).first()[0]
    assert value("$.a == $.s") is True and value("$.a / $.z") is None and value("1 + 2 * $.a") == 9.0 and value("(1 + 2) * $.a") == 12.0
    assert value("!($.a > 3) || $.a != 5") is True
    assert df.select(X.interpolate("v={{$.a}};{{$.a / $.z}}", scope)).first()[0] == "v=4;"


def test_calendar(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-01-08"), ("2024-01-08", "2024-01-05"), ("2024-01-06", "2024-01-07")], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    assert [r[0] for r in df.select(X.business_days_between("a", "b")).collect()] == [1, -1, 0]
    assert [str(r[0]) for r in df.select(X.add_business_days("a", 1)).collect()] == ["2024-01-08", "2024-01-09", "2024-01-08"]


def test_fuzzy_titles_are_greedy(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghiX"), (3, "abcdefghXX"), (4, "zzz"), (5, None)], "id long, t string")
    assert rows(D.fuzzy(df, "id", "t", 0.9)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w", encoding="utf-8") as file:
        file.write('a;b;c\n1;"x;\ny";3\n2;"q""r";\n')
    df = R.read_csv(spark, path)
    assert rows(df) == [("1", "x;\ny", "3"), ("2", 'q"r', "")]
    assert [r[0] for r in K.csv_lines(df.where("a = '2'")).collect()] == ['2,"q""r",']
    assert rows(spark.createDataFrame([("aa\n\nbb\n\ncccccccc",)], "t string").select(F.explode(R.chunks("t", 6)))) == [("aa\n\nbb",), ("cccccccc",)]


def test_upsert_policies(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert rows(K.upsert(old, new, "k", "merge")) == [(1, "a"), (2, "x"), (3, "y")]
    assert {r["k"]: r["v"] for r in K.upsert(old, new, "k", "skip").collect()} == {1: "a", 2: None, 3: "y"}


def test_dataflow(spark):
    flow = Flow(spark.createDataFrame([(i, i % 3) for i in range(10)], "o int, k int"), ("o",))
    assert flow.map(v=F.when(F.col("k") > 0, F.col("k"))).count() == 6
    assert flow.first()["o"] == 0 and flow.last()["o"] == 9
    assert rows(flow.batch(4, "o").select("batch", "n")) == [(0, 4), (1, 4), (2, 2)]
    assert flow.on_error("x", F.when(F.col("k") != 1, F.lit(1)), "dead-letter").rejected.count() == 3


# ---- streams agree with batch


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "in")
    data = [(k, 1_700_000_000_000 + t * 1000, float(v)) for k, t, v in [("a", 0, 1), ("a", 5, 9), ("a", 30, 9), ("b", 2, 9), ("b", 70, 1), ("a", 31, 9), ("a", 95, 0), ("b", 200, 3)]]
    df = spark.createDataFrame(data, "k string, ms long, v double").withColumn("ts", F.timestamp_millis("ms"))
    df.coalesce(1).write.parquet(folder)
    return df, lambda: spark.readStream.schema(df.schema).parquet(folder)


def test_stream_windows(stream):
    batch, live = stream
    got = streams.drain(streams.tumbling(live(), "ts", "10 seconds", ["k"], "v", "0 seconds"), "tumble", "complete")
    plain = batch.groupBy(F.window("ts", "10 seconds"), "k").agg(F.count("v").alias("n"))
    assert rows(got.select("k", F.col("window_start").cast("string"), "count")) == rows(plain.select("k", F.col("window.start").cast("string"), "n"))


def test_stream_sessions_end_with_their_last_event(stream):
    batch, live = stream
    got = streams.drain(streams.sessions(live(), "ts", 25_000_000, ["k"], "0 seconds"), "session", "complete")
    plain = W.session_bounds(batch, "ms", 25_000, ["k"], ["v"])
    assert rows(got.select("k", F.unix_millis("start"), F.unix_millis("end"), "n")) == rows(plain.select("k", "start", "end", "n"))


def test_stream_dedupe_and_alerts(stream):
    batch, live = stream
    got = streams.drain(streams.dedupe_after_kept(live().select("k", "ms"), "k", "ms", 20_000), "dedupe")
    assert rows(got) == rows(W.dedupe_events(batch.select("k", "ms", "v"), "ms", 20_000, ["k"], ["v"]).select("k", "ms"))
    alerts = streams.drain(streams.firing_alerts(live().where("k = 'a'").select("k", "ms", "v"), "k", "ms", "v", 5.0, 20_000), "alerts")
    assert [s for _, _, s in rows(alerts)] == ["pending", "firing", "resolved"]


def test_registered_queries_and_sql_have_the_same_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
