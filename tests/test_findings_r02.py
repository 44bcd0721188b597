"""What round 2 found: tables larger than sf0.01, and what they showed."""

from __future__ import annotations

import math
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lattica.functions import scalar as X
from lattica.functions import sequential as Q
from lattica.functions import text as N
from lattica.llm import chat_format
from lattica.operators import dedup as D
from lattica.operators import graph as G

BIG = "/root/testdata/sf0.1"


def by_sql(name: str, folder: str, *tables: str) -> list[tuple]:
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def by_spark(spark, name: str, folder: str) -> list[tuple]:
    return sorted(map(tuple, __spark_entry__.queries()[name](spark, folder).collect()))


def test_no_row_for_nodes_that_no_path_joins(spark):
    assert by_spark(spark, "graph_bidirectional", BIG) == by_sql("graph_bidirectional", BIG, "lineitem", "orders", "customer", "supplier") == []


@pytest.mark.parametrize("most, hops", [(None, 19), (12, None)])
def test_distance_is_unbounded_unless_a_most_is_named(spark, most, hops):
    line = spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "source long, target long")
    assert G.bidirectional_distance(line, 1, 20, most) == hops


def test_a_bloom_filter_takes_its_shape_from_what_it_holds(spark):
    held = by_sql("bloom_filter", BIG, "part")
    assert len(held) > 400 and by_spark(spark, "bloom_filter", BIG) == held


def test_divisors_of_large_numbers(spark):
    row = spark.createDataFrame([(2_147_483_646, 36, 0, None)], "a long, b int, c int, d int").select(*[X.divisors(F.col(x)).alias(x) for x in "abcd"]).first()
    assert row["b"] == [1, 2, 3, 4, 6, 9, 12, 18, 36] and row["c"] == row["d"] == []
    assert len(row["a"]) == 192 and row["a"] == sorted(set(row["a"])) and row["a"][-1] == 2_147_483_646


def test_number_functions_against_plain_counting(spark):
    numbers = [*range(-2, 400), 7919, 1_299_709, 1_299_709 * 2, 2_147_483_646, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", F.pandas_udf(X.divisor_counts, "long")("n").alias("k"), F.size(X.divisors(F.col("n"))).alias("d"), X.is_prime(F.col("n")).alias("p")).collect()
    assert all(r["k"] == r["d"] == sum(r["n"] % i == 0 for i in range(1, r["n"] + 1)) for r in rows if r["n"] is not None and r["n"] < 8000)
    assert all(r["k"] == max(r["d"], 0) and bool(r["p"]) == (r["k"] == 2) for r in rows)
    pairs = [(2971215073, 1836311903), (7540113804746346429, 4660046610375530309), (0, 0), (0, 9), (12, 18), (18, 12), (-12, 18), (7, 0)]
    assert [r[0] for r in spark.createDataFrame(pairs, "a long, b long").select(X.gcd(F.col("a"), F.col("b"))).collect()] == [math.gcd(*p) for p in pairs]


NAMES = ["Small rings", "small ring!", "small ringz", "", None, "small ring", "small rinks", "zinc", "smell ring"]


def copies(spark, times: int):
    return spark.createDataFrame([(i, NAMES[i * 7 % len(NAMES)]) for i in range(times * len(NAMES))], "id long, t string")


def test_classes_and_their_links_state_every_pair_of_similar_titles(spark):
    df = copies(spark, 4)
    made = D.similar_title_classes(df, "id", "t", 0.8).collect()
    home = {r["a"]: r["b"] for r in made if r["kind"] == "member"}
    links = {(r["a"], r["b"]) for r in made if r["kind"] == "similar"}
    told = {(x, y) for x in home for y in home if x < y and (home[x] == home[y] or tuple(sorted((home[x], home[y]))) in links)}
    assert links and told == {tuple(r) for r in D.similar_titles(df, "id", "t", 0.8).collect()}
    assert len(home) + len(links) == len(made)


def test_fuzzy_of_many_copies_is_greedy_row_by_row(spark):
    df = copies(spark, 3)
    near = {}
    for r in D.similar_titles(df, "id", "t", 0.8).collect():
        near.setdefault(r["b"], []).append(r["a"])
    kept = {}
    for i in range(3 * len(NAMES)):
        kept[i] = next((j for j in sorted(near.get(i, [])) if kept[j] == j), i)
    assert dict(D.fuzzy(df, "id", "t", 0.8).collect()) == kept


def test_twenty_thousand_titles_of_few_words(spark):
    assert by_spark(spark, "dedup_similar", BIG) == by_sql("dedup_similar", BIG, "part")
    assert len(by_spark(spark, "dedup_fuzzy", BIG)) == 20_000


def test_graphs_side_by_side_rank_as_one_by_one(spark, monkeypatch):
    draw = random.Random(5)
    lists = [[draw.choice("abcdefghijklmnopqrstuvwxyz"[: 1 + i % 26]) for _ in range(draw.randrange(3 * i + 1))] for i in range(60)] + [[], ["a"], ["a", "a"], ["b", "a"], ["é", "z", "é", "y"]]
    alone, plain = [], Q.textrank
    monkeypatch.setattr(Q, "textrank", lambda *a: alone.append(a) or plain(*a))
    assert Q._top_ranks(pa.array(lists), 5) == [[w for w, _ in plain(ws)[:5]] for ws in lists]
    assert 0 < len(alone) < len(lists) - 20  # only near ties are ranked one by one
    monkeypatch.undo()
    df = spark.createDataFrame([(i, ws) for i, ws in enumerate(lists)] + [(99, None)], "id long, w array<string>")
    want = sorted((i, r + 1, w) for i, ws in enumerate(lists) for r, (w, _) in enumerate(plain(ws)[:5]))
    assert sorted(map(tuple, Q.textrank_keywords(df, "id", "w").collect())) == want


def test_summaries_are_scored_where_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(N, "_TERMS", 7)
    monkeypatch.setattr(N, "_SCORED", 40)
    draw = random.Random(7)
    words = [a + b for a in "bcdfg" for b in "aeiou" if a + b not in N.STOP_WORDS]
    split = [[" ".join(draw.choice(words) for _ in range(draw.randrange(1, 6))).capitalize() + "." for _ in range(draw.randrange(6))] for _ in range(40)] + [["..."], ["Ba.", "Ba."]]
    docs = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(split)] + [(None, "Ba de. Fo gu."), (77, None)], "id long, t string")
    bags = [[w.strip(".").lower() for s in p for w in s.split() if w.strip(".")] for p in [*split, ["Ba de.", "Fo gu."], []]]

    def score(sentence: str, bag: list[str]) -> float:
        own = [w.strip(".").lower() for w in sentence.split() if w.strip(".")]
        return round(sum(bag.count(w) / len(bag) * (math.log((len(bags) + 1) / (sum(w in b for b in bags) + 1)) + 1) for w in own) / max(len(own), 1), 12)

    want = {i: " ".join(p[j] for j in sorted(sorted(range(len(p)), key=lambda j: (-score(p[j], bags[i]), j))[:2])) for i, p in enumerate(split) if p}
    made = N.summarize(docs, "id", "t", 2)
    assert dict(made.collect()) == want | {None: "Ba de. Fo gu."}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_built_in_template_is_a_black_box_too(spark):
    rows = spark.createDataFrame([(i % 3, i, "assistant" if i % 2 else "user", "</s> [INST] \\ x" * (i % 5)) for i in range(200)], "conv_id long, turn long, role string, text string")
    assert chat_format.BUILT_IN.add is None  # every prefix is rendered and compared
    made, streamed = (sorted(map(tuple, chat_format.format_turns(rows, t).collect())) for t in (chat_format.BUILT_IN, chat_format.STREAMED))
    assert made == streamed and len(made) == 200
    prefixes = []
    turns = [{"role": "user", "text": str(i)} for i in range(5)]
    chat_format.locate_turns(lambda ts: prefixes.append(len(ts)) or chat_format.render(ts), turns)
    assert prefixes == list(range(6))
