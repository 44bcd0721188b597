"""Blocks, and figures gathered over blocks: any fan-out gives the same, with few rows a block."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import exchange, jaccard_join, ngram_lm, textkit
from lattica.llm.common import connected_components

DOCS = "doc_id long, text string"


def frame(spark, n, seed=3):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(draw.choice("abcdefgh") + str(draw.randint(0, 40)) for _ in range(draw.randint(0, 60)))) for i in range(n)], DOCS)


def test_blocks_hold_every_row_once(spark):
    rows = [(i % 7, None if i % 11 == 0 else "w " * (i % 50)) for i in range(900)] + [(None, "x" * 5000), (None, "")]
    blocks = exchange.packed_blocks(spark.createDataFrame(rows, DOCS).repartition(3), "text", 1000, least_bytes=1000)
    got = []
    for b in blocks.collect():
        table, words, first = exchange.unpacked(pa.scalar(bytes(b["data"]), pa.binary()))
        assert len(words) == first[-1] and table.num_rows == len(first) - 1
        got += zip(table.column("doc_id").to_pylist(), np.diff(first).tolist())
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(((i, len((t or "").split())) for i, t in rows), key=key)
    assert blocks.select("block").distinct().count() == blocks.count() > 20
    assert blocks.agg(F.max("bytes")).first()[0] == 5000 and exchange.packed_blocks(spark.createDataFrame([], DOCS), "text").count() == 0


@pytest.mark.parametrize("fan_out", [512, 5, 2])
def test_any_fan_out_sums_the_keys_of_all_blocks(spark, fan_out):
    blocks = exchange.packed_blocks(frame(spark, 400).repartition(4), "text", 600, least_bytes=600)

    def keys_of(_, words, first):
        return [list(x) for x in zip(np.unique(words >> np.uint64(4), return_counts=True))]

    def hash_of(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(textkit.word_hashes(data, np.array([0]), np.array([len(data)]))[0]) >> 4

    answers, notes = exchange.gather(blocks, keys_of, [60], lambda t: ([t[0]], [int(t[0].sum())]), fan_out, 600)
    words = frame(spark, 400).select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("w").count().collect()
    total = {hash_of(r["w"]): r["count"] for r in words}
    assert notes == [sum(total.values())]
    own = {r["block"]: r["data"] for r in blocks.collect()}
    rows = answers.collect()
    assert {r["block"] for r in rows} == set(own)
    for block, data in own.items():
        keys = keys_of(*exchange.unpacked(pa.scalar(bytes(data), pa.binary())))[0][0]
        mine = [r for r in rows if r["block"] == block]
        assert len(mine) <= fan_out
        told = exchange.values_of(pa.table({"place": [r["place"] for r in mine], "answer": pa.array([[bytes(a) for a in r["answer"]] for r in mine], pa.list_(pa.binary()))}), 1)[0]
        assert told.tolist() == [total[int(k)] for k in keys]


def test_levels_grow_with_the_logarithm_of_the_units():
    for units in (1, 2, 511, 512, 513, 10_000, 25_000_000):
        levels, radix = exchange.levels_for(units)
        assert radix**levels >= units and radix <= 512 and (levels == 1 or 512 ** (levels - 1) < units)


def test_both_operators_give_the_same_with_any_fan_out(spark):
    docs = frame(spark, 150).union(frame(spark, 60))
    one = sorted(jaccard_join.jaccard_components(docs, 2, 60).collect())
    assert one == sorted(jaccard_join.jaccard_components(docs, 2, 60, block_bytes=500, fan_out=3).collect())
    held = F.col("doc_id") % 5 == 0
    scores = lambda **more: sorted((r[0], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in ngram_lm.score_texts(docs, held, **more).collect())
    assert scores() == scores(block_bytes=500, fan_out=3)


def test_string_ids_stay_strings(spark):
    docs = frame(spark, 40).select(F.concat(F.lit("d"), F.lpad("doc_id", 3, "0")).alias("name"), "text")
    both = docs.union(docs.withColumn("name", F.concat("name", F.lit("x"))))
    got = {r[0]: r[2] for r in jaccard_join.jaccard_components(both, id_column="name").collect()}
    assert got["d005x"] == "d005" == got["d005"]
    assert ngram_lm.score_texts(docs, F.lit(False), "name").select("name").first()[0].startswith("d")


def test_a_copied_set_reaches_its_region_once(spark, monkeypatch, tmp_path):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(900)] + [(1000, " ".join([*base[:-1], "other"]))]
    seen = tmp_path / "seen"
    plain = jaccard_join._join_region

    def watched(table, percent):
        with open(seen, "a") as file:
            file.write(f"{table.num_rows}\n")
        return plain(table, percent)

    monkeypatch.setattr(jaccard_join, "_join_region", watched)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(6), block_bytes=4000).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 901
    assert seen.read_text().split() == ["2"]


def test_components_with_hubs_equal_a_search(spark):
    draw = random.Random(4)
    links = [(0, i) for i in range(1, 120)] + [(200 + i, 201 + i) for i in range(40)] + [(draw.randint(300, 380), draw.randint(300, 380)) for _ in range(60)] + [(None, 1), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), least=3).collect())
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, waiting = {node}, [node]
        while waiting:
            for other in near[waiting.pop()] - seen:
                seen.add(other)
                waiting.append(other)
        assert got[node] == min(seen)
    assert set(got) == set(near)
