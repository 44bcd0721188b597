"""Quantiles of sorted ranges against numpy: ties, hot and null keys, nulls, empty frames."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lattica.operators import statistics as S
from lattica.operators import timeseries as TS
from lattica.operators.quantiles import exact_quantiles

WANTED = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def test_quantiles_equal_numpy_by_key_and_overall(spark):
    draw = random.Random(5)
    data = [(draw.choice([None, "a", "a", "a", "a", "b"]), draw.choice([1.5, 1.5, draw.uniform(-9, 9), None])) for _ in range(600)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    found = {r["k"]: r for r in exact_quantiles(df, "v", WANTED, ["k"]).collect()}
    assert set(found) == {None, "a", "b", "one"}
    for key, row in found.items():
        values = [v for k, v in data if k == key and v is not None]
        assert [row[n] for n in WANTED] == pytest.approx([np.quantile(values, q) for q in WANTED.values()])
    row = exact_quantiles(df, "v", WANTED).first()
    assert [row[n] for n in WANTED] == pytest.approx([np.quantile([v for _, v in data if v is not None], q) for q in WANTED.values()])


def test_empty_frames_have_no_quantiles(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(empty, "v", WANTED, ["k"]).count() == 0
    assert list(exact_quantiles(empty, "v", WANTED).first()) == [None] * 5
    assert TS.summary(empty, "v").first()["p95"] == 0.0
    assert S.iqr_outliers(empty, "v").count() == 0


def test_descriptions_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("b", None)], "k string, v double")
    assert {r["k"]: (r["n"], r["median"], r["iqr"]) for r in S.describe(df, "v", ["k"]).collect()} == {None: (2, 2.0, 1.0), "a": (1, 2.0, 0.0), "b": (0, None, None)}
