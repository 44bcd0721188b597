"""Path algorithms follow chains to their end."""

from __future__ import annotations

import pytest

from lattica.operators import graph_algorithms as G


def chain(spark, n):
    return spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)], "source long, target long, weight double")


def test_weighted_distances_reach_the_end_of_a_chain(spark):
    got = {r["id"]: r["distance"] for r in G.weighted_distances(chain(spark, 62), 0).collect()}
    assert got == {i: float(i) for i in range(62)}


def test_closeness_counts_all_pairs_of_a_chain(spark):
    n = 30
    got = {r["id"]: r["closeness"] for r in G.closeness(chain(spark, n)).collect()}
    assert got[0] == pytest.approx((n - 1) / sum(range(1, n)))


def test_betweenness_counts_all_pairs_of_a_chain(spark):
    n = 30
    got = {r["id"]: r for r in G.betweenness(chain(spark, n), normalised=False).collect()}
    assert [list(got[i].asDict().values())[1] for i in range(n)] == pytest.approx([i * (n - 1 - i) for i in range(n)])
