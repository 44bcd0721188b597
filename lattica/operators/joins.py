"""Joins. Equality keys are null-safe: a null key matches a null key, as NaN does NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import cut


def _keys(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in on])


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", hint: str | None = None) -> DataFrame:
    """All matches of (left, right) key pairs; ``hint`` names a strategy (shuffle_hash, merge), else Catalyst picks."""
    return left.join(right.hint(hint) if hint else right, _keys(left, right, on), how)


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_ts: str, right_ts: str, window_ms: int) -> DataFrame:
    """Equal keys and timestamps at most ``window_ms`` apart, inclusive.

    Timestamps are dealt to buckets of the window's width and a right row to its bucket's neighbours, so a
    hot key is split over time instead of meeting in one task.
    """
    width = max(window_ms, 1)
    bucket = lambda c: F.floor(F.unix_millis(c.cast("timestamp")) / width).cast("long")
    a = left.withColumn("_bucket", bucket(left[left_ts]))
    b = right.withColumn("_near", F.explode(F.array(*[bucket(right[right_ts]) + i for i in (-1, 0, 1)])))
    gap = F.abs(F.unix_millis(a[left_ts].cast("timestamp")) - F.unix_millis(b[right_ts].cast("timestamp")))
    return a.join(b, _keys(a, b, on) & (a["_bucket"] == b["_near"]) & (gap <= window_ms)).drop("_bucket", "_near")


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float) -> DataFrame:
    """Closed numeric intervals that overlap, each pair once; intervals are dealt to cells of ``width``."""
    cells = lambda df, lo, hi: F.explode(F.sequence(F.floor(df[lo] / width).cast("long"), F.floor(df[hi] / width).cast("long")))
    a, b = left.withColumn("_cell", cells(left, *left_bounds)), right.withColumn("_cell_r", cells(right, *right_bounds))
    first = F.greatest(F.floor(a[left_bounds[0]] / width), F.floor(b[right_bounds[0]] / width)).cast("long")
    return a.join(b, (a["_cell"] == b["_cell_r"]) & (a[left_bounds[0]] <= b[right_bounds[1]]) & (b[right_bounds[0]] <= a[left_bounds[1]]) & (a["_cell"] == first)).drop("_cell", "_cell_r")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """The last right ``value`` of the same key at or before each left row: one union and one window, no range join."""
    a = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(F.col(key), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(f"as_of_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_t", "_side", "_v")


def pattern_join(nodes: DataFrame, edges: DataFrame, node_aliases: dict[str, str | None], edge_steps: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """Subgraph matches (homomorphisms): one id column per node alias.

    ``edge_steps`` are (from alias, to alias, edge type or None, direction); direction ``any`` is a union of
    both orientations, so that it stays an equality join.
    """
    out: DataFrame | None = None
    for source, target, kind, direction in edge_steps:
        e = edges if kind is None else edges.where(F.col("type") == kind)
        ahead = e.select(F.col("source").alias(source), F.col("target").alias(target))
        back = e.select(F.col("target").alias(source), F.col("source").alias(target))
        step = ahead if direction == "outbound" else back if direction == "inbound" else ahead.union(back)
        common = [] if out is None else [c for c in (source, target) if c in out.columns]
        out = step if out is None else out.join(step, common) if common else out.crossJoin(step)
    for alias, kind in node_aliases.items():
        if kind is not None:
            out = out.join(nodes.where(F.col("type") == kind).select(F.col("id").alias(alias)), alias, "left_semi")
    return out


def zip_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows paired by position; the shorter side wins. Positions come from a range sort and per-partition counts."""
    return numbered(left, left_order, "_n").join(numbered(right, right_order, "_n"), "_n").drop("_n")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in ``order`` without a single-partition window; placed once, as both uses must agree."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    begins = counts.withColumn("_b", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    return placed.join(begins, "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")
