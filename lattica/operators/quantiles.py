"""Exact quantiles without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.dataflow import Flow


def _same(keys: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def exact_quantiles(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """(keys, one column per wanted quantile), linearly interpolated. Equal values are counted first, so a frequent
    one is one row; their counts run over sorted ranges of (keys, value), so neither a hot key nor a frame without
    keys lands in one task. Null values are left out; a key with no others is absent, an empty frame without keys
    gives one row of nulls."""
    keys = list(keys or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = Flow(counts, (*keys, "_v")).running("_c", "_n").df
    spans = placed.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("_c").alias("_end"), F.min(F.col("_c") - F.col("_n")).alias("_start"))
    rows = placed.join(spans, _same(keys, "_k_")) if keys else placed.crossJoin(F.broadcast(spans))
    first, behind = F.col("_c") - F.col("_n") - F.col("_start"), F.col("_c") - F.col("_start")
    at = {name: (F.col("_end") - F.col("_start") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    holds = lambda place: (first <= place) & (place < behind)
    ends = [F.max(F.when(holds(near(place)), F.col("_v"))).alias(f"_{side}_{name}") for name, place in at.items() for side, near in (("lo", F.floor), ("hi", F.ceil))]
    places = [F.max(place).alias(f"_at_{name}") for name, place in at.items()]
    met = rows.groupBy(*keys).agg(*ends, *places)

    def between(name: str) -> Column:
        lo, hi, place = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_at_{name}")
        part = place - F.floor(place)
        return F.when(part == 0, lo).otherwise(lo * (1 - part) + hi * part).alias(name)

    return met.select(*keys, *[between(name) for name in wanted])


def with_quantiles(aggregated: DataFrame, df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """``aggregated``, one row per key, with the quantiles of ``df`` beside it."""
    keys = list(keys or [])
    found = exact_quantiles(df, value, wanted, keys)
    if not keys:
        return aggregated.crossJoin(F.broadcast(found))
    renamed = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *wanted)
    return aggregated.join(renamed, _same(keys, "_k_"), "left").drop(*[f"_k_{k}" for k in keys])
