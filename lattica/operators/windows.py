"""Windows over event streams in batch. Anchors are the first event, not the epoch; rows are ordered by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.folds import fold_rows


def _span(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """First and last timestamp of each key (partial minima), joined back without a global window."""
    if keys:
        bounds = df.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_mx"))
        return df.join(bounds, keys)
    return df.crossJoin(F.broadcast(df.agg(F.min(ts).alias("_t0"), F.max(ts).alias("_mx"))))  # one row


def tumbling(df: DataFrame, ts: str, size: int, keys: list[str] | None = None) -> DataFrame:
    """Adds window_start and window_end: whole multiples of ``size`` from the first event."""
    keys = keys or []
    out = _span(df, ts, keys)
    start = F.col("_t0") + F.floor((F.col(ts) - F.col("_t0")) / size).cast("long") * size
    return out.withColumn("window_start", start).withColumn("window_end", start + size).drop("_t0", "_mx")


def sliding(df: DataFrame, ts: str, size: int, slide: int, keys: list[str] | None = None) -> DataFrame:
    """One row per event and window; the first window ends one slide behind the first event, the last one is
    the one still open at the last event."""
    keys = keys or []
    out = _span(df, ts, keys)
    last = F.floor((F.col("_mx") - F.col("_t0")) / slide) + 1
    low = F.floor((F.col(ts) - F.col("_t0")) / slide) + 1
    high = F.least(last, F.floor((F.col(ts) - F.col("_t0") + size) / slide))
    k = F.explode(F.when(high >= low, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>")))
    out = out.withColumn("_k", k)
    return out.withColumn("window_start", F.col("_t0") + F.col("_k") * slide - size).withColumn("window_end", F.col("_t0") + F.col("_k") * slide).drop("_t0", "_mx", "_k")


def sessions(df: DataFrame, ts: str, gap: int, keys: list[str], ties: list[str]) -> DataFrame:
    """Adds session number (from 0): a gap of at least ``gap`` opens a new one."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties)
    opens = F.coalesce((F.col(ts) - F.lag(ts).over(w) >= gap).cast("int"), F.lit(0))
    return df.withColumn("_open", opens).withColumn("session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


def session_bounds(df: DataFrame, ts: str, gap: int, keys: list[str], ties: list[str]) -> DataFrame:
    """A row per session with start, end (the last event) and count."""
    return sessions(df, ts, gap, keys, ties).groupBy(*keys, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def count_windows(df: DataFrame, order: list[str], n: int, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n).cast("long"))


def window_metrics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, sum, avg, min and max of each window; zeros where no value is."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(value).alias("count"), zero(F.sum(value)).alias("sum"), zero(F.avg(value)).alias("avg"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max"))


def throttle(df: DataFrame, ts: str, gap: int, keys: list[str], ties: list[str]) -> DataFrame:
    """Rows at least ``gap`` behind the row before them (the first always): rate control in event time."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties)
    return df.withColumn("_d", F.col(ts) - F.lag(ts).over(w)).where(F.col("_d").isNull() | (F.col("_d") >= gap)).drop("_d")


def debounce(df: DataFrame, ts: str, gap: int, keys: list[str], ties: list[str]) -> DataFrame:
    """Rows followed by nothing for ``gap``."""
    w = Window.partitionBy(*keys).orderBy(ts, *ties)
    return df.withColumn("_d", F.lead(ts).over(w) - F.col(ts)).where(F.col("_d").isNull() | (F.col("_d") >= gap)).drop("_d")


def dedupe_events(df: DataFrame, ts: str, gap: int, keys: list[str], ties: list[str]) -> DataFrame:
    """Drops a row less than ``gap`` behind the last *kept* row of its key: sequential state, streamed."""

    def step(last, row):
        keep = last is None or row[0] - last >= gap
        return (row[0], ()) if keep else (last, None)

    return fold_rows(df, keys, [ts, *ties], [], None, step)
