"""Time series as (ts in ms, value) rows, per series key where one is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.folds import fold_rows
from lattica.operators.quantiles import with_quantiles

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count,
    "p50": lambda c: F.percentile(c, 0.5), "p95": lambda c: F.percentile(c, 0.95), "p99": lambda c: F.percentile(c, 0.99),
}


def _ordered(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def downsample(df: DataFrame, interval: int, agg: str = "avg", keys: list[str] | None = None, ts: str = "ms", value: str = "value") -> DataFrame:
    """Epoch-anchored buckets with the aggregate and the count."""
    bucket = (F.floor(F.col(ts) / interval) * interval).cast("long")
    return df.groupBy(*(keys or []), bucket.alias("bucket")).agg(AGGREGATES[agg](value).cast("double").alias("value"), F.count("*").alias("n"))


def query_range(df: DataFrame, start: int, end: int, interval: int | None = None, agg: str | None = None, ts: str = "ms", value: str = "value") -> DataFrame:
    """Rows of the inclusive range, bucketed only when both interval and aggregate are given."""
    rows = df.where(F.col(ts).between(start, end))
    return downsample(rows, interval, agg, ts=ts, value=value) if interval and agg else rows


def summary(df: DataFrame, value: str = "value") -> DataFrame:
    made = {"count": F.count(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value), "avg": F.avg(value)}
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    full = with_quantiles(df.agg(*[c.alias(k) for k, c in made.items()]), df, value, wanted)
    return full.select(*[F.coalesce(k, F.lit(0.0) if k != "count" else F.lit(0)).alias(k) for k in (*made, *wanted)])


def rolling(df: DataFrame, window: int, agg: str, keys: list[str], ts: str = "ms", value: str = "value") -> DataFrame:
    """Aggregate over [t - window, t], both ends included."""
    w = _ordered(keys, ts).rangeBetween(-window, 0)
    return df.withColumn("rolling", AGGREGATES[agg](value).over(w))


def moving_average(df: DataFrame, k: int, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Simple moving average, from the k-th row on."""
    w = _ordered(keys, *order)
    return df.withColumn("sma", F.avg(value).over(w.rowsBetween(-(k - 1), 0))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") >= k).drop("_n")


def weighted_average(df: DataFrame, weights: list[float], keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Weighted moving average, the oldest row taking the first weight."""
    w, k = _ordered(keys, *order), len(weights)
    total = sum((F.lag(value, k - 1 - i).over(w) * weights[i] for i in range(1, k)), F.lag(value, k - 1).over(w) * weights[0]) / sum(weights)
    return df.withColumn("wma", total).where("wma is not null")


def exponential_average(df: DataFrame, alpha: float, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """e0 = x0, e = alpha x + (1 - alpha) e, walked in order."""

    def step(e, row):
        e = row[-1] if e is None else alpha * row[-1] + (1 - alpha) * e
        return e, (e,)

    return fold_rows(df, keys, order, [value], None, step, "ema double")


def rate(df: DataFrame, window: int, unit: int, keys: list[str], ts: str = "ms", value: str = "value") -> DataFrame:
    """(v - base) per ``unit`` ms; base is the last row at or before t - window, else the series' first row."""
    w = _ordered(keys, ts)
    base = F.coalesce(F.last(F.struct(ts, value)).over(w.rangeBetween(Window.unboundedPreceding, -window)), F.first(F.struct(ts, value)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = df.withColumn("_b", base).withColumn("_dt", F.col(ts) - F.col("_b")[ts]).where("_dt > 0")
    return out.withColumn("rate", (F.col(value) - F.col("_b")[value]) / F.col("_dt") * unit).drop("_b", "_dt")


def fill_gaps(df: DataFrame, interval: int, keys: list[str], most: float = 5, ts: str = "ms", value: str = "value") -> DataFrame:
    """The rows and, in gaps over one and up to ``most`` intervals, linearly interpolated ones."""
    w = _ordered(keys, ts)
    pairs = df.select(*keys, ts, value, F.lead(ts).over(w).alias("_t"), F.lead(value).over(w).alias("_v"))
    gap = F.col("_t") - F.col(ts)
    steps = F.floor(gap / interval + 0.5).cast("long")
    new = pairs.where((gap > interval) & (gap <= interval * most) & (steps > 1)).withColumn("_n", steps).withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    share = F.col("_s") / F.col("_n")
    filled = new.select(*keys, F.floor(F.col(ts) + (F.col("_t") - F.col(ts)) * share + 0.5).cast("long").alias(ts), (F.col(value) + (F.col("_v") - F.col(value)) * share).alias(value), F.lit(True).alias("filled"))
    return df.select(*keys, ts, value, F.lit(False).alias("filled")).unionByName(filled)


def latest(df: DataFrame, n: int, ts: str = "ms", ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(F.desc(ts), *(ties or [])).limit(n)


def deltas(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First differences; the first row of a series keeps its value."""
    w = _ordered(keys, *order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(df: DataFrame, keys: list[str], order: list[str], delta: str) -> DataFrame:
    return df.withColumn("value", F.sum(delta).over(_ordered(keys, *order).rowsBetween(Window.unboundedPreceding, 0)))


def z_scores(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(x - mean) / population deviation; 0 where there is none."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def anomalies(df: DataFrame, keys: list[str], threshold: float = 2.5, value: str = "value") -> DataFrame:
    """Rows with |z| of at least the threshold, in series of three rows or more."""
    counted = df.withColumn("_n", F.count(value).over(Window.partitionBy(*keys)))
    return z_scores(counted.where("_n >= 3").drop("_n"), keys, value).where(F.abs("z") >= threshold)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Ranks with ties at their mean."""
    peers = F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(_ordered(keys, value)) + (peers - 1) / 2)
