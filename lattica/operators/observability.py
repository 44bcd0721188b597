"""Metrics, alerts, traces, health and rate limits over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.folds import fold_rows


def counters(events: DataFrame, labels: list[str], value: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.sum(value).alias("value"))


def gauges(events: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """Last value with the smallest and largest seen."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"), F.min(value).alias("min"), F.max(value).alias("max"))


def bucket_counts(events: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts of values up to each bound, and of all under an infinite one, in a single pass."""
    ends = [*bounds, float("inf")]
    sums = events.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(ends)])
    return sums.select(*labels, F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(ends)])))


def bucket_percentile(buckets: DataFrame, labels: list[str], q: float, first_bound: bool = False) -> DataFrame:
    """Linear interpolation inside the first bucket that reaches q; the first bucket counts from 0, or gives its
    bound if ``first_bound``; beyond the last bound that bound is given."""
    w = Window.partitionBy(*labels).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*labels))
    rows = buckets.withColumn("_pb", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_pc", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_t", total * q).withColumn("_i", F.row_number().over(w))
    hit = rows.where("n >= _t").groupBy(*labels).agg(F.min(F.struct("le", "n", "_pb", "_pc", "_t", "_i")).alias("h"))
    inside = F.col("h._pb") + (F.col("h._t") - F.col("h._pc")) / (F.col("h.n") - F.col("h._pc")) * (F.col("h.le") - F.col("h._pb"))
    value = F.when(F.col("h.le") == float("inf"), F.col("h._pb")).when(F.lit(first_bound) & (F.col("h._i") == 1), F.col("h.le")).otherwise(inside)
    return hit.select(*labels, value.alias("value"))


def exposition(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Text lines ``name{label="..."} value``."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return metrics.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def firing_islands(series: DataFrame, keys: list[str], ts: str, condition: Column, least: int) -> DataFrame:
    """(keys, start, end) of runs in which the condition held for at least ``least`` ms."""
    w = Window.partitionBy(*keys).orderBy(ts)
    flag = F.coalesce(condition, F.lit(False)).cast("int")
    rows = series.withColumn("_f", flag).withColumn("_new", F.when((F.col("_f") == 1) & (F.coalesce(F.lag("_f").over(w), F.lit(0)) == 0), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f = 1")
    return rows.groupBy(*keys, "_g").agg(F.min(ts).alias("start"), F.max(ts).alias("end")).where(F.col("end") - F.col("start") >= least).drop("_g")


def absent(series: DataFrame, keys: list[str], ts: str, now: int, quiet: int) -> DataFrame:
    """Keys without data in the last ``quiet`` ms."""
    return series.groupBy(*keys).agg(F.max(ts).alias("last")).where(F.col("last") < now - quiet)


def span_tree(spans: DataFrame, span: str, parent: str, start: str, end: str) -> DataFrame:
    """Spans with their own time: the duration less that of their children."""
    inner = spans.groupBy(F.col(parent).alias("_p")).agg(F.sum(F.col(end) - F.col(start)).alias("_c"), F.count("*").alias("children"))
    out = spans.join(inner, spans[span] == F.col("_p"), "left")
    return out.select(*spans.columns, (F.col(end) - F.col(start) - F.coalesce("_c", F.lit(0))).alias("self_time"), F.coalesce("children", F.lit(0)).alias("children"))


def health(checks: DataFrame, service: str, status: str, critical: str) -> DataFrame:
    """unhealthy if a critical check is, degraded if another check is not healthy, unknown without checks."""
    bad = F.bool_or(F.col(critical) & (F.col(status) == "unhealthy"))
    weak = F.bool_or(F.col(status).isin("unhealthy", "degraded"))
    none = F.count(status) == 0
    return checks.groupBy(service).agg(F.when(none, "unknown").when(bad, "unhealthy").when(weak, "degraded").otherwise("healthy").alias("health"))


# ---- rate limits; requests of a key are ordered by time and then the tie columns


def fixed_window(requests: DataFrame, key: str, ts: str, width: int, most: int, ties: list[str]) -> DataFrame:
    """Epoch-anchored windows; rejected requests count too."""
    w = Window.partitionBy(key, F.floor(F.col(ts) / width)).orderBy(ts, *ties)
    return requests.withColumn("allowed", F.row_number().over(w) <= most)


def sliding_log(requests: DataFrame, key: str, ts: str, width: int, most: int, ties: list[str]) -> DataFrame:
    """Allowed while fewer than ``most`` allowed requests lie in (t - width, t]; the state is at most ``most`` times."""

    def step(log, row):
        live = tuple(x for x in log if x > row[0] - width)
        ok = len(live) < most
        return ((*live, row[0]) if ok else live), (ok,)

    return fold_rows(requests, [key], [ts, *ties], [], (), step, "allowed boolean")


def token_bucket(requests: DataFrame, key: str, ts: str, capacity: float, per_ms: float, ties: list[str], cost: float = 1.0) -> DataFrame:
    """Lazy refill up to the capacity; allowed if the tokens cover the cost."""

    def step(state, row):
        tokens, at = state
        tokens = min(capacity, tokens + (0 if at is None else row[0] - at) * per_ms)
        ok = tokens >= cost
        return (tokens - cost * ok, row[0]), (ok,)

    return fold_rows(requests, [key], [ts, *ties], [], (capacity, None), step, "allowed boolean")


def leaky_bucket(requests: DataFrame, key: str, ts: str, capacity: float, per_ms: float, ties: list[str]) -> DataFrame:
    """The queue drains steadily; allowed if there is room for one more."""

    def step(state, row):
        queue, at = state
        queue = max(0.0, queue - (0 if at is None else row[0] - at) * per_ms)
        ok = queue < capacity
        return (queue + ok, row[0]), (ok,)

    return fold_rows(requests, [key], [ts, *ties], [], (0.0, None), step, "allowed boolean")


def sliding_counter(requests: DataFrame, key: str, ts: str, width: int, most: float, ties: list[str]) -> DataFrame:
    """Rejected if the weighted count of allowed requests of the window before and of this one reaches ``most``."""

    def step(state, row):
        window, before, now = state
        w = row[0] // width
        before, now = (before, now) if w == window else (now, 0) if w == window + 1 else (0, 0)
        ok = before * (1 - row[0] % width / width) + now < most
        return (w, before, now + ok), (ok,)

    return fold_rows(requests, [key], [ts, *ties], [], (-2, 0, 0), step, "allowed boolean")
