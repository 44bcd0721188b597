"""Streaming counterparts. Event time needs a watermark; rows later than it are dropped, as documented per call."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, ts: str, size: str, keys: list[str], value: str, delay: str, start: str | None = None) -> DataFrame:
    """Window aggregates; ``start`` shifts windows from the epoch, as an anchor at the first event does."""
    window = F.window(ts, size, startTime=start) if start else F.window(ts, size)
    out = stream.withWatermark(ts, delay).groupBy(window, *keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "count", "sum", "min", "max")


def sliding(stream: DataFrame, ts: str, size: str, slide: str, keys: list[str], delay: str) -> DataFrame:
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap_us: int, keys: list[str], delay: str) -> DataFrame:
    """A gap of at least ``gap_us`` closes a session, which ends at its last event: Spark's windows merge at a
    gap that is equal and end one gap later, so one microsecond is taken off and the gap subtracted."""
    window = F.session_window(ts, f"{gap_us - 1} microseconds")
    out = stream.withWatermark(ts, delay).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.timestamp_micros(F.unix_micros("session_window.end") - (gap_us - 1)).alias("end"), "n")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str) -> DataFrame:
    """Stream-stream join of equal keys at most ``within`` apart."""
    a = left.withWatermark(left_ts, delay).alias("a")
    b = right.withWatermark(right_ts, delay).alias("b")
    near = F.expr(f"a.{key} = b.{key} AND b.{right_ts} BETWEEN a.{left_ts} - interval {within} AND a.{left_ts} + interval {within}")
    return a.join(b, near)


def dedupe_after_kept(stream: DataFrame, key: str, ts_ms: str, gap: int) -> DataFrame:
    """Keeps a row at least ``gap`` ms behind the last kept one of its key; the state is one timestamp a key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in frames:
            kept = []
            for t in sorted(pdf[ts_ms]):
                if last is None or t - last >= gap:
                    last = int(t)
                    kept.append(last)
            yield pd.DataFrame({key: [k[0]] * len(kept), ts_ms: kept})
        if last is not None:
            state.update((last,))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts_ms} long", "last long", "append", GroupStateTimeout.NoTimeout)


def firing_alerts(stream: DataFrame, key: str, ts_ms: str, value: str, threshold: float, least: int) -> DataFrame:
    """Alert transitions (key, ms, state): pending when the value passes the threshold, firing once it has done so
    for ``least`` ms, resolved when it no longer does."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since = state.get if state.exists else ("resolved", 0)
        for pdf in frames:
            out = []
            for t, v in sorted(zip(pdf[ts_ms], pdf[value])):
                new = status
                if v > threshold:
                    if status == "resolved":
                        new, since = "pending", int(t)
                    elif status == "pending" and t - since >= least:
                        new = "firing"
                else:
                    new = "resolved"
                if new != status:
                    status = new
                    out.append((k[0], int(t), new))
            yield pd.DataFrame(out, columns=[key, ts_ms, "state"])
        state.update((status, since))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts_ms} long, state string", "status string, since long", "append", GroupStateTimeout.NoTimeout)


def subscribe(stream: DataFrame, pattern: str, handler: Callable[[DataFrame, int], None], type_column: str = "type"):
    """Deliver micro-batches of events whose type matches (``*`` is any run) to a handler."""
    rx = "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"
    return stream.where(F.col(type_column).rlike(rx)).writeStream.foreachBatch(handler)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available data into a memory table; for tests and small backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
