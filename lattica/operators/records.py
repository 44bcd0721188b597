"""Records, queues and metrics: column and map picking, array tidying, job, backup, alert and timing statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.joins import numbered


def pick(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that there are, in the order asked for."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def omit(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns but the named ones."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns])


def map_keys(entries: Column, change: Callable[[Column], Column]) -> Column:
    """A map with changed keys; the value of the last of equal new keys stays."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.struct(change(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def map_values(entries: Column, change: Callable[[Column], Column]) -> Column:
    return F.transform_values(entries, lambda _, v: change(v))


def compact(items: Column) -> Column:
    """A string array without nulls and empty strings."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def flatten(items: Column, depth: int = 1) -> Column:
    """Nested arrays with ``depth`` levels taken away."""
    for _ in range(depth):
        items = F.flatten(items)
    return items


def flat_fields(df: DataFrame, separator: str = ".") -> DataFrame:
    """Struct columns as columns of their own, named by their path."""
    out = []

    def walk(name: str, kind, value: Column) -> None:
        if kind.typeName() == "struct":
            for f in kind.fields:
                walk(f"{name}{separator}{f.name}", f.dataType, value.getField(f.name))
        else:
            out.append(value.alias(name))

    for f in df.schema.fields:
        walk(f.name, f.dataType, F.col(f"`{f.name}`"))
    return df.select(*out)


def nested_fields(df: DataFrame, separator: str = ".") -> DataFrame:
    """Columns named by paths as structs; the inverse of ``flat_fields``."""

    def build(names: list[tuple[list[str], str]]) -> list[Column]:
        out, groups = [], {}
        for path, name in names:
            groups.setdefault(path[0], []).append((path[1:], name))
        for head, inner in groups.items():
            leaf = [name for path, name in inner if not path]
            out.append((F.col(f"`{leaf[0]}`") if leaf else F.struct(*build(inner))).alias(head))
        return out

    return df.select(*build([(c.split(separator), c) for c in df.columns]))


def sampled(events: DataFrame, keys: list[str], rate: float, seed: int = 42) -> DataFrame:
    """Events kept at a rate, by a hash of their keys: the same ones in every run and of every copy."""
    return events.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < round(rate * 1_000_000))


def queue_stats(jobs: DataFrame, status: str, attempts: str, queue: str) -> DataFrame:
    """Jobs by state, those tried more than once, and the share of dead letters of each queue."""
    count = lambda s: F.count_if(F.col(status) == s)
    return jobs.groupBy(queue).agg(F.count("*").alias("jobs"), count("pending").alias("pending"), count("done").alias("done"), count("dead").alias("dead"), F.count_if(F.col(attempts) > 1).alias("retried"), (count("dead") / F.count("*")).alias("dead_share"))


def dead_letters_by_reason(jobs: DataFrame, reason: str, at: str) -> DataFrame:
    return jobs.groupBy(reason).agg(F.count("*").alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def next_jobs(jobs: DataFrame, priority: str, ready: str, now, ties: list[str], n: int) -> DataFrame:
    """The next ``n`` jobs of a priority queue: those whose delay is over, highest priority first, then oldest."""
    return jobs.where(F.col(ready) <= now).orderBy(F.desc(priority), ready, *ties).limit(n)


def version_stats(versions: DataFrame, key: str, ts: str) -> DataFrame:
    """Totals of a version or backup history."""
    per = versions.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return per.agg(F.count("*").alias("entities"), F.sum("n").alias("versions"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.min("lo").alias("oldest"), F.max("hi").alias("newest"))


def timing_stats(runs: DataFrame, name: str, ms: str) -> DataFrame:
    """Statistics of repeated timings; the deviation is that of the population."""
    q = lambda p: F.percentile(ms, F.lit(p))
    return runs.groupBy(name).agg(F.count("*").alias("n"), F.min(ms).alias("least"), F.max(ms).alias("most"), F.avg(ms).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.stddev_pop(ms).alias("deviation"))


def snapshot_series(snapshots: DataFrame, metric: str, ts: str, value: str, width_ms: int) -> DataFrame:
    """Counter snapshots as a series: the last value of each interval."""
    bucket = (F.floor(F.col(ts) / width_ms) * width_ms).alias("bucket")
    return snapshots.groupBy(metric, bucket).agg(F.max_by(value, F.struct(ts, value)).alias("value"))


def alert_groups(alerts: DataFrame, by: list[str], ts: str, severity: str) -> DataFrame:
    """Alerts of one group: how many, from when to when, and the highest severity."""
    return alerts.groupBy(*by).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.max(severity).alias("severity"))


def content_age(docs: DataFrame, kind: str, updated: str, edits: DataFrame | None = None, key: str | None = None, edited: str | None = None) -> DataFrame:
    """Mean and largest age by kind; a recorded edit makes a document as fresh as the edit."""
    if edits is not None:
        last = edits.groupBy(key).agg(F.min(edited).alias("_edited"))
        docs = docs.join(last, key, "left").withColumn(updated, F.least(updated, "_edited")).drop("_edited")
    return docs.groupBy(kind).agg(F.count("*").alias("n"), F.avg(updated).alias("mean_age"), F.max(updated).alias("most_age"))


def path_statistics(distances: DataFrame, distance: str) -> DataFrame:
    """Average path length and diameter of the pairs that reach each other."""
    return distances.where(F.col(distance) > 0).agg(F.avg(distance).alias("mean_path"), F.max(distance).alias("diameter"), F.count("*").alias("pairs"))


def dictionary_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, n, code): codes from 0 by falling frequency, then value; numbered over sorted ranges of the counted
    values, so no task sees them all."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("_rank", -F.col("n"))
    return numbered(counted, ["_rank", "value"], "code").select("value", "n", "code")
