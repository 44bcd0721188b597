"""Event sourcing, versions, replicated data types, audit: folds over ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.folds import fold_rows


def query_log(events: DataFrame, types: list[str] | None = None, aggregate=None, from_sequence: int | None = None, to_sequence: int | None = None, cursor: int | None = None, limit: int = 50) -> DataFrame:
    """A page of the log in sequence order; bounds are inclusive, the cursor is not."""
    out = events
    if types:
        out = out.where(F.col("type").isin(types))
    if aggregate is not None:
        out = out.where(F.col("aggregate") == aggregate)
    if from_sequence is not None:
        out = out.where(F.col("sequence") >= from_sequence)
    if to_sequence is not None:
        out = out.where(F.col("sequence") <= to_sequence)
    if cursor is not None:
        out = out.where(F.col("sequence") > cursor)
    return out.orderBy("sequence").limit(limit)


def replay(events: DataFrame, key: str, sequence: str, columns: list[str], initial: Column, step) -> DataFrame:
    """Left fold of each aggregate's events in sequence order."""
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(sequence, *columns))).alias("_e"))
    return rows.select(key, F.aggregate("_e", initial, step).alias("state"), F.size("_e").alias("version"))


def last_write(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Last writer wins by ``order``: a combined maximum, so hot keys are merged before the shuffle."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order)).alias("at")).select(*keys, value, *[F.col(f"at.{o}").alias(o) for o in order])


def compact_log(events: DataFrame, snapshots: DataFrame, key: str, version: str) -> DataFrame:
    """Events behind each aggregate's snapshot version; all of an aggregate without one."""
    s = snapshots.select(F.col(key), F.col(version).alias("_v"))
    return events.join(s, key, "left").where(F.col("_v").isNull() | (F.col(version) > F.col("_v"))).drop("_v")


def as_of(versions: DataFrame, keys: list[str], ts: str, moment, value: str) -> DataFrame:
    return versions.where(F.col(ts) <= moment).groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def version_numbers(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return log.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def prune_versions(log: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """Every n-th version (from the first) and the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.count("*").over(Window.partitionBy(*keys))
    return log.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", total).where((F.col("_i") % n == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def diff_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, path, kind, before, after) of two (id, path, value) tables."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.path") == F.col("b.path")), "full_outer")
    kind = F.when(F.col("a.id").isNull(), "add").when(F.col("b.id").isNull(), "delete").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "modify")
    return both.select(F.coalesce("a.id", "b.id").alias("id"), F.coalesce("a.path", "b.path").alias("path"), kind.alias("kind"), F.col("a.value").alias("before"), F.col("b.value").alias("after")).where("kind is not null")


def merge_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge of (id, path, value) tables: value and whether both sides changed it differently."""
    named = lambda df, c: df.select("id", "path", F.col("value").alias(c), F.lit(True).alias(f"h_{c}"))
    both = named(base, "o").join(named(ours, "a"), ["id", "path"], "full_outer").join(named(theirs, "b"), ["id", "path"], "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y)) & F.col(f"h_{x}").eqNullSafe(F.col(f"h_{y}"))
    conflict = ~same("o", "a") & ~same("o", "b") & ~same("a", "b")
    value = F.when(same("o", "a"), F.col("b")).otherwise(F.col("a"))
    there = F.when(same("o", "a"), F.col("h_b")).otherwise(F.col("h_a"))
    return both.select("id", "path", value.alias("value"), conflict.alias("conflict"), there.alias("_t")).where("_t or conflict").drop("_t")


# ---- replicated data types


def merge_counters(states: DataFrame, key: str, node: str, value: str) -> DataFrame:
    """Grow-only counters: the largest value of each node, summed by key."""
    return states.groupBy(key, node).agg(F.max(value).alias("m")).groupBy(key).agg(F.sum("m").alias("value"))


def merge_pn_counters(states: DataFrame, key: str, node: str, up: str, down: str) -> DataFrame:
    return states.groupBy(key, node).agg(F.max(up).alias("p"), F.max(down).alias("n")).groupBy(key).agg((F.sum("p") - F.sum("n")).alias("value"))


def merge_or_sets(adds: DataFrame, removes: DataFrame | None, element: str, tag: str) -> DataFrame:
    """Elements with a live tag; without a removal table tags are only united."""
    live = adds.select(element, tag).distinct()
    if removes is not None:
        live = live.join(removes.select(element, tag), [element, tag], "left_anti")
    return live.groupBy(element).agg(F.count("*").alias("tags"))


def merge_clocks(a: Column, b: Column) -> Column:
    """Vector clocks as maps: the larger entry of every node."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def compare_clocks(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    less, more = F.exists(pairs, lambda p: p["x"] < p["y"]), F.exists(pairs, lambda p: p["x"] > p["y"])
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


# ---- audit and retention


def audit_alerts(entries: DataFrame, keys: list[str], ts: str, window: int, threshold: int) -> DataFrame:
    """Entries at which the count within ``window`` reaches the threshold; an alert resets its key's count."""

    def step(open_, row):
        now = (*(x for x in open_ if x > row[0] - window), row[0])
        return ((), ()) if len(now) >= threshold else (now, None)

    return fold_rows(entries, keys, [ts], [], (), step)


def retained(backups: DataFrame, created: str, now, newest: int, days: int, weeks: int, months: int) -> DataFrame:
    """Backups that any rule keeps: the newest, or an age within days, weeks * 7 or months * 30 days."""
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(created).cast("timestamp"))) / 86_400_000
    top = backups.orderBy(F.desc(created)).limit(newest)
    return backups.where(age <= max(days, weeks * 7, months * 30)).unionByName(top).distinct()
