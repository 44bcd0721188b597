"""Set operations and first-wins deduplication, over explicit orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.joins import numbered


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is in ``b``; duplicates of ``a`` stay."""
    return a.join(b.select(*on).distinct(), on, "left_semi")


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; duplicates of ``a`` stay."""
    return a.join(b.select(*on), on, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``: a partial minimum, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in order]
    firsts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return firsts.select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])


def split(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows for which ``condition`` holds, and all others (null counts as not)."""
    flag = F.coalesce(condition, F.lit(False))
    return df.where(flag), df.where(~flag)


def chunks(df: DataFrame, order: list[str], size: int, value: str) -> DataFrame:
    """Batches of ``size`` rows in ``order``, the last one shorter."""
    n = numbered(df.select(*order, value) if value not in order else df.select(*order), order, "_n")
    rows = n.groupBy(F.floor(F.col("_n") / size).cast("long").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias("_r"))
    return rows.select("batch", F.size("_r").cast("long").alias("n"), F.transform("_r", lambda r: r["v"]).alias("items"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that depend on the seed and the keys alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def compare_versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) with change in added, removed, modified, by a hash of all other columns."""
    rest = [c for c in old.columns if c != key]
    a, b = (d.select(F.col(key), F.xxhash64(*rest).alias("h"), F.lit(True).alias("here")) for d in (old, new))
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    change = F.when(F.col("a.here").isNull(), "added").when(F.col("b.here").isNull(), "removed").when(F.col("a.h") != F.col("b.h"), "modified")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change")).where("change is not null")


def apply_versions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with removals dropped, changed rows replaced and added ones appended."""
    changed = compare_versions(old, new, key)
    keep = old.join(changed.where("change <> 'added'"), key, "left_anti")
    return keep.unionByName(new.join(changed.where("change <> 'removed'"), key, "left_semi"))


def top_by(df: DataFrame, by: str, ties: list[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def top_per_key(df: DataFrame, keys: list[str], by: str, ties: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), *ties)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
