"""Sinks: terminal operations, exports and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_row(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(1)


def last_row(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(1)


def null_sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def for_each(df: DataFrame, function: Callable) -> None:
    """A side effect per row, on the executors."""
    df.foreach(function)


def csv_cell(c: Column | str, always: bool = False) -> Column:
    """A cell quoted when it holds a quote, comma or line break, or always."""
    v = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(v.rlike('[",\n\r]'), quoted).otherwise(v)


def csv_lines(df: DataFrame, always: bool = False) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(c, always) for c in df.columns]).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def json_ld(nodes: DataFrame, id_column: str, type_column: str) -> DataFrame:
    rest = [c for c in nodes.columns if c not in (id_column, type_column)]
    return nodes.select(F.to_json(F.struct(F.col(id_column).cast("string").alias("@id"), F.col(type_column).alias("@type"), *rest)).alias("line"))


def markdown_notes(nodes: DataFrame, edges: DataFrame, title: str, content: str) -> DataFrame:
    """One document per node with its outgoing wikilinks in order."""
    names = nodes.select(F.col("id").alias("target"), F.col(title).alias("_name"))
    links = edges.join(names, "target").groupBy(F.col("source").alias("id")).agg(F.concat_ws("\n", F.sort_array(F.collect_set(F.concat(F.lit("- [["), "_name", F.lit("]]"))))).alias("_links"))
    body = F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(content, F.lit("")))
    return nodes.join(links, "id", "left").select("id", F.when(F.col("_links").isNull(), body).otherwise(F.concat(body, F.lit("\n\n## Links\n"), "_links")).alias("text"))


def checksum(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows and an order-free digest: the exclusive-or of row hashes, combined before the shuffle."""
    return df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*df.columns)).alias("checksum"))


def remap_ids(nodes: DataFrame, edges: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
    """Fresh ids from a salted hash, and the edges' ends rewritten the same way; ends without a node are dropped."""
    fresh = lambda c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)
    ids = nodes.select(F.col("id").alias("_id"))
    kept = edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(ids, F.col("target") == F.col("_id"), "left_semi")
    return nodes.withColumn("id", fresh("id")), kept.withColumn("source", fresh("source")).withColumn("target", fresh("target"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, policy: str = "overwrite") -> DataFrame:
    """skip keeps existing rows, overwrite takes incoming ones, merge fills the existing rows' nulls."""
    new = incoming.join(existing.select(key), key, "left_anti")
    if policy == "skip":
        return existing.unionByName(new)
    if policy == "overwrite":
        return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    rest = [c for c in existing.columns if c != key]
    a, b = existing.alias("a"), incoming.alias("b")
    merged = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in rest])
    return merged.unionByName(new)


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")
