"""Pieces that several operators share: rows through Arrow, lookups with hot keys, components of a link table."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import stored


#: A key that more than one in this many rows have is hot; so there are at most as many hot keys.
HOT_SHARE = 1000


def lookup(rows: DataFrame, key: str, names: DataFrame, total: int, least: int = 10_000) -> DataFrame:
    """``rows`` left-joined with ``names``, which has one row for each ``key``; ``total`` is the number of rows.

    The names of hot keys, those of more than a ``HOT_SHARE``-th of all rows (and ``least``), are broadcast: at
    most ``HOT_SHARE`` rows of them. So the rows of a hot key stay where they are instead of meeting in one task.
    """
    if total <= least:
        return rows.join(names, key, "left")
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total // HOT_SHARE, least)).select(key)
    tagged = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = names.join(F.broadcast(hot), key, "left_semi")
    plain = tagged.where("_hot is null").join(names, key, "left")
    return plain.unionByName(tagged.where("_hot").join(F.broadcast(few), key, "left")).drop("_hot")


def connected_components(edges: DataFrame, least: int = 10_000) -> DataFrame:
    """``(node, component)`` of an undirected ``(a, b)`` link table, component being the smallest node.

    Rounds of neighbour minimum and pointer jumping; each round is written to the shared folder, so that executors may be
    lost at any time. Minima are combined before they are dealt out, and hubs, nodes or components that many
    links or nodes point at, are looked up in a small broadcast table, so that neither is a hot key.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("component")))
    links, nodes = both.count(), labels.count()
    while True:
        known = labels.select(F.col("node").alias("b"), "component")
        near = lookup(both, "b", known, links, least).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lowest = stored(labels.join(near, "node").select("node", "component", F.least("component", "m").alias("low")))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("up"))
        stepped = stored(lookup(lowest, "low", jump, nodes, least).select("node", F.least("low", "up").alias("next"), (F.least("low", "up") < F.col("component")).alias("moved")))
        labels = stepped.select("node", F.col("next").alias("component"))
        if not stepped.where("moved").limit(1).count():
            return labels


def map_rows(df: DataFrame, function: Callable[[pa.StructArray], dict], ddl: str, columns: list[str] | None = None, most_bytes: int = 4 << 20) -> DataFrame:
    """``row`` (a struct of ``columns``, all by default) beside what ``function`` makes of whole rows.

    The function gets struct arrays of at most about ``most_bytes`` (a longer row alone) and returns columns
    in the order of ``ddl``. As the input stays inside ``row``, its names can clash with nothing.
    """
    source = df.select(F.struct(*(F.col(f"`{c}`") for c in columns or df.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = made = None
            step = max(1, batch.num_rows * most_bytes // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                made = function(piece.column(0))
                yield pa.RecordBatch.from_arrays([piece.column(0), *made.values()], ["row", *made])
            del batch, piece, made
            trimmed(None)

    return source.mapInArrow(run, T.StructType([source.schema["row"], *T.StructType.fromDDL(ddl).fields]))


def with_id(kind: T.DataType, ddl: str) -> T.StructType:
    """The columns of ``ddl`` behind an ``id`` of the given type."""
    return T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(ddl).fields])


def trimmed(result):
    """Pass a result on after giving freed memory back to the system, as workers are reused for other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    return result


def field(rows: pa.StructArray, name: str) -> pa.Array:
    """One column of the rows that ``map_rows`` hands over."""
    return pc.struct_field(rows, name)


def bounded_sample(df: DataFrame, id_column: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: those of the ids of smallest hash, one an id; a fit on them is the same in every run."""
    ids = df.select(id_column).where(F.col(id_column).isNotNull()).distinct()
    chosen = ids.orderBy(F.xxhash64(id_column), id_column).limit(rows)
    return one_row_each(df.join(F.broadcast(chosen), id_column, "left_semi"), id_column)


def one_row_each(df: DataFrame, id_column: str) -> DataFrame:
    """Of rows that share an id the one of smallest hash over all columns, then the smallest."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    least = df.groupBy(id_column).agg(F.min(F.struct(F.xxhash64(*columns).alias("h"), F.struct(*columns).alias("row"))).alias("least"))
    return least.select("least.row.*")
