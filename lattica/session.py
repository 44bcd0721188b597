"""Session helpers shared by every operator: tables, checkpoints, size hints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting that frees shuffle files at the end of an execution (fixed value).
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder; any path that Spark can read works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local session without one gets a folder of its own, while
    a cluster must name one, as its executors can't write to the driver's disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder; unlike after ``cut``, later reads prune its columns."""
    spark, place = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run go when it has ended, as nothing reads them again."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` (file sizes for a scan); where it knows none, as for rows made
    in memory, the strings are measured."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate < 1 << 55:
        return estimate
    strings = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, t in df.dtypes if t == "string"), F.lit(0).cast("long"))
    return int(df.agg(F.sum(strings + 8 * len(df.columns)).alias("n")).first()["n"] or 0)
