"""Corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality rules reject documents; of each group of near copies the one of smallest id stays; contaminated
documents go; secrets are redacted; what is left is encoded. All stages but the last return the columns of
documents. Null texts have no words and are rejected by the first stage. Rows that share an id are judged each by
itself; documents without an id stay only where no other of their group has one; of rows that tie in every column
one stays. Very long texts are judged whole; empty tables give empty tables; further columns are carried along,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, quality_gbt, secret_crf, sp_tokenizer
from lattica.llm.jaccard_join import jaccard_components
from lattica.llm.queries import MODEL_PATH
from lattica.session import ensure_checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_gbt.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_gbt.judge_quality(docs, model).where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decided row by row: rows are told apart by their id, rows without one last, and a hash of all columns; of
    rows equal in every column one stays."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.xxhash64(*columns).alias("h"))
    rows = docs.select(F.struct(*columns).alias("row"), key.alias("key"), F.col("text"))
    groups = jaccard_components(rows, k=5, percent=80, id_column="key")
    stay = groups.where("key = component_id").select("key").distinct()
    return rows.join(stay, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return scanned.where(~decontaminate.contaminated()).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_crf.find_secrets(docs, secret_crf.fit_secrets(docs), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sp_tokenizer.encode_texts(docs, MODEL_PATH, columns=["doc_id", "text"], with_ids=True)
    return encoded.select("row.doc_id", "n_tokens", "n_bytes", "ids_sha256", "exact", "ids")


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("sentencepiece", sentencepiece)]
#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
