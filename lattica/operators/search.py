"""Full-text, vector and hybrid search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import tokens

K1, B, TITLE = 1.2, 0.75, 2.0


def postings(docs: DataFrame, doc_id: str, title: str, content: str, terms: list[str] | None = None) -> DataFrame:
    """(doc, field, term, tf, len) with len counting both fields' tokens; the index to write, partitioned by term.
    With ``terms`` only their postings, the others' tokens being dropped before any row is made of them."""
    both = docs.select(F.col(doc_id).alias("doc"), tokens(title).alias("t"), tokens(content).alias("c"))
    size = (F.size("t") + F.size("c")).alias("len")
    asked = (lambda c: F.filter(c, lambda w: w.isin(*terms))) if terms is not None else F.col
    rows = both.select("doc", size, F.lit("title").alias("field"), F.explode(asked("t")).alias("term")).union(both.select("doc", size, F.lit("content"), F.explode(asked("c"))))
    return rows.groupBy("doc", "field", "term", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], doc_id: str, title: str, content: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """(doc, score); a term's document frequency counts its (doc, field) postings, repeated query terms count
    as often as they occur, title hits twice."""
    index = postings(docs, doc_id, title, content, sorted(set(query)))
    sizes = docs.select((F.size(tokens(title)) + F.size(tokens(content))).alias("len")).agg(F.count("*").alias("N"), F.avg("len").alias("avg"))
    asked = docs.sparkSession.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "term string, times long")
    hit = index.join(F.broadcast(asked), "term")  # the query's terms
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    scored = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(sizes))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    total = F.sum(F.col("times") * idf * part * F.when(F.col("field") == "title", TITLE).otherwise(1.0))
    return scored.groupBy("doc").agg(total.alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "doc").limit(limit)


def highlights(content: Column | str, query: list[str], n: int = 3) -> Column:
    """The first sentences with a query token."""
    parts = F.split(F.col(content) if isinstance(content, str) else content, r"[.!?\n]+")
    asked = F.array(*[F.lit(q) for q in query])
    return F.slice(F.transform(F.filter(parts, lambda s: F.arrays_overlap(tokens(s), asked)), lambda s: F.trim(s)), 1, n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without a norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Infinite for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x))).otherwise(F.lit(float("inf")))


def vector_search(vectors: DataFrame, query: list[float], vec_id: str, column: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """(id, score) by cosine, highest first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(vec_id).alias("id"), cosine(F.col(column), q).alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(limit)


def fuse(first: DataFrame, second: DataFrame, limit: int = 10, k: int = 60, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Reciprocal rank fusion of two short (id, score) lists."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # lists of candidates, bounded by their limits
    parts = [df.select("id", (F.lit(w) / (k + rank)).alias("s")) for df, w in zip((first, second), weights)]
    return parts[0].union(parts[1]).groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame, query: list[str], vector: list[float], doc_id: str, title: str, content: str, vec_id: str, column: str, limit: int = 10) -> DataFrame:
    depth = max(3 * limit, 100)
    text = bm25(docs, query, doc_id, title, content, depth).withColumnRenamed("doc", "id")
    return fuse(text, vector_search(vectors, vector, vec_id, column, depth), limit)


def wildcard(words: DataFrame, column: str, pattern: str) -> DataFrame:
    """Distinct words that match ? (one character) and * (any run)."""
    rx = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
    return words.where(F.col(column).rlike(rx)).select(column).distinct()
