"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of rows with a language (``fit_rows``, those of smallest hash); its
log-probability matrix of ``2 ** bits`` rows is broadcast. Whole texts are scored with sparse gathers. A
null text or one without a letter is ``und`` with score 0, as is everything when nothing was learned; equal
scores go to the language that sorts first; repeated rows are predicted alike. Very long texts are read in pieces
that overlap, so that every n-gram counts once; an empty table gives no rows; the input stays inside ``row``, so
its names clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, field, map_rows
from lattica.session import stored

ORDERS = (1, 2, 3)
#: Characters of a text that are hashed at a time.
PIECE = 1 << 18
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.array([chr(i).isalpha() for i in range(128)])


def gram_buckets(text: str, bits: int, begins: int | None = None) -> np.ndarray:
    """Hash buckets of all n-grams of a text's lower-cased letters, or of those that begin among its first
    ``begins`` characters; other characters are one separator."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    small = np.minimum(codes, 127)
    plain = codes < 128
    codes = np.where(plain, np.where(_LETTER[small], _LOWER[small], 32), codes).astype(np.uint64)
    out = []
    for order in ORDERS:
        n = len(codes) - order + 1
        n = n if begins is None else min(n, begins)
        if n < 1:
            break
        h = codes[:n] + np.uint64(order)
        for j in range(1, order):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : n + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(h >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def text_pieces(text: str, bits: int, size: int = PIECE) -> Iterator[np.ndarray]:
    """The buckets of a text piece by piece; a piece sees what its last n-grams need of the next one."""
    for at in range(0, len(text), size):
        yield gram_buckets(text[at : at + size + max(ORDERS) - 1], bits, size)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", bits: int = 16, fit_rows: int = 20_000, smoothing: float = 0.1, most_languages: int = 200) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sorted languages, log priors and the matrix (bucket, language) of log probabilities.

    It is fitted on at most ``fit_rows`` rows, one an id; more than ``most_languages`` languages in them, whose
    matrix would be too large to broadcast, are an error.
    """
    known = docs.where(F.col(id_column).isNotNull() & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    rows = bounded_sample(known.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")), "id", fit_rows)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                for buckets in text_pieces(text, bits):
                    own += np.bincount(buckets, minlength=1 << bits)
                texts[lang] = texts.get(lang, 0) + 1
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([-1, *at], pa.int64()), pa.array([texts[lang], *own[at]], pa.int64())], ["lang", "bucket", "n"])

    rows = stored(rows.select("text", "lang"))
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    matrix, priors = np.full((1 << bits, len(languages)), smoothing), np.zeros(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    columns = counted["lang"].map(at).to_numpy(np.int64)
    buckets, n = counted["bucket"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    grams = buckets >= 0
    np.add.at(matrix, (buckets[grams], columns[grams]), n[grams])
    priors[columns[~grams]] = n[~grams]
    return languages, np.log(priors / max(priors.sum(), 1)), np.log(matrix / matrix.sum(axis=0)) if languages else matrix


def predict_languages(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_column: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` with lang_pred and score, the posterior probability of the prediction."""
    languages, priors, matrix = model
    bits = int(np.log2(len(matrix)))
    shipped = docs.sparkSession.sparkContext.broadcast(matrix)

    def predict(rows: pa.StructArray) -> dict:
        table, names, scores = shipped.value, [], []
        for text in field(rows, text_column).to_pylist():
            if not languages or text is None or not has_letter(text):
                names.append("und")
                scores.append(0.0)
                continue
            sums = priors.copy()
            for buckets in text_pieces(text, bits):
                sums += table[buckets].sum(axis=0)
            best = int(np.argmax(sums))
            names.append(languages[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_rows(docs, predict, "lang_pred string, score double", columns)
