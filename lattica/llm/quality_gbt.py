"""Quality rules: gradient-boosted trees over document statistics, beside two fixed rules.

Statistics cover whole texts. The trees are fitted on a bounded sample of labelled rows (``fit_rows``, those
of smallest hash), with second-order gradients over quantile bins and monotonic constraints, and flattened
into numpy node arrays for scoring. Null and empty texts have no words and fail the fixed rules. Without
labels of both classes every document that the fixed rules pass is kept. Repeated rows are judged alike; an empty table
gives no rows; the input stays inside ``row``, so its names clash with nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import field, map_rows, one_row_each
from lattica.llm.textkit import row_chunks, shingle_hashes, text_buffers, word_hashes, word_spans

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58], _SPACE[[32, *range(9, 14)]] = True, True, True, True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
#: Statistics in the order of the feature matrix; the sign is the constraint on the probability of good quality.
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": -1, "marks": -1, "distinct": 0, "words_a_line": 0, "wide": 0, "short_words": 0}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the five base counts and the features."""
    data, offsets = text_buffers(column)
    rows = len(offsets) - 1
    base, features = np.zeros((rows, len(BASE)), np.int64), np.zeros((rows, len(FEATURES)))
    for lo, hi in row_chunks(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

        def counts(mask: np.ndarray, at=at) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

        starts, ends, first = word_spans(part, at)
        words = word_hashes(part, starts, ends, lower=False)
        runs, begins = shingle_hashes(words, first, WINDOW)
        n, points = np.diff(first), (part & 0xC0) != 0x80
        chars = counts(points & ~_SPACE[part])
        symbols, upper, lower, wide = counts(_SYMBOL[part]), counts(_UPPER[part]), counts(_LOWER[part]), counts(part >= 0xC0)
        digits, marks = counts(_DIGIT[part]), counts(_MARKS[part])
        short = np.diff(np.concatenate([[0], np.cumsum(ends - starts <= 3)])[first])
        whole = part.tobytes()
        dup, repeat, lines, distinct = (np.zeros(hi - lo, np.int64) for _ in range(4))
        for i in range(hi - lo):
            own = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x.strip()]
            lines[i], dup[i] = len(own), len(own) - len(set(own))
            distinct[i] = len(np.unique(words[first[i] : first[i + 1]]))
            repeat[i] = _repeated(runs[begins[i] : begins[i + 1]])
        base[lo:hi] = np.stack([n, chars, symbols, dup, repeat], 1)
        over = lambda x, y: x / np.maximum(y, 1)
        letters = upper + lower + wide
        features[lo:hi] = np.stack([np.log1p(n), over(chars, n), over(symbols, chars), over(dup, lines), over(repeat, n), over(upper, letters), over(digits, chars), over(marks, n), over(distinct, n), np.log1p(over(n, lines)), over(wide, letters), over(short, n)], 1)
    return base, features


def _repeated(runs: np.ndarray) -> int:
    """Words inside windows that occur at least twice."""
    ordered = np.sort(runs)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, at, times = np.unique(runs, return_inverse=True, return_counts=True)
    marks = np.zeros(len(runs) + WINDOW, np.int64)
    again = np.flatnonzero(times[at] > 1)
    marks[again] += 1
    marks[again + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(marks) > 0))


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf points at itself."""

    start: float
    depth: int = 0
    roots: np.ndarray = attribute(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = attribute(default_factory=lambda: np.zeros(0, np.int64))
    threshold: np.ndarray = attribute(default_factory=lambda: np.zeros(0))
    left: np.ndarray = attribute(default_factory=lambda: np.zeros(0, np.int64))
    right: np.ndarray = attribute(default_factory=lambda: np.zeros(0, np.int64))
    value: np.ndarray = attribute(default_factory=lambda: np.zeros(0))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; ``signs`` constrain features to +1 rising, -1 falling, 0 free."""
    if not 0 < y.sum() < len(y):
        return Trees(start=20.0 if not len(y) or y.all() else -20.0)
    start = float(np.log(y.mean() / (1 - y.mean())))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    nodes: list[list] = []
    roots, total = [], np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        value = min(max(-G / (H + ridge), low), high)
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f in range(x.shape[1]) if level else ():
            if not len(edges[f]):
                continue
            left_g = np.cumsum(np.bincount(codes[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            left_h = np.cumsum(np.bincount(codes[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            a = np.clip(-left_g / (left_h + ridge), low, high)
            b = np.clip(-(G - left_g) / (H - left_h + ridge), low, high)
            loss = lambda w, gg, hh: gg * w + 0.5 * (hh + ridge) * w * w
            gain = loss(value, G, H) - loss(a, left_g, left_h) - loss(b, G - left_g, H - left_h)
            gain[(left_h < least) | (H - left_h < least) | (signs[f] * (b - a) < 0)] = 0
            if gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], f, k, a[k], b[k])
        _, f, k, a, b = best
        if f >= 0:
            go = codes[rows, f] <= k
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
            nodes[me][:2] = [f, edges[f][k]]
            nodes[me][2] = grow(rows[go], g, h, level - 1, *bounds[0])
            nodes[me][3] = grow(rows[~go], g, h, level - 1, *bounds[1])
        else:
            predicted[rows] = nodes[me][4]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        predicted = np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
        total += predicted
    flat = list(zip(*nodes))
    return Trees(start, depth, np.array(roots), np.array(flat[0]), np.array(flat[1]), np.array(flat[2]), np.array(flat[3]), np.array(flat[4]))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_column: str = "doc_id", text_column: str = "text") -> Trees:
    """Trees fitted on at most ``fit_rows`` labelled documents, one row an id, a label of 1 before one of 0."""
    best = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(best.orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    own = one_row_each(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(chosen, "id", "left_semi"), "id")
    rows = own.join(chosen, "id")

    def make(r: pa.StructArray) -> dict:
        return {"f": pa.array(list(statistics(field(r, "text"))[1]), pa.list_(pa.float64()))}

    got = map_rows(rows, make, "f array<double>").select("row.id", "row.quality", "f").collect()
    got = sorted({(r["id"], r["quality"], tuple(r["f"])) for r in got})
    x = np.array([g[2] for g in got]).reshape(len(got), len(FEATURES))
    return fit_trees(x, np.array([float(g[1] > 0) for g in got]), list(FEATURES.values()))


def judge_quality(docs: DataFrame, model: Trees, text_column: str = "text", columns: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``row`` with the base counts, base_failed, quality (a probability) and kept."""

    def judge(rows: pa.StructArray) -> dict:
        base, features = statistics(field(rows, text_column))
        good = model.probability(features)
        failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        out = {name: pa.array(base[:, i]) for i, name in enumerate(BASE)}
        return out | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (good >= threshold)), "quality": pa.array(good)}

    return map_rows(docs, judge, ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean, quality double", columns)
