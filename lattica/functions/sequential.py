"""Functions that walk a text or an expression step by step, as Arrow-batched pandas functions."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# ---- stemming

_VOWEL = "aeiou"


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", "".join("v" if c in _VOWEL else "c" for c in stem)))


def _has_vowel(stem: str) -> bool:
    return any(c in _VOWEL for c in stem)


#: Suffixes of the later steps and what they become (fixed values of the published algorithm).
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; y is never a vowel."""
    w = word
    if len(w) < 3:
        return w
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: len(w) - len(suffix)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and re.search(r"[^aeiou][aeiou][^aeiouwxy]$", w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = next((s for s in sorted(table, key=len, reverse=True) if w.endswith(s)), None)
        if suffix and _measure(w[: -len(suffix)]):
            w = w[: -len(suffix)] + table[suffix]
    suffix = next((s for s in sorted(STEP_4, key=len, reverse=True) if w.endswith(s)), None)
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not re.search(r"[^aeiou][aeiou][^aeiouwxy]$", w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(words: pd.Series) -> pd.Series:
    """Stems of arrays of words."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


# ---- text difference


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    """A shortest edit script by lines: (equal, delete or insert, line), found on the furthest-reaching paths of
    each number of edits."""
    a, b = old.split("\n"), new.split("\n")
    reach, trace = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    out, x, y = [], len(a), len(b)
    for d in range(len(trace) - 1, -1, -1):
        k, seen = x - y, trace[d]
        before = k + 1 if k == -d or k != d and seen[k - 1] < seen[k + 1] else k - 1
        px = seen[before]
        py = px - before
        while x > px and y > py and x > 0 and y > 0:
            x, y = x - 1, y - 1
            out.append(("equal", a[x]))
        if d:
            out.append(("insert", b[y - 1]) if x == px else ("delete", a[x - 1]))
            x, y = px, py
    return out[::-1]


def diff_lines(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, ord, op, line) of every row's two texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(k, i, op, line) for k, a, b in zip(pdf["k"], pdf["a"], pdf["b"]) for i, (op, line) in enumerate(line_diff(a or "", b or ""))]
            yield pd.DataFrame(out, columns=[key, "ord", "op", "line"])

    return df.select(F.col(key).alias("k"), F.col(old).alias("a"), F.col(new).alias("b")).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, ord long, op string, line string")


# ---- cron


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else tuple(map(int, span.split("-"))) if "-" in span else (int(span), high if step else int(span))
        if not (low <= a <= b <= high) or step == "0":
            raise ValueError(f"{part!r} is not between {low} and {high}")
        out.update(range(a, b + 1, int(step or 1)))
    return out


def next_runs(expression: str, after: dt.datetime, n: int) -> list[dt.datetime]:
    """The next times of a five-field cron expression (minute, hour, day, month, weekday; 0 is Sunday). With day and
    weekday both restricted either may match."""
    parts = expression.split()
    if len(parts) != 5:
        raise ValueError("a cron expression has five fields")
    minutes, hours, days, months, weekdays = (_field(p, lo, hi) for p, (lo, hi) in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))))
    weekdays = {d % 7 for d in weekdays}
    either = parts[2] != "*" and parts[4] != "*"
    out, day = [], after.replace(hour=0, minute=0, second=0, microsecond=0)
    for _ in range(366 * 8):
        week = (day.weekday() + 1) % 7 in weekdays
        fits = (day.day in days or week) if either else (day.day in days and week)
        if day.month in months and fits:
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = day.replace(hour=h, minute=m)
                    if at > after:
                        out.append(at)
                        if len(out) == n:
                            return out
        day += dt.timedelta(days=1)
    return out


def schedule(df: DataFrame, key: str, expression: str, start: str, n: int) -> DataFrame:
    """(key, ord, at) of the next n runs of every row's cron expression."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(k, i, t) for k, e, s in zip(pdf["k"], pdf["e"], pdf["s"]) for i, t in enumerate(next_runs(e, s.to_pydatetime(), n))]
            yield pd.DataFrame(out, columns=[key, "ord", "at"])

    return df.select(F.col(key).alias("k"), F.col(expression).alias("e"), F.col(start).cast("timestamp").alias("s")).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, ord long, at timestamp")


# ---- TextRank


def textrank(words: list[str], window: int = 4, rounds: int = 30, damping: float = 0.85) -> list[tuple[str, float]]:
    """Words by rank in their co-occurrence graph, ties by name."""
    near: dict[str, set] = {}
    for i, w in enumerate(words):
        for v in words[i + 1 : i + window]:
            if v != w:
                near.setdefault(w, set()).add(v)
                near.setdefault(v, set()).add(w)
    rank, ordered = {w: 1.0 for w in near}, {w: sorted(near[w]) for w in near}
    for _ in range(rounds):
        share = {v: rank[v] / len(near[v]) for v in near}
        rank = {w: 1 - damping + damping * sum(map(share.__getitem__, ordered[w])) for w in near}
    return sorted(((w, r) for w, r in rank.items()), key=lambda x: (-x[1], x[0]))


#: Words of the texts whose graphs are ranked at once; a longer text is ranked alone.
_RANKED = 250_000
#: Ranks nearer than this share of them are told apart as ``textrank`` does, whose sums round in another way.
_NEAR = 1e-9


def _top_ranks(words: pa.ListArray, k: int, window: int = 4, rounds: int = 30, damping: float = 0.85) -> list[list[str]]:
    """The first k words of ``textrank`` for each list, all graphs side by side as arrays."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = words.flatten().dictionary_encode()
    terms, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    nodes, at = np.unique(text * max(len(terms), 1) + codes, return_inverse=True)
    pairs = []
    for d in range(1, window):
        a, b = at[:-d], at[d:]
        fits = (text[:-d] == text[d:]) & (a != b)
        pairs += [a[fits] * len(nodes) + b[fits], b[fits] * len(nodes) + a[fits]]
    edges = np.sort(np.concatenate(pairs))
    edges = edges[np.append(True, np.diff(edges) != 0)[: len(edges)]]
    source, target = edges // max(len(nodes), 1), edges % max(len(nodes), 1)
    linked, begins = np.unique(source, return_index=True)
    if not len(linked):
        return [[] for _ in sizes]
    target = np.searchsorted(linked, target)
    degree = np.diff(np.append(begins, len(source)))
    rank = np.ones(len(linked))
    for _ in range(rounds):
        rank = 1 - damping + damping * np.add.reduceat((rank / degree)[target], begins)
    owner, code = np.divmod(nodes[linked], len(terms))
    order = np.lexsort((-rank, owner))
    owner, code, rank = owner[order], code[order], rank[order]
    lo, hi = np.searchsorted(owner, np.arange(len(sizes))), np.searchsorted(owner, np.arange(len(sizes)), "right")
    told = np.append(rank[:-1] - rank[1:] > _NEAR * rank[:-1], True)
    return [terms.take(pa.array(code[a : min(a + k, b)])).to_pylist() if told[a : max(a, min(a + k, b - 1))].all() else [w for w, _ in textrank(words[i].as_py(), window, rounds, damping)[:k]] for i, (a, b) in enumerate(zip(lo, hi))]


def textrank_keywords(df: DataFrame, key: str, words: str, k: int = 5) -> DataFrame:
    """(key, rank, term) of the first k words of each text by ``textrank``."""
    kind = to_arrow_type(df.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(held):
                hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + _RANKED, "right")))
                top = _top_ranks(batch.column(1).slice(lo, hi - lo), k)
                rows = pa.array(np.repeat(np.arange(lo, hi), [len(t) for t in top]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows).cast(kind), pa.array([r + 1 for t in top for r in range(len(t))], pa.int64()), pa.array([w for t in top for w in t], pa.string())], [key, "rank", "term"])
                lo = hi

    return df.select(F.col(key).alias("k"), F.col(words).alias("w")).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, rank long, term string")


# ---- replicated text


def replay_insertions(ops: list[tuple]) -> str:
    """Text of an insert-after list: (id, after id or None, character, deleted); a later sibling stands first."""
    children: dict = {}
    for i, after, char, gone in sorted(ops, key=lambda o: o[0], reverse=True):
        children.setdefault(after, []).append((i, char, gone))
    out, stack = [], list(reversed(children.get(None, [])))
    while stack:
        i, char, gone = stack.pop()
        if not gone:
            out.append(char)
        stack.extend(reversed(children.get(i, [])))
    return "".join(out)


def merge_texts(ops: DataFrame, key: str) -> DataFrame:
    """(key, text) of each document's operations (id, after, char, deleted), repeated ones counting once."""
    distinct = ops.groupBy(key, "id").agg(F.first("after").alias("after"), F.first("char").alias("char"), F.bool_or("deleted").alias("deleted"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(i, None if pd.isna(a) else a, c, d) for i, a, c, d in zip(pdf["id"], pdf["after"], pdf["char"], pdf["deleted"])]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "text": [replay_insertions(rows)]})

    return distinct.groupBy(key).applyInPandas(run, f"{key} {dict(ops.dtypes)[key]}, text string")
