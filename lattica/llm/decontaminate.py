"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are runs of characters other than ASCII separators and punctuation, A-Z lower-cased. A window is
``window`` consecutive words of an item, or a whole shorter item. Texts are scanned once; a document's word
inside any occurrence of a window is hit. Null and empty texts have no words; items without words have no
windows; a null item id reads as the empty string; repeated items count once.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import field, map_rows
from lattica.llm.textkit import code_points_before, text_buffers, word_spans

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, A-Z being lower-cased first.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_NORMAL = bytes(0x20 if SEPARATORS[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_automata: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: str | None, size: int) -> set[str]:
    """The distinct windows of an item, each between single spaces."""
    words = normal_words((text or "").encode())
    return {f" {b' '.join(words[i : i + size]).decode()} " for i in range(max(1, len(words) - size + 1))} if words else set()


def _automaton(patterns: Broadcast, name: str) -> ahocorasick.Automaton:
    """The automaton of one broadcast, built once a worker."""
    if name not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for window, items in patterns.value.items():
            machine.add_word(window, (window.count(" ") - 1, items))
        machine.make_automaton()
        _automata[name] = machine
    return _automata[name]


def _scan(column: pa.Array, patterns: Broadcast, name: str) -> tuple[list[int], list[np.ndarray | None], list[set]]:
    machine = _automaton(patterns, name) if patterns.value else None
    counts, hits, found = [], [], []
    data, offsets = text_buffers(column)
    whole = data.tobytes()
    for a, b in zip(offsets[:-1], offsets[1:]):
        words = normal_words(whole[a:b])
        counts.append(len(words))
        padded = f" {b' '.join(words).decode()} "
        ends = [(end, value) for end, value in machine.iter(padded)] if machine and words else []
        found.append({item for _, (_, items) in ends for item in items})
        if not ends:
            hits.append(None)
            continue
        spaces = np.cumsum(np.frombuffer(padded.encode("utf-32-le"), np.uint32) == 0x20)
        marks = np.zeros(len(words) + 1, np.int64)
        for end, (size, _) in ends:
            last = spaces[end] - 1
            marks[last - size] += 1
            marks[last] -= 1
        hits.append(np.flatnonzero(np.cumsum(marks[:-1]) > 0))
    return counts, hits, found


def _spans(column: pa.Array, hits: list[np.ndarray | None]) -> list[list[dict]]:
    """Runs of hit words in code points of the original text."""
    out: list[list[dict]] = []
    for text, hit in zip(column, hits):
        if hit is None or not len(hit):
            out.append([])
            continue
        data = np.frombuffer(text.as_py().encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), SEPARATORS)
        breaks = np.flatnonzero(np.diff(hit) > 1)
        first, last = hit[np.concatenate([[0], breaks + 1])], hit[np.concatenate([breaks, [len(hit) - 1]])]
        out.append([{"start": int(s), "end": int(e)} for s, e in zip(code_points_before(data, starts[first]), code_points_before(data, ends[last]))])
    return out


def scan_benchmark(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, columns: list[str] | None = None, automaton_bytes: int = 32 << 20) -> DataFrame:
    """``row`` (the document) with n_words, n_hit, items (sorted) and spans of what occurs in the benchmark.

    Windows of more than ``automaton_bytes`` are dealt to several automata, each scanning the texts in turn,
    so what is broadcast has a checked size whatever the benchmark's.
    """
    chars = items.agg(F.sum(F.octet_length(item_text)).alias("n")).first()["n"] or 0
    parts = max(1, -(-chars * (window + 1) // automaton_bytes))
    kept = list(columns or docs.columns)
    state, before = docs.select(*(F.col(f"`{c}`") for c in kept)), "_scan"
    while before in kept:
        before += "_"
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(parts)) == part) if parts > 1 else items
        patterns: dict[str, set] = defaultdict(set)
        for item, text in own.select(F.col(item_id).cast("string"), item_text).toLocalIterator():
            for w in windows(text, window):
                patterns[w].add(item or "")
        shipped = docs.sparkSession.sparkContext.broadcast({w: sorted(x) for w, x in patterns.items()})

        def scan(rows: pa.StructArray, shipped=shipped, name=uuid.uuid4().hex, first=part == 0) -> dict:
            text = field(rows, text_column)
            counts, hits, found = _scan(text, shipped, name)
            if not first:
                old = field(rows, before).to_pylist()
                found = [f | set(o["items"]) for f, o in zip(found, old)]
                hits = [np.union1d(h if h is not None else [], o["hit"]).astype(np.int64) for h, o in zip(hits, old)]
            return {"n_words": pa.array(counts, pa.int64()), "hit": pa.array([[] if h is None else h for h in hits], pa.list_(pa.int64())), "items": pa.array([sorted(f) for f in found], pa.list_(pa.string()))}

        scanned = map_rows(state, scan, "n_words long, hit array<long>, items array<string>")
        state = scanned.select("row.*", F.struct("n_words", "hit", "items").alias(before)) if part == 0 else scanned.select(*(F.col("row").getField(c).alias(c) for c in kept), F.struct("n_words", "hit", "items").alias(before))

    seen = F.col(f"`{before}`")
    return state.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), seen["n_words"].alias("n_words"), F.size(seen["hit"]).cast("long").alias("n_hit"), seen["items"].alias("items"), seen["hit"].alias("hit_words"))


def hit_spans(scanned: DataFrame, text_column: str = "text") -> DataFrame:
    """Add spans (start, end in code points of the original) of the hit words of ``scan_benchmark``'s rows."""
    return map_rows(scanned, lambda rows: {"spans": pa.array(_spans(pc_text(rows, text_column), [np.array(h) for h in field(rows, "hit_words").to_pylist()]), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}, "spans array<struct<start:bigint,end:bigint>>").select("row.*", "spans")


def pc_text(rows: pa.StructArray, text_column: str) -> pa.Array:
    return field(field(rows, "row"), text_column)


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def items_digest(items: str = "items"):
    return F.sha2(F.concat_ws(",", F.array_sort(F.col(items))), 256)

