"""LM scoring: an n-gram model counted over all training documents, held in Elias-Fano tries.

Rows are packed into blocks where they are scanned. Each block states its distinct n-grams, as hashes of 56
bits whatever the size of the corpus, and is told their counts in all training documents; the exchange has
bounded fan-out. A block then builds the trie of the n-grams of the corpus that it can meet: memory-mapped
levels of monotone pointers, words and quantised smoothed probabilities. Every token of its texts walks this
trie by successor search relative to its context, and where a level has no such word, backs off. No task holds
more than a block's or a unit's n-grams, and nothing of the corpus passes the driver but two totals.

Probabilities are Dirichlet-smoothed: p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), down to
(c(w) + 1) / (N + V + 1). Null and empty texts are one end token; very long texts are scored whole, in a block
of their own; repeated rows count as often as they occur; an empty table gives no rows. Only the id and the text
are read, so other columns can clash with nothing and are not returned.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import trimmed, with_id
from lattica.llm.exchange import BLOCK_BYTES, FAN_OUT, gather, packed_blocks, unpacked, values_of
from lattica.llm.textkit import mix

_U = np.uint64
START, END = _U(0xA5A5A5A5A5A5A5A5), _U(0x5A5A5A5A5A5A5A5A)
#: Bits of an n-gram's hash; among 10^13 n-grams one in 7 000 unknown ones is taken for another.
BITS = 56
#: Steps of a log10 probability in the quantised levels.
STEP = 1 / 4096
_NTH = np.full((256, 8), 255, np.uint8)
for _byte in range(256):
    _at = [i for i in range(8) if _byte >> i & 1]
    _NTH[_byte, : len(_at)] = _at


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the ``n``-th set bit (from 0) in each 64-bit word."""
    place, n = np.zeros(len(words), np.int64), n.astype(np.int64)
    for width in (32, 16, 8):
        low = np.bitwise_count(words & _U((1 << width) - 1)).astype(np.int64)
        over = n >= low
        n -= low * over
        shift = over * width
        words = words >> shift.astype(_U)
        place += shift
    return place + _NTH[(words & _U(255)).astype(np.int64), np.minimum(n, 7)]


class EliasFano:
    """A non-decreasing sequence in low bits and a unary bit vector of high parts."""

    def __init__(self, values: np.ndarray, keep):
        n, top = len(values), int(values[-1]) if len(values) else 0
        self.n, self.low_bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(_U)
        bits = np.zeros(n + (top >> self.low_bits) + 2, bool)
        bits[(values >> _U(self.low_bits)).astype(np.int64) + np.arange(n)] = True
        self.high = keep(self._packed(bits))
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = keep(np.concatenate([[0], np.cumsum(ones)]))
        self.zeros = keep(np.arange(len(self.ones)) * 64 - self.ones)
        low = ((values[:, None] >> np.arange(self.low_bits, dtype=_U)) & _U(1)).astype(bool)
        self.low = keep(self._packed(low.ravel()))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        data = np.packbits(bits, bitorder="little")
        return np.concatenate([data, np.zeros(-len(data) % 8 + 16, np.uint8)]).view(_U)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, off = at >> 6, (at & 63).astype(_U)
        above = np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return ((self.low[word] >> off) | above) & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _nth_bit(self.high[word], i - self.ones[word])
        return ((place - i).astype(_U) << _U(self.low_bits)) | self.low_of(i)

    def _behind_zero(self, k: np.ndarray) -> np.ndarray:
        """The place behind the ``k``-th zero of the bit vector (from 0); 0 for k = -1."""
        asked = np.maximum(k, 0)
        word = np.searchsorted(self.zeros, asked, "right") - 1
        return np.where(k < 0, 0, word * 64 + _nth_bit(~self.high[word], asked - self.zeros[word]) + 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of the successor of each value where it equals the value, else -1.

        Values of one high part lie between two zeros; a binary search over their low bits follows.
        """
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> _U(self.low_bits)).astype(np.int64)
        open_ = np.flatnonzero(high + 1 < int(self.zeros[-1]))
        high, low = high[open_], (values & _U((1 << self.low_bits) - 1))[open_]
        begin, end = self._behind_zero(high - 1) - high, self._behind_zero(high) - high - 1
        last = end.copy()
        while True:
            more = np.flatnonzero(begin < end)
            if not len(more):
                break
            middle = (begin[more] + end[more]) >> 1
            less = self.low_of(middle) < low[more]
            begin[more[less]] = middle[less] + 1
            end[more[~less]] = middle[~less]
            if len(more) < len(open_) // 2:  # the rest is settled: go on with fewer
                settled = np.ones(len(open_), bool)
                settled[more] = False
                self._settle(out, open_[settled], begin[settled], last[settled], low[settled])
                open_, begin, end, last, low = (x[more] for x in (open_, begin, end, last, low))
        self._settle(out, open_, begin, last, low)
        return out

    def _settle(self, out: np.ndarray, at: np.ndarray, place: np.ndarray, last: np.ndarray, low: np.ndarray) -> None:
        inside = np.flatnonzero(place < last)
        equal = inside[self.low_of(place[inside]) == low[inside]]
        out[at[equal]] = place[equal]


class Level:
    """The nodes of one order under the nodes of the order before, sorted by parent and word."""

    def __init__(self, parents: np.ndarray, words: np.ndarray, logs: np.ndarray, backoffs: np.ndarray | None, above: int, keep):
        counts = np.bincount(parents, minlength=above)
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(counts)]), keep)
        # A word is stored above the last value of the nodes before its parent's, so the sequence never falls.
        width = np.zeros(above, np.int64)
        np.maximum.at(width, parents, words + 1)
        self.words = EliasFano((np.cumsum(width) - width)[parents] + words, keep)
        self.bases = EliasFano(np.cumsum(width) - width, keep)
        self.logs = keep(quantised(logs))
        self.backoffs = None if backoffs is None else keep(quantised(backoffs))

    def find(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Nodes of ``words`` under ``parents``, -1 where there is none; parents must be sorted, -1 first."""
        out = np.full(len(parents), -1, np.int64)
        known = np.flatnonzero(parents >= 0)
        if not len(known):
            return out
        asked = parents[known]
        new = np.concatenate([[True], asked[1:] != asked[:-1]])
        own, of = asked[new], np.cumsum(new) - 1
        begin, end = self.pointers.get(own).astype(np.int64)[of], self.pointers.get(own + 1).astype(np.int64)[of]
        at = self.words.find(self.bases.get(own)[of] + words[known].astype(_U))
        out[known] = np.where((at >= begin) & (at < end), at, -1)
        return out


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-logs / STEP), 65535).astype(np.uint16)


def restored(levels: np.ndarray) -> np.ndarray:
    return levels * -STEP


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a memory-mapped file without a name, which goes with its last user."""
    if not array.nbytes:
        return array
    with tempfile.TemporaryFile() as file:
        array.tofile(file)
        file.flush()
        return np.asarray(np.memmap(file, array.dtype, "r", shape=array.shape))


class Grams:
    """Tokens and n-grams of some texts; order k of token i ends with it and may begin with the start mark."""

    def __init__(self, words: np.ndarray, first: np.ndarray, order: int):
        self.counts = np.diff(first) + 1
        self.begins = np.concatenate([[0], np.cumsum(self.counts)])
        self.tokens = np.empty(self.begins[-1], _U)
        last = self.begins[1:] - 1
        inner = np.ones(self.begins[-1], bool)
        inner[last] = False
        self.tokens[inner], self.tokens[last] = words, END
        place = np.arange(self.begins[-1]) - np.repeat(self.begins[:-1], self.counts)
        self.rows = len(self.counts)
        #: For each order: the keys of tokens that have one; tokens with a long enough context.
        self.has = [place + 2 >= k for k in range(1, order + 1)]
        self.keys = []
        for k in range(1, order + 1):
            h = np.full(len(self.tokens), _U(k))
            for back in range(k - 1, -1, -1):
                before = np.concatenate([np.full(back, START), self.tokens[: len(self.tokens) - back]]) if back else self.tokens
                before = np.where(place < back, START, before)
                h = mix(h * _U(0xD6E8FEB86659FD93) + before)
            self.keys.append(h >> _U(64 - BITS))


def _count_block(table: pa.Table, words: np.ndarray, first: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A block's distinct n-grams of each order and how often its training texts have them."""
    grams = Grams(words, first, order)
    train = np.repeat(np.array(table.column("train").to_pylist(), bool), grams.counts)
    found, times = [], []
    for has, keys in zip(grams.has, grams.keys):
        own, at = np.unique(keys[has], return_inverse=True)
        found.append(own)
        times.append(np.bincount(at, weights=train[has], minlength=len(own)).astype(np.uint32))
    return found, times


def _totals(totals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """Counts as they are, and the training tokens and types of a unit's words."""
    return totals, [int(totals[0].sum()), int((totals[0] > 0).sum())]


def _score_block(left: pa.Table, right: pa.Table, order: int, tokens: int, types: int, weight: float, kind: pa.DataType) -> pa.Table:
    table, words, first = unpacked(left.column("data")[0])
    grams = Grams(words, first, order)
    counts = [c.astype(np.int64) for c in values_of(right, order)]
    total = tokens + types + 1
    # Order 1: the ids of the block's words, START being one more.
    own, ids = np.unique(grams.keys[0], return_inverse=True)
    known = counts[0]
    lower = np.log10((known + 1) / total)
    base, scores = lower[ids], lower[ids]
    texts = int(known[ids[grams.begins[1] - 1]]) if grams.rows else 0
    context_count = np.append(known, texts)
    node_of = np.where(context_count > 0, np.arange(len(own) + 1), -1)
    backoff = restored(mapped(quantised(np.log10(weight / (context_count + weight)))))
    place = np.arange(len(ids)) - np.repeat(grams.begins[:-1], grams.counts)
    previous = np.concatenate([[len(own)], ids[:-1]])
    previous[place == 0] = len(own)
    above, parent = len(own) + 1, node_of[previous]  # for each token the node of its context
    parent_backoff, parent_count = backoff[previous], context_count[previous]
    for k in range(1, order):
        has = np.flatnonzero(grams.has[k])
        # The trie's level: n-grams of the corpus, each by the first token that has it.
        _, first = np.unique(grams.keys[k][has], return_index=True)
        of_corpus = counts[k] > 0
        one, count = has[first][of_corpus], counts[k][of_corpus]
        sorted_ = np.argsort(parent[one] * (len(own) + 1) + ids[one])
        one, count = one[sorted_], count[sorted_]
        logs = np.log10((count + weight * 10 ** scores[one]) / (parent_count[one] + weight))
        level = Level(parent[one], ids[one], logs, np.log10(weight / (count + weight)), above, mapped)
        # The walk: every token asks its context's node for its word.
        node = np.full(len(ids), -1, np.int64)
        asked = has[parent[has] >= 0]
        asked = asked[np.argsort(parent[asked] * (len(own) + 1) + ids[asked])]
        node[asked] = level.find(parent[asked], ids[asked])
        there = node >= 0
        scores = np.where(there, 0.0, scores + np.where(grams.has[k], parent_backoff, 0.0))
        scores[there] = restored(level.logs[node[there]])
        # The context of the next token at the next order is this token's n-gram.
        seen, times = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        seen[there], times[there] = restored(level.backoffs[node[there]]), count[node[there]]
        shift = lambda x, empty: np.concatenate([[empty], x[:-1]])
        parent, parent_backoff, parent_count, above = shift(node, -1), shift(seen, 0.0), shift(times, 0), len(one)
    add = lambda x: np.add.reduceat(x, grams.begins[:-1]) if grams.rows else np.zeros(0)
    return pa.table({"id": table.column("id").cast(kind), "train": table.column("train"), "n_tokens": pa.array(grams.counts, pa.int64()), "n_known": pa.array(add((known[ids] > 0).astype(np.int64)), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(scores), pa.float64())})


def score_texts(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text", order: int = 3, weight: float = 2.0, block_bytes: int = BLOCK_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """A row per document: id (of any type), held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``held_out`` is a column; what it marks is scored but not learned from. ``weight`` is the smoothing mu.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), (~held_out).alias("train"))
    kind = source.schema["id"].dataType
    arrow = to_arrow_type(kind)
    blocks = packed_blocks(source, "text", block_bytes)
    answers, notes = gather(blocks, lambda table, words, first: _count_block(table, words, first, order), [BITS] * order, _totals, fan_out, block_bytes)
    tokens, types = notes or (0, 0)
    joined = blocks.select("block", "data").groupBy("block").cogroup(answers.groupBy("block"))
    scored = joined.applyInArrow(lambda t, a: trimmed(_score_block(t, a, order, tokens, types, weight, arrow)), with_id(kind, "train boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select(F.col("id").alias(id_column), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
