"""Exact n-gram Jaccard join: near copies of texts and the components that they form.

Jaccard distance is a metric, so the join partitions the space by pivots. In text almost all pairs are at
distance 1, where a few document pivots cannot tell anything apart; the first partition therefore takes
every shingle as a pivot. A document's nearest single-shingle pivots are its own shingles, taken in one
global order (rarest first); the triangle inequality bounds the window of pivots that it is copied to: a
link of similarity t leaves at least one common shingle among the first n - ceil(t n) + 1 of both. Regions
that meet are joined recursively with document pivots: Voronoi cells, windows of twice the radius, and a
nested loop in leaves. Document frequencies that fix the order are counted over all documents.

Texts without words have an empty set and no links; null counts as empty. Repeated rows and ties are kept:
each row gets the smallest id of its component. A null id never is a component id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.common import connected_components, lookup, trimmed, with_id
from lattica.llm.exchange import BLOCK_BYTES, FAN_OUT, gather, packed_blocks, unpacked, values_of
from lattica.llm.textkit import mix, shingle_hashes
from lattica.session import stored

_U = np.uint64
#: Leading bits of a shingle's hash that frequencies are counted on; they only order shingles.
BITS = 48
LEAF = 24
PIVOTS = 4
#: Most pivots of a region in one round of ``_peel``.
BALLS = 32


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text, given its words; a shorter text is one shingle."""
    hashes, begins = shingle_hashes(words, first, k)
    out: list[np.ndarray] = []
    for i in range(len(first) - 1):
        own = hashes[begins[i] : begins[i + 1]]
        if not len(own) and first[i + 1] > first[i]:
            h = _U(first[i + 1] - first[i])
            for w in words[first[i] : first[i + 1]]:
                h = mix(np.array([h ^ w], _U))[0]
            out.append(np.array([h], _U))
            continue
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit value for a whole set."""
    return int(mix(np.array([mix(s).sum(dtype=_U) + _U(len(s))], _U)).view(np.int64)[0])


def _own_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sets, their hashes and whether a row is the first of its block with this set."""
    sets = shingle_sets(words, first, k)
    nodes = np.array([set_hash(s) for s in sets], np.int64)
    once = np.zeros(len(sets), bool)
    once[np.unique(nodes, return_index=True)[1]] = True
    return sets, nodes, once & np.array([len(s) > 0 for s in sets], bool)


def _count_block(words: np.ndarray, first: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The shingles of a block's distinct sets, and how many of these sets have each."""
    sets, _, once = _own_sets(words, first, k)
    own = [s >> _U(64 - BITS) for s, f in zip(sets, once) if f]
    keys, counts = np.unique(np.concatenate(own) if own else np.zeros(0, _U), return_counts=True)
    return [keys], [counts]


def _levels(totals: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """A level for each shingle: 0 for one of a single set, else growing with its frequency."""
    return [np.minimum(np.ceil(np.log2(np.maximum(totals[0], _U(1)).astype(np.float64)) * 8), 255).astype(_U)], []


def _windows(left: pa.Table, right: pa.Table, k: int, percent: int, kind: pa.DataType) -> pa.Table:
    """A row per document; where its window has shared shingles, these and the whole set."""
    table, words, begins = unpacked(left.column("data")[0])
    sets, nodes, first = _own_sets(words, begins, k)
    own = [s >> _U(64 - BITS) if f else np.zeros(0, _U) for s, f in zip(sets, first)]
    _, at = np.unique(np.concatenate(own) if own else np.zeros(0, _U), return_inverse=True)
    levels = values_of(right, 1)[0].astype(np.uint8)
    cuts = np.cumsum([0, *map(len, own)])
    keys: list = [None] * len(sets)
    whole: list = [None] * len(sets)
    for i in np.flatnonzero(first):
        mine, n = levels[at[cuts[i] : cuts[i + 1]]], len(sets[i])
        window = n + percent * n // -100 + 1
        if np.count_nonzero(mine == 0) >= window:
            continue
        chosen = np.argsort(mine, kind="stable")[:window]
        keys[i] = sets[i][chosen[mine[chosen] > 0]].view(np.int64)
        whole[i] = sets[i].tobytes()
    return pa.table({
        "id": table.column("id").cast(kind), "n": pa.array([len(s) for s in sets], pa.int64()),
        "node": pa.array(nodes, pa.int64(), mask=np.array([len(s) == 0 for s in sets], bool)),
        "open": pa.array([w is not None for w in whole], pa.bool_()),
        "keys": pa.array(keys, pa.list_(pa.int64())), "shingles": pa.array(whole, pa.binary()),
    })


class Region:
    """The recursive join of the sets of one region."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        distinct, self.values = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)
        self.percent, self.radius = percent, 1 - percent / 100
        self.root = np.arange(len(sets))

    def flat(self, members: np.ndarray) -> np.ndarray:
        """The members' shingles, one after the other."""
        if len(members) == len(self.sizes):
            return self.values
        sizes = self.sizes[members]
        bounds = np.cumsum(sizes) - sizes
        return self.values[np.arange(sizes.sum()) + np.repeat(self.begins[members] - bounds, sizes)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def roots(self, members: np.ndarray) -> np.ndarray:
        up = self.root[members]
        while (again := self.root[up] != up).any():
            up[again] = self.root[up[again]]
        return up

    def measure(self, p: int, members: np.ndarray) -> np.ndarray:
        """Distances of ``members`` from ``p``; those that link with it are united with it."""
        pivot = self.values[self.begins[p] : self.begins[p + 1]]
        sizes = self.sizes[members]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.mark[pivot] = True
        common = np.add.reduceat(self.mark[self.flat(members)].astype(np.int64), bounds[:-1])
        self.mark[pivot] = False
        union = sizes + len(pivot) - common
        for i in members[100 * common >= self.percent * union]:
            a, b = self.find(p), self.find(i)
            self.root[max(a, b)] = min(a, b)
        return 1 - common / union

    def shared(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each member how many of its shingles others have too, and how many have them on average."""
        flat = self.flat(members)
        counts = np.bincount(flat, minlength=len(self.mark))[flat]
        bounds = np.cumsum(self.sizes[members]) - self.sizes[members]
        return np.add.reduceat((counts > 1).astype(np.int64), bounds), np.add.reduceat(counts, bounds) / self.sizes[members]

    def join(self) -> np.ndarray:
        """The smallest member index that each member is linked with, directly or not."""
        waiting = [np.arange(len(self.sizes))]
        while waiting:
            members = waiting.pop()
            if len(members) < 2 or len(np.unique(self.roots(members))) == 1:
                continue
            if len(members) <= LEAF:
                for i in range(len(members) - 1):
                    self.measure(members[i], members[i + 1 :])
                continue
            waiting += self.split(members)
        return self.roots(np.arange(len(self.sizes)))

    def split(self, members: np.ndarray) -> list[np.ndarray]:
        """Voronoi regions of a few pivots with their windows, the first being the one whose shingles the others
        share most; a ball that pivots can't part loses them."""
        common, weight = self.shared(members)
        open_ = 100 * common >= self.percent * self.sizes[members]  # else too few shingles are left for any link
        if not open_.all():
            return [members[open_]]
        chosen, rows = [int(np.argmax(weight))], []
        for _ in range(PIVOTS):
            rows.append(self.measure(members[chosen[-1]], members))
            chosen.append(int(np.argmax(np.min(rows, axis=0))))
        far = np.array(rows)
        rest = np.ones(len(members), bool)
        rest[chosen[:-1]] = False
        near, least = np.argmin(far, axis=0), np.min(far, axis=0)
        parts = []
        for j in range(len(far)):
            inside = rest & ((near == j) | (far[j] - least <= 2 * self.radius + 1e-9))
            outer = inside & (far[j] > self.radius + 1e-9)
            if not outer.any():  # all of them are linked with this pivot
                continue
            inside &= far[j] >= far[j][outer].min() - self.radius - 1e-9
            parts.append(members[inside])
        if sum(len(p) for p in parts) < 2 * len(members):
            return parts
        return [members[rest]]


def _join_region(table: pa.Table, percent: int) -> pa.Table:
    nodes, at = np.unique(np.array(table.column("node").to_pylist(), np.int64), return_index=True)
    blobs = table.column("shingles")
    roots = Region([np.frombuffer(blobs[int(i)].as_py(), _U) for i in at], percent).join()
    return pa.table({"a": pa.array(nodes), "b": pa.array(nodes[roots])})


def _similarities(own: pd.Series, pivots: pd.Series) -> pd.Series:
    """The similarity of each set with each of the pivots of its region."""

    def one(x: bytes, others: list[bytes]) -> list[float]:
        mine, out = np.frombuffer(x, _U), []
        for other in others:
            common = len(np.intersect1d(mine, np.frombuffer(other, _U), assume_unique=True))
            out.append(common / ((len(x) + len(other)) // 8 - common))
        return out

    return pd.Series([one(x, y) for x, y in zip(own, pivots)])


def _by_key(rows: DataFrame, anchors: DataFrame, met: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` of large components as regions of one window shingle each: linked sets share such a shingle.

    Shingles that exactly the same sets have make one region.
    """
    own = anchors.join(met.select("key"), "key").join(members.select("node"), "node", "left_semi")
    alike = own.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"))
    chosen = alike.groupBy("c", "s", "x").agg(F.min("key").alias("key")).where("c > 1").select("key")
    return own.join(chosen, "key").select("node", F.col("key").alias("component")).join(members.drop("component"), "node")


def _peel(members: DataFrame, percent: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Shrink regions of more than ``most`` shingles in Spark, many balls a round: what links with a pivot leaves,
    but for the rim that may still link with something outside the ball.

    The sets of a region are dealt to as many pieces as it is times too large, each with a copy of the pivots.
    """
    links: list[DataFrame] = []
    similarities, radius = F.pandas_udf(_similarities, "array<double>"), 1 - percent / 100
    turn = 0
    while True:
        sizes = stored(members.groupBy("component").agg(F.sum("n").alias("s"), F.count("*").alias("c"), F.min_by("node", F.xxhash64(F.lit(turn), "node")).alias("lead")).where(F.col("s") > most))
        if not sizes.limit(1).count():
            return members, links
        # As many pivots as have a quarter of ``most`` shingles together, on average.
        pieces = F.ceil(F.col("s") / most).cast("int")
        balls = F.greatest(F.lit(1), F.least(F.lit(BALLS), F.floor(most / 4 * F.col("c") / F.col("s")))).cast("int")
        facts = sizes.select("component", "c", "lead", pieces.alias("pieces"), balls.alias("balls"))
        tagged = stored(lookup(members, "component", facts, members.count()))
        large = tagged.where("pieces is not null").withColumn("piece", F.pmod(F.xxhash64(F.lit(-1), "node"), F.col("pieces")).cast("int"))
        picked = large.where((F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("c")) < F.col("balls")) | (F.col("node") == F.col("lead")))
        pivots = stored(picked.groupBy("component").agg(F.collect_list("node").alias("pn"), F.collect_list("shingles").alias("ps"), F.first("pieces").alias("pieces")))
        copies = pivots.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        far = stored(large.join(copies, ["component", "piece"]).withColumn("js", similarities("shingles", "ps")).drop("ps"))
        each = far.select("component", "node", F.explode(F.arrays_zip("pn", "js")).alias("p")).select("component", "node", "p.pn", (F.col("p.js") * 100 >= percent - 1e-9).alias("linked"), "p.js")
        links.append(each.where("linked").select(F.col("node").alias("a"), F.col("pn").alias("b")))
        rims = each.where("not linked").groupBy("component", "pn").agg(F.max("js").alias("rim")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("pn", "rim"))).alias("rims"))
        rims = rims.join(pivots.select("component", "pieces"), "component").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        inner = F.exists(F.arrays_zip("pn", "js"), lambda p: (p["js"] * 100 >= percent - 1e-9) & F.coalesce(p["js"] > F.try_element_at("rims", p["pn"]) + radius + 1e-9, F.lit(True)))
        kept = far.join(rims, ["component", "piece"], "left").where(~inner & ~F.array_contains("pn", F.col("node"))).select("component", "node", "n", "shingles")
        members = stored(tagged.where("pieces is null").select("component", "node", "n", "shingles").union(kept))
        turn += 1


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, region_shingles: int = 4_000_000, fan_out: int = FAN_OUT) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``; ids are of any type with an order.

    Rows link when 100 * common >= ``percent`` * united shingles of ``k`` words, A-Z lower-cased.
    ``block_bytes`` of text are counted at a time; components of over ``region_shingles`` are parted by
    shingles, and regions that still are over it are first shrunk over all executors.
    """
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = source.schema["id"].dataType
    arrow = to_arrow_type(kind)
    blocks = packed_blocks(source, "text", block_bytes)
    levels, _ = gather(blocks, lambda _, words, first: _count_block(words, first, k), [BITS], _levels, fan_out, block_bytes)
    joined = blocks.select("block", "data").groupBy("block").cogroup(levels.groupBy("block"))
    rows = stored(joined.applyInArrow(lambda t, levels: trimmed(_windows(t, levels, k, percent, arrow)), with_id(kind, "n long, node long, open boolean, keys array<long>, shingles binary")))

    anchors = rows.where("open").select("node", F.explode("keys").alias("key")).distinct()
    met = anchors.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    candidates = connected_components(anchors.join(met, "key").select(F.col("node").alias("a"), "b").distinct())
    # A set is sent once, however many rows and blocks have it.
    members = rows.where("open").groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")).join(candidates, "node").select("component", "node", "n", "shingles")
    weights = rows.where("open").select("node", "n").distinct().join(candidates, "node").groupBy("component").agg(F.sum("n").alias("s"), F.count("*").alias("c")).where("c > 1")
    large = stored(weights.where(F.col("s") > region_shingles).select("component"))
    links: list[DataFrame] = []
    if large.limit(1).count():
        members = stored(members)
        rest = members.join(large, "component", "left_anti")
        parted = stored(_by_key(rows, anchors, met, members.join(large, "component", "left_semi")).select("component", "node", "n", "shingles"))
        shrunk, links = _peel(parted, percent, region_shingles)
        # Components and shingles are both hashes; the sign of a part tells them apart.
        members = rest.withColumn("part", F.lit(0)).union(shrunk.withColumn("part", F.lit(1)))
        linked = members.groupBy("part", "component").applyInArrow(lambda t: trimmed(_join_region(t, percent)), "a long, b long")
        for more in links:
            linked = linked.union(more)
        labels = connected_components(linked)
    else:
        linked = members.groupBy("component").applyInArrow(lambda t: trimmed(_join_region(t, percent)), "a long, b long")
        labels = stored(linked).select(F.col("a").alias("node"), F.col("b").alias("component"))

    ids = rows.select("id", "n", "node")
    lowest = ids.where("node is not null").groupBy("node").agg(F.min("id").alias("copy"))
    named = stored(lowest.join(labels, "node", "left"))
    low = named.where("component is not null").groupBy("component").agg(F.min("copy").alias("low"))
    names = lookup(named, "component", low, named.count()).select("node", F.coalesce("low", "copy").alias("first"))
    out = lookup(ids, "node", names, ids.count())
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))
