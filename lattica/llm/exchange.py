"""Blocks of packed rows, and figures of sorted keys gathered over all blocks with bounded fan-out.

Rows are packed into blocks where they are scanned, without a shuffle, and the blocks are written to the
shared folder once; so no row decides where it goes, and equal rows or ids make no hot block. Every block then
states its sorted keys with counts and is told a value for each of them that comes from all blocks.

To let every block meet every range of keys at once takes as many rows as there are blocks times ranges, a
square of the input. Here a block cuts its keys into at most ``FAN_OUT`` ranges; teams of blocks are merged, cut
again, and so on, until one range of all blocks is one unit; answers go back the same way. Each level has at
most ``FAN_OUT`` rows a block, and the number of levels is the logarithm of the input. Every unit, on every
level, holds about as many keys as one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import trimmed
from lattica.llm.textkit import pack_counts, pack_sorted, row_chunks, text_buffers, unpack_counts, unpack_sorted, word_hashes, word_spans
from lattica.session import cut, size_in_bytes, stored

_U = np.uint64
#: Most ranges that a unit's keys are cut into on one level.
FAN_OUT = 512
BLOCK_BYTES = 6 << 20
#: What a unit answers about one order of keys, beside figures of its own.
Finish = Callable[[list[np.ndarray]], tuple[list[np.ndarray], list[int]]]


def packed_blocks(rows: DataFrame, text_column: str, block_bytes: int = BLOCK_BYTES, least_bytes: int = 256 << 10) -> DataFrame:
    """``(block, bytes, data)``: the rows in blocks of about ``block_bytes`` of text, a longer text in one of its
    own, as compressed Arrow streams in the shared folder.

    A small input gets as many blocks as there are shuffle partitions, if each has ``least_bytes``.
    """
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = min(block_bytes, max(least_bytes, size_in_bytes(rows) // wanted))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        waiting: list[pa.RecordBatch] = []
        held = 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
                for part in waiting:
                    writer.write_batch(part)
            waiting.clear()
            return trimmed(pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), pa.array([held], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "bytes", "data"]))

        for batch in batches:
            offsets = text_buffers(batch.column(batch.schema.get_field_index(text_column)))[1]
            even = -(-int(offsets[-1]) // max(1, round(int(offsets[-1]) / limit)))  # pieces of about one size
            for lo, hi in row_chunks(offsets, max(even, 1)):
                size = int(offsets[hi] - offsets[lo])
                if waiting and held + size > 5 * limit // 4:
                    yield block()
                    made, held = made + 1, 0
                waiting.append(batch.slice(lo, hi - lo))
                held += size
        if waiting:
            yield block()

    return cut(rows.mapInArrow(pack, "block long, bytes long, data binary"))


def unpacked(data: pa.Scalar, text_column: str = "text") -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of one block, the hashes of their words, A-Z lower-cased, and for each row the index of its first
    word (one more at the end)."""
    table = pa.ipc.open_stream(data.as_buffer()).read_all()
    text, offsets = text_buffers(table.column(text_column))
    hashes, counts = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
    for lo, hi in row_chunks(offsets):
        part = text[offsets[lo] : offsets[hi]]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        hashes.append(word_hashes(part, starts, ends))
        counts.append(np.diff(first))
    return table.drop_columns([text_column]), np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def levels_for(units: int, fan_out: int = FAN_OUT) -> tuple[int, int]:
    """How many levels a number of units takes, and the fan-out of each."""
    levels = 1
    while fan_out**levels < units:
        levels += 1
    radix = 1
    while radix**levels < units:
        radix += 1
    return levels, radix


def _cuts(keys: np.ndarray, bits: int, unit: int, radix: int, level: int) -> np.ndarray:
    """Where the ranges ``unit * radix`` and on, of ``radix ** level`` even ones, begin in sorted keys."""
    whole = radix**level
    edges = [-(-((unit * radix + i) << bits) // whole) for i in range(1, radix)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, _U)), [len(keys)]]).astype(np.int64)


def _split(keys: list[np.ndarray], counts: list[np.ndarray], bits: list[int], unit: int, team: int, child: int, radix: int, level: int) -> list[tuple]:
    """Rows of one unit for the next level, one for each range that has keys."""
    cuts = [_cuts(k, b, unit, radix, level) for k, b in zip(keys, bits)]
    rows = []
    for i in range(radix):
        parts = [(c[i], c[i + 1]) for c in cuts]
        if any(b > a for a, b in parts):
            rows.append((unit * radix + i, team, child, [pack_sorted(k[a:b]) for k, (a, b) in zip(keys, parts)], [pack_counts(n[a:b]) for n, (a, b) in zip(counts, parts)]))
    return rows


_UP = "unit long, team long, child long, keys array<binary>, counts array<binary>"
_DOWN = "unit long, team long, place int, answer array<binary>, note array<long>"


def _up_table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["unit", "team", "child", "keys", "counts"])


def _down_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(("unit", "team", "place", "answer", "note"), kinds))})


def _merge(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of one order with summed counts; for each child's keys their places, and where children begin."""
    parts = [unpack_sorted(row[order].as_py()) for row in table.column("keys")]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([unpack_counts(row[order].as_py()) for row in table.column("counts")])
    total = np.bincount(at, weights=counts, minlength=len(keys)).astype(_U) if len(at) else np.zeros(0, _U)
    return keys, total, at, np.cumsum([0, *map(len, parts)])


def _answers(table: pa.Table, radix: int, values: list[np.ndarray], merged: list[tuple]) -> list[tuple]:
    """Rows that tell each child of a unit the values of its keys."""
    unit = table.column("unit")[0].as_py()
    rows = []
    for i, child in enumerate(table.column("child").to_pylist()):
        own = [pack_counts(v[at[begins[i] : begins[i + 1]]]) for v, (_, _, at, begins) in zip(values, merged)]
        rows.append((unit // radix, child, unit % radix, own, None))
    return rows


def _joiner(bits: list[int], levels: int, radix: int, level: int) -> Callable[[pa.Table], pa.Table]:
    """The merge of one unit of a level, cut for the next one."""

    def join(table: pa.Table) -> pa.Table:
        unit, team = table.column("unit")[0].as_py(), table.column("team")[0].as_py()
        merged = [_merge(table, k) for k in range(len(bits))]
        rows = _split([m[0] for m in merged], [m[1] for m in merged], bits, unit, team % radix ** (levels - level - 1), team, radix, level + 1)
        return trimmed(pa.Table.from_batches([_up_table(rows)]))

    return join


def gather(blocks: DataFrame, keys_of: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[list[np.ndarray], list[np.ndarray]]], bits: list[int], finish: Finish, fan_out: int = FAN_OUT, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[int]]:
    """Answers ``(block, place, answer)`` for every block and the sums of all units' own figures.

    ``keys_of`` gives, of what ``unpacked`` does, a block's sorted distinct keys of each order, of ``bits`` bits, and their counts; ``finish``
    turns the summed counts of a unit into values for its keys. A block's answers, by place, hold the values of
    its keys one after the other.
    """
    facts = blocks.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.count_distinct(F.shiftright("block", 32)).alias("parts")).first()
    wanted = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = max(1, -(-(facts["bytes"] or 0) // block_bytes), min(wanted, facts["n"]))
    levels, radix = levels_for(units, fan_out)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, number, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                keys, counts = keys_of(*unpacked(data))
                if rows := _split(keys, counts, bits, 0, number % radix ** (levels - 1), block, radix, 1):
                    yield trimmed(_up_table(rows))

    numbered = blocks.select("block", "data", F.pmod(F.xxhash64("block"), F.lit(1 << 62)).alias("number"))
    if facts["parts"] < min(facts["n"], blocks.sparkSession.sparkContext.defaultParallelism):  # few scan tasks made them all
        numbered = numbered.repartition("block")
    up = [numbered.mapInArrow(begin, _UP)]
    for level in range(1, levels):
        up[-1] = stored(up[-1])
        up.append(up[-1].groupBy("unit", "team").applyInArrow(_joiner(bits, levels, radix, level), _UP))

    def top(table: pa.Table) -> pa.Table:
        merged = [_merge(table, k) for k in range(len(bits))]
        values, note = finish([m[1] for m in merged])
        return trimmed(_down_table([*_answers(table, radix, values, merged), (-1, -1, -1, [], note)]))

    down = stored(up[-1].groupBy("unit", "team").applyInArrow(top, _DOWN))
    notes = down.where("unit < 0").select(F.posexplode("note")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    down = down.where("unit >= 0")
    for level in range(levels - 1, 0, -1):

        def back(table: pa.Table, answers: pa.Table) -> pa.Table:
            merged = [_merge(table, k) for k in range(len(bits))]
            return trimmed(_down_table(_answers(table, radix, values_of(answers, len(bits)), merged)))

        down = stored(up[level - 1].groupBy("unit", "team").cogroup(down.groupBy("unit", "team")).applyInArrow(back, _DOWN))
    return down.select(F.col("team").alias("block"), "place", "answer"), [r["n"] for r in notes]


def values_of(answers: pa.Table, orders: int) -> list[np.ndarray]:
    """The values of a unit's or a block's keys, order by order."""
    rows = answers.column("answer")
    by_place = np.argsort(np.array(answers.column("place").to_pylist(), np.int64))
    return [np.concatenate([np.zeros(0, _U), *(unpack_counts(rows[int(i)][k].as_py()) for i in by_place)]) for k in range(orders)]
