"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of bytes outside a separator set. All separators used here are ASCII, so
working on UTF-8 bytes gives the same words as working on code points. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _MULT = _U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_BYTE_VALUE_LOWER = _BYTE_VALUE.copy()
_BYTE_VALUE_LOWER[ord("A") : ord("Z") + 1] = _BYTE_VALUE[ord("a") : ord("z") + 1]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes each; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] |= inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; A-Z hash as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, _U)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_BYTE_VALUE_LOWER if lower else _BYTE_VALUE)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and for each row the index of its first run."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    out = words[at]
    for j in range(1, k):
        out = mix(out * _MULT + words[at + j])
    return out, begins


def code_points_before(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points of one row's bytes before each byte position."""
    sums = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return sums[positions]


def squeeze(data: bytes) -> bytes:
    """Compressed bytes with their size in front."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def unsqueeze(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True) if blob else b""


def pack_counts(values: np.ndarray) -> bytes:
    """Unsigned integers, byte plane by byte plane."""
    if not len(values):
        return b""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, _U).view(np.uint8).reshape(-1, 8)[:, :width].T
    return squeeze(bytes([width]) + np.ascontiguousarray(planes).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, _U)
    data = np.frombuffer(unsqueeze(blob), np.uint8)
    width = int(data[0])
    wide = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    wide[:, :width] = data[1:].reshape(width, -1).T
    return wide.view(_U).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences."""
    return pack_counts(np.diff(keys, prepend=_U(0))) if len(keys) else b""


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The keys that ``pack_sorted`` packed."""
    return np.cumsum(unpack_counts(blob), dtype=_U)
