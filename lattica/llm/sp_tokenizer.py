"""SentencePiece encoding and decoding with a backend of the tokenizers library.

The model's protobuf is parsed here; normaliser, white-space marker, scores or merges and byte fallback are
rebuilt, and parity with the original library is verified on probes whenever a model is loaded. Batches are
encoded by several threads. Null and empty texts have no tokens; very long texts are encoded whole;
repeated rows are encoded alike; an empty table gives no rows; the input stays inside ``row``, so its names clash
with nothing. Decoding gives null for null ids, the empty text for none, and an error for ids outside the model.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

os.environ.setdefault("RAYON_NUM_THREADS", "2")  # threads of a batch; an executor runs one worker a core
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from lattica.llm.common import field, map_rows

MARK = "▁"
#: Distinct words whose ids a worker keeps.
CACHE = 120_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Piece types and model types of the format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts on which a loaded model must agree with the original library.
PROBES = ("", " ", "a", "  two  spaces ", "Hello, world! 12345", "naïve café — ß ü ñ", "日本語 and 🙂‍", "tab\tline\nend\r\n", "<s> </s> <unk> <0x41>", "▁mark ▁▁", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 50, "\u0000\u0001", "é", "   ")


def _fields(data: bytes):
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What the protobuf says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse_model(data: bytes) -> Model:
    out = Model([])
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            out.kind, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            out.charsmap = own.get(2, b"")
            out.dummy_prefix, out.squeeze, out.escape = (bool(own.get(i, 1)) for i in (3, 4, 5))
    return out


class Encoder:
    """Encodes and decodes with one model; ``data`` is the model file's content."""

    def __init__(self, data: bytes, verify: bool = False):
        self.model = parse_model(data)
        self.pieces = self.model.pieces
        self.bytes = np.array([kind == BYTE for _, _, kind in self.pieces])
        usable = [p for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        #: No piece has a marker behind another character, so merges never cross the start of a marker run.
        self.splits = self.model.escape and not any(MARK in p.lstrip(MARK) for p in usable)
        self.cuts = self.splits and not self.model.charsmap and not self.model.squeeze
        self.word = self._build(False, word=True)
        #: Pieces as they stand in a word; bytes of the fallback are decoded by the backend.
        self.plain = [p if kind == NORMAL else "\0" for p, _, kind in self.pieces]
        self.known: dict[str, bytes] = {}
        self.lossy: set[str] = set()
        if verify:
            self.verify(data)

    @cached_property
    def first(self) -> Tokenizer:
        """The backend for whole texts; not built where words are encoded alone."""
        return self._build(self.model.dummy_prefix)

    def _build(self, prefix: bool, word: bool = False) -> Tokenizer:
        m = self.model
        unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, m.byte_fallback)
        elif m.kind == BPE:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self._merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
        out = Tokenizer(core)
        steps: list = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")] if m.squeeze else []
        steps += [normalizers.Prepend(MARK)] if prefix else []
        out.normalizer = normalizers.Sequence([*steps, *([normalizers.Replace(" ", MARK)] if m.escape else [])])
        if self.splits and not word:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix and not word else [])])
        own = [AddedToken(p, normalized=False, special=False) for p, _, kind in self.pieces if kind == USER]
        if own:
            out.add_tokens(own)
        return out

    def _merges(self) -> list[tuple[str, str]]:
        """Every way to make a piece of two others, by the piece's score, best first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        ways = []
        for i, (p, score, kind) in enumerate(self.pieces):
            if kind == NORMAL and len(p) > 1:
                ways += [(-score, i, ids[p[:k]], ids[p[k:]]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        return [(self.pieces[a][0], self.pieces[b][0]) for _, _, a, b in sorted(ways)]

    def verify(self, data: bytes) -> None:
        """Raise where the original library encodes or decodes a probe otherwise."""
        import sentencepiece

        original = sentencepiece.SentencePieceProcessor(model_proto=data)
        for text, ids in zip(PROBES, self.encode(list(PROBES))):
            if original.encode(text) != ids.tolist() or original.decode(ids.tolist()) != self.decode([ids])[0]:
                raise ValueError(f"no parity on {text!r}: {original.encode(text)} and {ids.tolist()}")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        return [np.frombuffer(i, "<i4") for i, _ in self.encode_checked(texts)]

    def encode_checked(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Little-endian ids of each text and whether decoding them gives the text back.

        Where no piece crosses the start of a marker run, each distinct run with its word is encoded and
        decoded once and kept among at most ``CACHE`` others; else whole texts are.
        """
        if not self.cuts:
            ids = [np.array(e.ids, "<i4") for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]
            return [(i.tobytes(), t == d) for i, t, d in zip(ids, texts, self.decode(ids))]
        prefix = MARK if self.model.dummy_prefix else ""
        words = [_WORD.findall(f"{prefix}{t.replace(' ', MARK)}") if t else [] for t in texts]
        distinct = set().union(*words) if words else set()
        missing = [w for w in distinct if w not in self.known]
        if len(self.known) + len(missing) > CACHE:  # words that this batch has again stay
            self.known = {w: i for w in distinct if (i := self.known.get(w)) is not None}
            self.lossy &= distinct
        for w, encoding in zip(missing, self.word.encode_batch_fast(missing, add_special_tokens=False)):
            ids = encoding.ids
            self.known[w] = array("i", ids).tobytes()
            if "".join(map(self.plain.__getitem__, ids)) != w and self.word.decode(ids, skip_special_tokens=False) != w.replace(MARK, " "):
                self.lossy.add(w)
        lossy = lambda own: bool(self.lossy) and not self.lossy.isdisjoint(own)
        return [(b"".join(map(self.known.__getitem__, own)), MARK not in t and not lossy(own)) for t, own in zip(texts, words)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.first.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


_encoders: dict[str, Encoder] = {}


def _model(df: DataFrame, model_path: str):
    """The model file's name and content, read and verified on the driver and sent to the workers."""
    with open(model_path, "rb") as file:
        data = file.read()
    Encoder(data, verify=True)
    return hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)


def _encoder(name: str, shipped) -> Encoder:
    """The encoder of one model, built once a worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(shipped.value)
    return _encoders[name]


def encode_texts(docs: DataFrame, model_path: str, text_column: str = "text", columns: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """``row`` with n_tokens, n_bytes (tokens of the byte fallback), ids_sha256 (of little-endian 32-bit ids),
    exact (decoding gives the text back) and, if asked for, ids. The model file is read on the driver."""
    name, shipped = _model(docs, model_path)

    def encode(rows: pa.StructArray) -> dict:
        own = _encoder(name, shipped)
        texts = [t or "" for t in field(rows, text_column).to_pylist()]
        checked = own.encode_checked(texts)
        ids = [np.frombuffer(i, "<i4") for i, _ in checked]
        out = {
            "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
            "n_bytes": pa.array([int(own.bytes[i].sum()) for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in checked], pa.string()),
            "exact": pa.array([x for _, x in checked], pa.bool_()),
        }
        return out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})

    return map_rows(docs, encode, "n_tokens long, n_bytes long, ids_sha256 string, exact boolean" + (", ids array<int>" if with_ids else ""), columns, most_bytes=1 << 19)


def decode_ids(encoded: DataFrame, model_path: str, ids_column: str = "ids", columns: list[str] | None = None) -> DataFrame:
    """``row`` with decoded: the text of each row's ids, by the same backend."""
    name, shipped = _model(encoded, model_path)

    def decode(rows: pa.StructArray) -> dict:
        ids = field(rows, ids_column).to_pylist()
        own = _encoder(name, shipped)
        if any(i is None or not 0 <= i < len(own.pieces) for row in ids for i in row or ()):
            raise ValueError("an id outside the model")
        texts = own.decode([np.array(row or [], np.int64) for row in ids])
        return {"decoded": pa.array([None if row is None else text for row, text in zip(ids, texts)], pa.string())}

    return map_rows(encoded, decode, "decoded string", columns, most_bytes=1 << 19)
