"""Chat formatting: turns located by rendering successive prefixes with a black-box template.

A template is any function of a list of turns to a string. Each prefix of a conversation is rendered; where an
output extends the one before, the added part is the turn's span, else the template has rewritten history and
the turn is reported. A turn's text lies where two renderings that differ in this text alone differ; after a
rewrite, texts are looked for in the last output, and one that it no longer has gets no place.

Prefixes of a whole conversation make work that grows with the square of its turns; this holds for the built-in
template too, which keeps the short pieces it has made, so that a prefix is one joining of them. A caller may pass a
template with an incremental form (``Template.add``), which is compared with whole prefixes on probes; then a turn
is rendered once, and a conversation of any length is formatted as a sorted stream in bounded memory.

Rows of a conversation are ordered by turn, then role and text, nulls first; null roles and texts are empty;
rows with a null conversation form one of their own; repeated rows are turns of their own; very long turns and
conversations are rendered whole; an empty table gives no rows. Only the four columns named are read, so others
can clash with nothing and are not returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

Turn = dict[str, str]
#: Control strings of the built-in template (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_OPEN, _MIDDLE, _CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Texts that stand in for a turn's own, to find its place.
_MARKS = ("\u0001", "\u0002")
#: Pieces that the built-in template keeps, and their most characters.
_KEPT, _SHORT = 4096, 4096


def escape(text: str) -> str:
    """Double backslashes and put one behind the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[Turn]) -> str:
    """The built-in template."""
    return "".join([_piece(t) for t in turns])


def _piece(turn: Turn) -> str:
    role, text = turn["role"], turn["text"]
    return (_kept if len(role) + len(text) <= _SHORT else _made)(role, text)


def _made(role: str, text: str) -> str:
    return f"{_OPEN}{escape(role)}{_MIDDLE}{escape(text)}{_CLOSE}"


_kept = lru_cache(_KEPT)(_made)


def read_turn(span: str) -> tuple[str, str, int, int]:
    """Role and text of one rendered turn, and where the escaped text lies in it."""
    at = span.find(_MIDDLE, len(_OPEN))
    begin, end = at + len(_MIDDLE), len(span) - len(_CLOSE)
    if at < 0 or not (span.startswith(_OPEN) and span.endswith(_CLOSE)):
        raise ValueError("not a turn of the built-in template")
    return unescape(span[len(_OPEN) : at]), unescape(span[begin:end]), begin, end


@dataclass(frozen=True)
class Template:
    """A renderer of whole conversations; what its incremental form adds for a turn, given the number of turns
    before it; and how a text is read back from where it stands in the output."""

    render: Callable[[list[Turn]], str]
    add: Callable[[int, Turn], str] | None = None
    unescape: Callable[[str], str] = str

    def verify(self) -> None:
        """Raise where the incremental form differs from whole prefixes on probes."""
        turns = [{"role": r, "text": t} for r, t in (("system", "s"), ("user", "</s>[INST] a\\ [/INST]"), ("assistant", ""), ("user", "é\n"), ("assistant", "<s>"), ("", " "))]
        for begin in (0, 1):
            built = self.render([])
            for k, turn in enumerate(turns[begin:]):
                built += self.add(k, turn)
                if built != self.render(turns[begin : begin + k + 1]):
                    raise ValueError(f"the incremental form of the template differs from it at turn {k}")


BUILT_IN = Template(render, unescape=unescape)
#: The built-in template for streams; the query doesn't use it.
STREAMED = Template(render, lambda k, turn: _piece(turn), unescape)


def _common(a: str, b: str) -> int:
    """Characters that two strings begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def _place(whole: str, variant: Callable[[str], str]) -> tuple[int, int] | None:
    """Where the text that ``variant`` puts in lies in ``whole``; None if the output doesn't have it."""
    one, two = map(variant, _MARKS)
    if one == two:
        return None
    before, behind = _common(one, two), _common(one[::-1], two[::-1])
    behind = min(behind, len(one) - before, len(whole) - before)
    return (before, len(whole) - behind) if whole[:before] == one[:before] and whole[len(whole) - behind :] == one[len(one) - behind :] else None


def locate_turns(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The whole rendering, each turn's span in it, and the turns whose rendering changed what stood before."""
    before, spans, rewrites = template([]), [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        common = len(before)
        if not now.startswith(before):
            rewrites.append(k - 1)
            common = _common(before, now)
            spans = [(min(a, common), min(b, common)) for a, b in spans]
        spans.append((common, len(now)))
        before = now
    return before, spans, rewrites


def _black_box(template: Template, turns: list[Turn], trained: str) -> Iterator[tuple]:
    """Rows of one conversation, every prefix of which is rendered."""
    whole, spans, rewrites = locate_turns(template.render, turns)
    if spans and spans[0][0]:
        yield -1, None, 0, spans[0][0], None, None, False, False, whole[: spans[0][0]]
    last = max(rewrites, default=-1)
    for k, (a, b) in enumerate(spans):
        with_text = lambda text, k=k: {**turns[k], "text": text}
        if k < last:  # history was rewritten later on: look in the last output
            at = _place(whole, lambda text, k=k: template.render([*turns[:k], with_text(text), *turns[k + 1 :]]))
        else:
            at = _place(whole[:b], lambda text, k=k: template.render([*turns[:k], with_text(text)]))
        yield k, turns[k]["role"], a, b, *(at or (None, None)), turns[k]["role"] == trained and at is not None, k in rewrites, whole[a:b]


_ROW = "place long, role string, start long, end long, text_start long, text_end long, trained boolean, rewrites boolean, piece string"
_KINDS = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_(), pa.string()]
#: Turns and characters of a batch that is handed on.
_ROWS, _CHARS = 2_000, 4 << 20


def format_turns(rows: DataFrame, template: Template | Callable[[list[Turn]], str] = BUILT_IN, trained: str = "assistant") -> DataFrame:
    """A row per turn, those of a conversation in order in one partition: conv_id, place (from 0; -1 for what
    stands before the first turn), role, start and end of its span in the conversation's output, text_start and
    text_end of its text there (null where it is gone), trained (the text is under the loss mask), rewrites (its
    rendering changed what stood before) and piece, the output's part. Places are in code points."""
    own = template if isinstance(template, Template) else Template(template)
    if own.add is not None:
        own.verify()
    source = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = to_arrow_type(source.schema["conv_id"].dataType)
    ordered = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def turns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def stream(conversation, group: Iterator[tuple]) -> Iterator[tuple]:
        at = len(own.render([]))
        if at:
            yield conversation, -1, None, 0, at, None, None, False, False, own.render([])
        for k, (_, role, text) in enumerate(group):
            turn = {"role": role, "text": text}
            piece = own.add(k, turn)
            place = _place(piece, lambda text, k=k, turn=turn: own.add(k, {**turn, "text": text}))
            a, b = (at + place[0], at + place[1]) if place else (None, None)
            yield conversation, k, role, at, at + len(piece), a, b, role == trained and place is not None, False, piece
            at += len(piece)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conversation, group in groupby(turns_of(batches), key=lambda r: r[0]):
            if own.add is not None:
                yield from stream(conversation, group)
            else:
                turns = [{"role": role, "text": text} for _, role, text in group]
                yield from ((conversation, *row) for row in _black_box(own, turns, trained))

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*waiting), [kind, *_KINDS])], ["conv_id", *(p.split()[0] for p in _ROW.split(", "))])
        for row in made(batches):
            waiting.append(row)
            held += len(row[-1])
            if len(waiting) == _ROWS or held > _CHARS:
                yield pack()
                waiting, held = [], 0
        if waiting:
            yield pack()

    return ordered.mapInArrow(form, f"conv_id {source.schema['conv_id'].dataType.simpleString()}, {_ROW}")


def read_back(turns: DataFrame, read: Callable[[str], tuple] | None = read_turn, plain: Callable[[str], str] = unescape) -> DataFrame:
    """A row per conversation of ``format_turns``: n_turns, turns_sha256 (role, line end, text, line end of each
    turn), loss_chars and loss_sha256 (text under the loss mask), formatted_chars and rewrites.

    Role and text are what ``read`` finds in a turn's piece; without it, the turn's role and what stands in the
    text's place. ``plain`` undoes the template's escapes. Turns are read as a stream, in their order.
    """
    kind = to_arrow_type(turns.schema["conv_id"].dataType)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conversation, group in groupby(rows_of(batches), key=lambda r: r[0]):
            whole, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = size = rewritten = 0
            for _, place, role, start, end, a, b, trained, rewrites, piece in group:
                size, rewritten = max(size, end), rewritten + rewrites
                if place < 0:
                    continue
                body = plain(piece[max(a - start, 0) : max(b - start, 0)]) if a is not None else ""
                role, text = read(piece)[:2] if read else (role, body)
                whole.update(f"{role}\n{text}\n".encode())
                n += 1
                if trained:
                    loss.update(body.encode())
                    chars += len(body)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conversation, n, whole.hexdigest(), chars, loss.hexdigest(), size, rewritten), [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return turns.mapInArrow(digest, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")


def format_conversations(rows: DataFrame, template: Template | Callable[[list[Turn]], str] = BUILT_IN, trained: str = "assistant", read: Callable[[str], tuple] | None = read_turn) -> DataFrame:
    """A row per conversation: digests of its turns and of the text under the loss mask, read from the output."""
    return read_back(format_turns(rows, template, trained), read)
