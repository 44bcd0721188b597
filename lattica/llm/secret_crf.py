"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags white-space separated tokens as begin, inside or outside of a secret from their shape, the
neighbouring tokens and the file, and is decoded by Viterbi. It is fitted on a bounded sample of documents
(``fit_rows``, one row an id, those of smallest hash) labelled by the patterns, of each the stretches around its
first ``matches`` pattern matches and one from its middle, mixed with phrases made from a seed; stretches and
phrases have at most ``SNIPPET`` tokens. Texts of which no token can score above "outside" are not decoded, as their best path is known. Whole texts are
scanned; null and empty texts have no spans; repeated rows are scanned alike.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import bounded_sample, field, map_rows

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns (fixed values); letters of ASSIGN's keywords stand in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_ONLY = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
Span = tuple[str, int, int]


def base_spans(text: str, data: bytes | None = None) -> list[Span]:
    """Pattern matches in code points, by start and then kind."""
    data = text.encode() if data is None else data
    out: list[Span] = []
    folded = data.lower()
    if any(k in folded for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"h" * 24 in data.translate(_HEX_ONLY):
        out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- features -------------------------------------------------------------------------------------------

BUCKETS = 1 << 13
_SHAPE = bytes(ord("0") if 48 <= b < 58 else ord("A") if 65 <= b < 91 else ord("a") if 97 <= b < 123 or b >= 128 else b for b in range(256))
_TRIM = b"\"'`,;.:!?()[]{}<>*#$%&|"
_DIGITS = frozenset(b"0123456789")


def _bucket(name: str) -> int:
    h = 14695981039346656037
    for b in name.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return 1 + (h ^ (h >> 29)) % (BUCKETS - 1)


def bare(word: bytes) -> bytes:
    return word.strip(_TRIM).lower()


def core_of(word: bytes) -> bytes:
    core = word.strip(_TRIM)
    return core.rpartition(b"=")[2] or core


def distinct(core: bytes) -> int:
    return min(len(set(core)) // 3, 8)


def own_features(word: bytes, lexicon: frozenset) -> list[str]:
    """Features of a token by itself."""
    core = core_of(word)
    digits = sum(b in _DIGITS for b in core)
    kinds = len({_SHAPE[b] for b in core if _SHAPE[b] in b"aA0"})
    shape = re.sub(rb"(.)\1+", rb"\1", core.translate(_SHAPE))[:6].decode(errors="replace")
    turns = sum(_SHAPE[a] != _SHAPE[b] for a, b in zip(core, core[1:]))
    out = [f"len{min(len(core) // 4, 10)}", f"shape{shape}", f"digits{min(4, 5 * digits // max(len(core), 1))}", f"kinds{kinds}", f"turns{min(turns // 2, 6)}", f"distinct{distinct(core)}"]
    out.append(f"mixed{kinds >= 2 and digits > 1}{len(core) >= 12}{turns >= 4}")
    if any(b in b"@/:." for b in core):
        out.append("address")
    return [*out, f"word{bare(word).decode(errors='replace')}"] if bare(word) in lexicon else out


def neighbour_features(word: bytes, lexicon: frozenset, side: str) -> list[str]:
    name = bare(word)
    end = word[-1:].decode("latin-1") if word[-1:] in (b"=", b":") else ""
    return [f"{side}end{end}", f"{side}{name.decode(errors='replace') if name in lexicon else 'other'}", *([f"{side}only{word.decode('latin-1')}"] if not name and len(word) < 3 else [])]


def file_feature(words: list[bytes]) -> str:
    """A bucket of how many tokens of the file carry assignments."""
    marks = words.count(b"=") + words.count(b":") + words.count(b":=")
    return f"file{min(3, marks)}"


# ---- the field ------------------------------------------------------------------------------------------

B, I, O = 0, 1, 2  # noqa: E741
_NEVER = -1e9


@dataclass
class Field:
    """Weights of (feature, tag), transitions between tags, and the words that count by name."""

    weights: np.ndarray
    moves: np.ndarray
    lexicon: frozenset

    def rows(self, names: list[str]) -> np.ndarray:
        return self.weights[[_bucket(n) for n in names]].sum(axis=0)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of one sequence."""
    n = len(scores)
    back = np.zeros((n, 3), np.int8)
    now = scores[0].tolist()
    now[I] = _NEVER
    steps, rows = moves.tolist(), scores.tolist()
    for t in range(1, n):
        following = []
        for j in range(3):
            a, b, c = now[0] + steps[0][j], now[1] + steps[1][j], now[2] + steps[2][j]
            k = 0 if a >= b and a >= c else 1 if b >= c else 2
            back[t, j] = k
            following.append((a, b, c)[k] + rows[t][j])
        now = following
    tags = np.zeros(n, np.int64)
    tags[-1] = int(np.argmax(now))
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


class _Words(dict):
    """Token to row of a score table; a miss adds the token."""

    def __init__(self, model: Field):
        super().__init__()
        self.model, self.table, self.known = model, [], {}

    def __missing__(self, word: bytes) -> int:
        plain = len(word) < 20 and not any(b in _DIGITS for b in word)
        # words of one shape and as many distinct bytes have the same features
        key = word if not plain or bare(word) in self.model.lexicon else (word.translate(_SHAPE), distinct(core_of(word)))
        at = self.known.get(key)
        if at is None:
            m = self.model
            parts = (own_features(word, m.lexicon), neighbour_features(word, m.lexicon, "before"), neighbour_features(word, m.lexicon, "after"))
            at = self.known[key] = len(self.table)
            self.table.append(np.stack([m.rows(p) for p in parts]))
        self[word] = at
        return at

    def scores(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 200_000 or len(self.table) > 20_000:
            self.clear()
            self.table, self.known = [], {}
            self.array = None
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if getattr(self, "array", None) is None or len(self.array) < len(self.table):
            self.array = np.array(self.table)
        got = self.array[at]
        out = got[:, 0].copy()
        out[1:] += got[:-1, 1]
        out[:-1] += got[1:, 2]
        return out + self.model.rows([file_feature(words)])


def tag_tokens(model: Field, table: _Words, words: list[bytes]) -> np.ndarray | None:
    """Tags of a file's tokens; None if all are outside."""
    scores = table.scores(words)
    reach = max(0.0, float(model.moves[model.moves > _NEVER / 2].max() - model.moves[O, O]))
    gain = np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + reach
    if not (gain > -reach - 1e-6).any():
        return None
    tags = viterbi(scores, model.moves)
    return tags if (tags != O).any() else None


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def crf_spans(model: Field, table: _Words, text: str, data: bytes) -> list[Span]:
    """Spans of tagged secrets, without the punctuation and the name around a value."""
    words = data.split()
    tags = tag_tokens(model, table, words) if words else None
    if tags is None:
        return []
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out: list[Span] = []
    for i in np.flatnonzero(tags != O):
        if tags[i] == I and out:
            out[-1] = ("crf", out[-1][1], places[i][1])
        else:
            out.append(("crf", *places[i]))
    trimmed = []
    for kind, a, b in out:
        if m := re.match(r"[\w\"'.-]*[:=]+(?=.{6})", text[a:b]):
            a += m.end()
        while a < b and text[a] in _TRIM.decode():
            a += 1
        while b > a and text[b - 1] in _TRIM.decode():
            b -= 1
        if b - a >= 6:
            trimmed.append((kind, a, b))
    return trimmed


# ---- fitting --------------------------------------------------------------------------------------------

SNIPPET = 16


def snippets(text: str, matches: int = 3) -> list[tuple[list[bytes], list[int], str]]:
    """Tokens, tags and file feature around the first ``matches`` pattern matches of a text, and one stretch from its
    middle; the bound keeps a long list of keys from being most of what is learned."""
    places = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not places:
        return []
    words = [text[a:b].encode() for a, b in places]
    tags, centres = [O] * len(words), []
    for kind, a, b in base_spans(text):
        if kind == "assign":
            a = b - len(ASSIGN.match(text, a)[2])
        inside = [i for i, (x, y) in enumerate(places) if x < b and y > a]
        for k, i in enumerate(inside):
            tags[i] = B if k == 0 and tags[i] == O else tags[i] if tags[i] != O else I
        centres += inside[:1]
    name = file_feature(words)
    out = []
    for c in [*centres[:matches], len(words) // 2]:
        lo = max(0, c - SNIPPET // 2)
        out.append((words[lo : lo + SNIPPET], tags[lo : lo + SNIPPET], name))
    return out


def made_phrases(n: int, seed: int = 7) -> list[tuple[list[bytes], list[int], str]]:
    """Secrets of many forms among plain words, and decoys that are none."""
    draw = random.Random(seed)
    letters, upper, hexes = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    some = lambda alphabet, low, high: "".join(draw.choice(alphabet) for _ in range(draw.randint(low, high)))
    secret = lambda: draw.choice([lambda: some(hexes, 20, 48), lambda: some(upper, 16, 44), lambda: "AKIA" + some(upper[:26] + "0123456789", 16, 16), lambda: some(letters, 20, 40)])()
    decoy = lambda: draw.choice([lambda: f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}", lambda: some("0123456789", 4, 18), lambda: f"{some('abcdefghijklmnop', 3, 8)}@example.com", lambda: ".".join(str(draw.randint(1, 255)) for _ in range(4)), lambda: f"https://{some('abcdefgh', 4, 9)}.example.org/{some(letters[:26], 3, 9)}/{draw.randint(1, 999)}", lambda: f"2024-0{draw.randint(1, 9)}-1{draw.randint(0, 9)}", lambda: f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}", lambda: some(letters[:26], 14, 30), lambda: f"{some(letters[:26], 3, 9)}-{some(letters[:26], 3, 9)}"])()
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(draw.randint(2, 5)):
            plain = [some(letters[:26], 1, 9).encode() for _ in range(draw.randint(1, 4))]
            words, tags = words + plain, tags + [O] * len(plain)
            if draw.random() < 0.5:
                key, value = draw.choice(["password", "passwd", "secret", "token", "api_key", "key", "auth", "bearer", "pwd", "credential"]), secret()
                quote = draw.choice(["", '"', "'"])
                form = draw.choice([[f"{key}:", f"{quote}{value}{quote}"], [key, "=", f"{quote}{value}{quote}"], [f"{key}={value}"], [key, value], [value]])
                words += [x.encode() for x in form]
                tags += [O] * (len(form) - 1) + [B]
            else:
                more = [x.encode() for x in decoy().split()]
                words, tags = words + more, tags + [O] * len(more)
        out.append((words[:SNIPPET], tags[:SNIPPET], file_feature(words)))
    return out


def fit_field(data: list[tuple[list[bytes], list[int], str]], rounds: int = 60, ridge: float = 1e-3, named: int = 300) -> Field:
    """Maximum likelihood by adaptive gradient steps over all snippets at once."""
    close: Counter = Counter()
    for words, tags, _ in data:
        for i, t in enumerate(tags):
            if t != O:
                close.update(bare(w) for w in words[max(0, i - 2) : i] if w.strip(_TRIM).isalpha() or b"_" in w)
    lexicon = frozenset(w for w, n in sorted(close.items(), key=lambda x: (-x[1], x[0]))[:named] if w and n >= 5)
    S, L, K = len(data), SNIPPET, 20
    ids, gold, mask = np.zeros((S, L, K), np.int64), np.full((S, L), O), np.zeros((S, L), bool)
    for s, (words, tags, name) in enumerate(data):
        for t, w in enumerate(words):
            names = own_features(w, lexicon) + [name]
            names += neighbour_features(words[t - 1], lexicon, "before") if t else []
            names += neighbour_features(words[t + 1], lexicon, "after") if t + 1 < len(words) else []
            ids[s, t, : len(names)] = [_bucket(n) for n in names][:K]
        gold[s, : len(tags)], mask[s, : len(words)] = tags, True
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    moves[O, I] = _NEVER
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full((3, 3), 1e-6)
    lengths = mask.sum(axis=1)
    flat, valid = ids.reshape(-1), (ids > 0).reshape(-1)
    hot = np.eye(3)[gold] * mask[..., None]
    fuse = lambda x: np.log(np.exp(x - (m := x.max(axis=1, keepdims=True))).sum(axis=1)) + m[:, 0]
    for _ in range(rounds):
        weights[0] = 0
        score = weights[ids].sum(axis=2)
        score[:, 0, I] = _NEVER
        ahead, behind = np.zeros((S, L, 3)), np.zeros((S, L, 3))
        ahead[:, 0] = score[:, 0]
        for t in range(1, L):
            ahead[:, t] = np.where(mask[:, t, None], fuse(ahead[:, t - 1, :, None] + moves) + score[:, t], ahead[:, t - 1])
        for t in range(L - 2, -1, -1):
            after = score[:, t + 1] + behind[:, t + 1]
            behind[:, t] = np.where(mask[:, t + 1, None], fuse((moves[None] + after[:, None, :]).transpose(0, 2, 1)), behind[:, t + 1])
        total = fuse(ahead[np.arange(S), lengths - 1])
        chance = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * mask[..., None]
        step = (hot - chance).reshape(-1, 3)
        each = np.repeat(step, K, axis=0)
        grad = np.stack([np.bincount(flat, each[:, j] * valid, BUCKETS) for j in range(3)], 1) / S - ridge * weights
        pair = ahead[:, :-1, :, None] + moves + (score + behind)[:, 1:, None, :] - total[:, None, None, None]
        both = mask[:, 1:, None, None]
        grad_m = ((hot[:, :-1, :, None] * hot[:, 1:, None, :]) * both - np.exp(np.minimum(pair, 0)) * both).sum(axis=(0, 1)) / S - ridge * moves
        grad_m[O, I] = 0
        seen_w += grad**2
        seen_m += grad_m**2
        weights += 0.5 * grad / np.sqrt(seen_w)
        moves += 0.5 * grad_m / np.sqrt(seen_m)
    weights[0] = 0
    return Field(weights, moves, lexicon)


def fit_secrets(docs: DataFrame, fit_rows: int = 3_000, made: int = 600, matches: int = 3, id_column: str = "doc_id", text_column: str = "text") -> Field:
    """A field fitted on at most ``fit_rows`` documents, ``matches`` pattern matches of each, and ``made`` phrases."""
    rows = bounded_sample(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "id", fit_rows)
    kind = pa.list_(pa.struct([("words", pa.list_(pa.binary())), ("tags", pa.list_(pa.int32())), ("name", pa.string())]))

    def cut(r: pa.StructArray) -> dict:
        return {"s": pa.array([[{"words": w, "tags": t, "name": n} for w, t, n in snippets(x or "", matches)] for x in field(r, "text").to_pylist()], kind)}

    got = map_rows(rows, cut, "s array<struct<words:array<binary>,tags:array<int>,name:string>>").select("row.id", "s").collect()
    real = sorted((r["id"], [bytes(w) for w in s["words"]], list(s["tags"]), s["name"]) for r in got for s in r["s"])
    return fit_field([r[1:] for r in real] + made_phrases(made))


# ---- the operator ---------------------------------------------------------------------------------------


def adds(span: Span, base: list[Span]) -> bool:
    """Whether a span has a place outside all of ``base``, which is ordered by start."""
    at = span[1]
    for _, a, b in base:
        if a > at:
            break
        at = max(at, b)
    return at < span[2]


def find_secrets(docs: DataFrame, model: Field, text_column: str = "text", columns: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``row`` with spans (kind, start, end in code points): all pattern matches, and the field's that reach
    beyond them;
    if asked for, also the text with all spans redacted (null stays null)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    tables: dict = {}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(rows: pa.StructArray) -> dict:
        if "table" not in tables:
            tables["table"] = _Words(shipped.value)
        out = []
        texts = field(rows, text_column).to_pylist()
        for text in texts:
            text = text or ""
            data = text.encode()
            base = base_spans(text, data)
            more = [s for s in crf_spans(shipped.value, tables["table"], text, data) if adds(s, base)]
            spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        found = {"spans": pa.array(out, kind)}
        if redact:
            found["redacted"] = pa.array([redacted(t, [(s["start"], s["end"]) for s in o]) for t, o in zip(texts, out)], pa.string())
        return found

    return map_rows(docs, scan, "spans array<struct<kind:string,start:bigint,end:bigint>>" + (", redacted string" if redact else ""), columns)


def spelled(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str | None, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with united spans replaced."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
