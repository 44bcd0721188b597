"""Template filters as Column functions, and chains of them in ``{{ name | filter(argument) }}`` substitutions.

A null counts as the empty text, unless ``default`` comes first. Arguments are literals.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAGS = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _words(c: Column) -> Column:
    return F.filter(F.split(_text(c), r"\s+"), lambda w: w != "")


def title(c: Column) -> Column:
    """First letters of words in upper case; other letters stay."""
    parts = F.regexp_extract_all(_text(c), F.lit(r"(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def slug(c: Column) -> Column:
    """Word characters stay, runs of spaces, underscores and dashes are one dash."""
    plain = F.regexp_replace(F.trim(F.lower(_text(c))), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s_-]+", "-"), "^-+|-+$", "")


def shorten(c: Column, length: int = 255, tail: str = "...") -> Column:
    c = _text(c)
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, length - len(tail)), F.lit(tail)))


def rounded(c: Column, places: int = 0) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c.cast("double") * 10**places + 0.5) / 10**places


def escape(c: Column) -> Column:
    c = _text(c)
    for plain, entity in _TAGS:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    c = _text(c)
    for plain, entity in reversed(_TAGS):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


FILTERS: dict[str, Callable[..., Column]] = {
    "upper": lambda c: F.upper(_text(c)),
    "lower": lambda c: F.lower(_text(c)),
    "capitalize": lambda c: F.concat(F.upper(F.substring(_text(c), 1, 1)), F.lower(F.substring(_text(c), 2, 1 << 30))),
    "title": title,
    "trim": lambda c: F.regexp_replace(_text(c), r"^\s+|\s+$", ""),
    "truncate": shorten,
    "slugify": slug,
    "reverse": lambda c: F.reverse(_text(c)),
    "replace": lambda c, old, new="": F.replace(_text(c), F.lit(old), F.lit(new)),
    "wordcount": lambda c: F.size(_words(c)),
    "round": rounded,
    "floor": lambda c: F.floor(c.cast("double")),
    "ceil": lambda c: F.ceil(c.cast("double")),
    "abs": F.abs,
    "format": lambda c, places=2: F.format_number(c.cast("double"), places),
    "iso": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    "sort": lambda c: F.array_sort(c.cast("array<string>")),
    "unique": F.array_distinct,
    "first": lambda c: F.try_element_at(c, F.lit(1)),
    "last": lambda c: F.try_element_at(c, F.lit(-1)),
    "slice": lambda c, start, end: F.slice(c, start + 1, end - start),
    "join": lambda c, between=", ": F.array_join(c.cast("array<string>"), between, ""),
    "size": F.size,
    "length": lambda c: F.length(_text(c)),
    "keys": F.map_keys,
    "values": F.map_values,
    "json": F.to_json,
    "escape": escape,
    "unescape": unescape,
    "striptags": lambda c: F.regexp_replace(_text(c), "<[^>]*>", ""),
    "nl2br": lambda c: F.regexp_replace(_text(c), "\n", "<br>\n"),
    "default": lambda c, other="": F.coalesce(F.when(c.cast("string") != "", c.cast("string")), F.lit(str(other))),
}


def _calls(chain: str) -> list[tuple[str, list]]:
    """The filters of ``a | f | g(1, 'x')`` behind its first part; a bar inside quotes is text."""
    found = []
    for part in re.findall(r"\|\s*((?:[^|'\"]|'[^']*'|\"[^\"]*\")+)", chain):
        name, _, rest = part.strip().partition("(")
        if name.strip() not in FILTERS:
            raise ValueError(f"no filter is called {name.strip()!r}")
        found.append((name.strip(), list(ast.literal_eval(f"[{rest.rstrip().removesuffix(')')}]"))))
    return found


def render(template: str, scope: dict[str, Column]) -> Column:
    """The template with its substitutions made; unknown names and filters are errors, nulls give no text."""
    out, end = [], 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*((?:\|(?:[^}'\"]|'[^']*'|\"[^\"]*\")*)?)\}\}", template):
        value = scope[m[1]]
        for name, arguments in _calls(m[2]):
            value = FILTERS[name](value, *arguments)
        out += [F.lit(template[end : m.start()]), _text(value)]
        end = m.end()
    return F.concat(*out, F.lit(template[end:]))
