"""Scalar functions: strings, predicates, dates, arrays, maps, calendar, geometry, number theory, vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- strings


def slugify(text: Column | str) -> Column:
    """Lower case, marks off common Latin letters, runs of anything else one hyphen."""
    plain = F.translate(F.lower(_c(text)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def truncate(text: Column | str, n: int, tail: str = "...") -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - len(tail)), F.lit(tail))).otherwise(t)


def capitalize(text: Column | str) -> Column:
    t = _c(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def camel_to_kebab(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"([a-z0-9])([A-Z])", "$1-$2"))


def kebab_to_camel(text: Column | str) -> Column:
    parts = F.split(_c(text), "-")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), capitalize), ""))


def escape_html(text: Column | str) -> Column:
    out = _c(text)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def mask_email(email: Column | str) -> Column:
    """The first character of the name, stars, and the domain."""
    e = _c(email)
    return F.regexp_replace(e, r"^(.)[^@]*(@.*)$", "$1***$2")


def format_bytes(n: Column | str) -> Column:
    v = _c(n).cast("double")
    out = F.concat(F.format_number(v, 0), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(v >= 1024**i, F.concat(F.round(v / 1024**i, 2).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


# ---- predicates


def is_email(c: Column | str) -> Column:
    return _c(c).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_url(c: Column | str) -> Column:
    return _c(c).rlike(r"^https?://[^\s/]+")


def is_uuid(c: Column | str) -> Column:
    return _c(c).rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_hex_color(c: Column | str) -> Column:
    return _c(c).rlike(r"(?i)^#(?:[0-9a-f]{3}|[0-9a-f]{6})$")


def is_numeric(c: Column | str) -> Column:
    return _c(c).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")


def is_json(c: Column | str) -> Column:
    return F.try_parse_json(_c(c)).isNotNull()


def safe_filename(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def normalize_url(c: Column | str) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash."""
    u = F.regexp_replace(_c(c), r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z]+://[^/?]*)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z]+://[^/?]*(.*)$", 1)
    return F.concat(head, F.regexp_replace(rest, r"/+$", ""))


# ---- dates (UTC) and calendar


def _ms(c: Column | str) -> Column:
    return F.unix_millis(_c(c).cast("timestamp"))


def diff_days(a: Column | str, b: Column | str) -> Column:
    """Whole days from a to b, rounded down."""
    return F.floor((_ms(b) - _ms(a)) / 86_400_000)


def diff_hours(a: Column | str, b: Column | str) -> Column:
    return F.floor((_ms(b) - _ms(a)) / 3_600_000)


def format_date(c: Column | str, pattern: str = "YYYY-MM-DD HH:mm:ss") -> Column:
    return F.date_format(_c(c), pattern.replace("YYYY", "yyyy").replace("DD", "dd"))


def relative_time(c: Column | str, now: Column) -> Column:
    s = F.floor((_ms(now) - _ms(c)) / 1000)
    out = F.lit("just now")
    for unit, name in ((60, "minute"), (3600, "hour"), (86400, "day"), (604800, "week"), (2592000, "month"), (31536000, "year")):
        n = F.floor(s / unit)
        out = F.when(s >= unit, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return out


def is_weekend(c: Column | str) -> Column:
    return F.dayofweek(_c(c)).isin(1, 7)


def is_business_day(c: Column | str, holidays: list[str] | None = None) -> Column:
    day = F.to_date(_c(c))
    free = day.isin(*[F.to_date(F.lit(h)) for h in holidays]) if holidays else F.lit(False)
    return ~is_weekend(c) & ~free


def business_days_between(a: Column | str, b: Column | str, holidays: list[str] | None = None) -> Column:
    """Business days in (a, b]; negative when b is before a. Arithmetic over whole weeks, no list of days."""
    x, y = F.to_date(_c(a)), F.to_date(_c(b))
    lo, hi = F.least(x, y), F.greatest(x, y)
    since = lambda d: F.datediff(d, F.lit("1970-01-04").cast("date"))  # noqa: E731  days since a Sunday
    upto = lambda d: F.floor(since(d) / 7) * 5 + F.least(F.pmod(since(d), F.lit(7)), F.lit(5))  # noqa: E731  weekdays up to and with d
    n = upto(hi) - upto(lo)
    for h in holidays or []:
        day = F.lit(h).cast("date")
        n = n - F.when((day > lo) & (day <= hi) & ~is_weekend(day), 1).otherwise(0)
    return F.when(x <= y, n).otherwise(-n)


def add_business_days(c: Column | str, n: int) -> Column:
    """The n-th business day behind a date (a weekend counts as the Friday before)."""
    d = F.to_date(_c(c))
    since = F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday
    index = F.floor(since / 7) * 5 + F.least(F.pmod(since, F.lit(7)), F.lit(4)) + n
    return F.date_add(F.lit("1970-01-05").cast("date"), (F.floor(index / 5) * 7 + F.pmod(index, F.lit(5))).cast("int"))


# ---- arrays and maps


def chunk_array(a: Column | str, n: int) -> Column:
    x = _c(a)
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(n)), lambda i: F.slice(x, i, n))).otherwise(F.array())


def map_diff(a: Column | str, b: Column | str) -> Column:
    """Sorted added, removed and changed keys of two maps."""
    x, y = _c(a), _c(b)
    added, removed = F.array_except(F.map_keys(y), F.map_keys(x)), F.array_except(F.map_keys(x), F.map_keys(y))
    changed = F.filter(F.array_intersect(F.map_keys(x), F.map_keys(y)), lambda k: ~x[k].eqNullSafe(y[k]))
    return F.struct(F.sort_array(added).alias("added"), F.sort_array(removed).alias("removed"), F.sort_array(changed).alias("changed"))


def deep_merge(base: Column | str, source: Column | str) -> Column:
    """The source wins where it has a value."""
    return F.map_zip_with(_c(base), _c(source), lambda _, v, w: F.coalesce(w, v))


# ---- numbers


def js_round(c: Column | str, digits: int = 0) -> Column:
    """Half up toward positive infinity."""
    return F.floor(_c(c) * 10**digits + 0.5) / 10**digits


def gcd(a: Column, b: Column) -> Column:
    """Euclid as a fold, of as many steps as the smaller number can take (Lamé: its logarithm to the golden ratio)."""
    smaller = F.least(F.abs(a.cast("double")), F.abs(b.cast("double")))
    steps = F.floor(F.log(F.coalesce(smaller, F.lit(0.0)) + 1) / F.log(F.lit((1 + 5**0.5) / 2))).cast("int") + 3
    state = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    done = F.aggregate(F.sequence(F.lit(1), steps), state, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], s["y"]).alias("y"))))
    return done["x"]


def divisors(n: Column) -> Column:
    """All divisors of a positive number, ascending: those up to its root, and what each leaves."""
    whole = F.greatest(n.cast("long"), F.lit(1).cast("long"))
    low = F.filter(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(whole.cast("double")))), lambda i: (n >= 1) & (whole % i == 0))
    return F.array_distinct(F.concat(low, F.reverse(F.transform(low, lambda i: F.call_function("div", whole, i)))))


def divisor_counts(n: pd.Series) -> pd.Series:
    """How many divisors positive numbers have, none for others: trial division of all numbers of a batch at once,
    each up to the root of what is left of it."""
    whole = n.fillna(0).to_numpy(dtype="int64")
    found, left, at = (whole > 0).astype("int64"), np.maximum(whole, 1), np.arange(len(whole))
    p = 2
    while len(at := at[left[at] // p >= p]):
        hit = at[left[at] % p == 0]
        power = np.ones(len(whole), "int64")
        while len(hit):
            left[hit] //= p
            power[hit] += 1
            hit = hit[left[hit] % p == 0]
        found *= power
        p += 1 if p == 2 else 2
    return pd.Series(np.where(left > 1, 2, 1) * found)


def is_prime(n: Column) -> Column:
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    odd = F.when(root >= 3, F.sequence(F.lit(3).cast("long"), root, F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return (n > 1) & ((n == 2) | (n.cast("long") % 2 != 0)) & ~F.exists(odd, lambda i: n.cast("long") % i == 0)


def digital_root(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(1 + (n - 1) % 9)


def binomial(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return F.round(out).cast("long")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    n = F.size(points)
    terms = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(points, i)["x"] * F.element_at(points, i % n + 1)["y"] - F.element_at(points, i % n + 1)["x"] * F.element_at(points, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


# ---- the small expression language of workflow conditions

_FUNCTIONS = {
    "length": lambda a: F.length(a), "upper": F.upper, "lower": F.lower, "trim": F.trim, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "round": lambda a: js_round(a),
    "string": lambda a: a.cast("string"), "number": lambda a: a.try_cast("double"), "not": lambda a: ~a, "if": lambda c, a, b: F.when(c, a).otherwise(b), "coalesce": F.coalesce,
    "min": F.least, "max": F.greatest, "contains": F.contains, "matches": lambda a, b: F.rlike(a, b), "split": lambda a, b: F.split(a, b), "join": lambda a, b: F.array_join(a, b) if isinstance(b, str) else F.array_join(a, ","), "first": lambda a: F.element_at(a, 1), "last": lambda a: F.element_at(a, -1), "count": F.size,
}


def expression(source: str, scope: dict[str, Column]) -> Column:
    """Translate ``$.a.b``, literals, arithmetic, comparisons, && || ! and function calls into a Column.

    ``==`` compares as strings, so that 1 equals "1"; division by zero gives null.
    """
    tokens = re.findall(r"\s*(\$(?:\.[A-Za-z_]\w*|\[\d+\])*|[A-Za-z_]\w*|\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\"|==|!=|>=|<=|&&|\|\||[-+*/()<>!,])", source)
    if "".join(tokens) != re.sub(r"\s+(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", "", source):
        raise ValueError(f"cannot read {source!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def primary() -> Column:
        t = take()
        if t == "(":
            out = level(0)
            take()
            return out
        if t == "!":
            return ~primary()
        if t == "-":
            return -primary()
        if t[0] in "'\"":
            return F.lit(t[1:-1])
        if t[0].isdigit():
            return F.lit(float(t))
        if t[0] == "$":
            path = re.findall(r"\.(\w+)|\[(\d+)\]", t)
            out = scope[path[0][0]]
            for name, index in path[1:]:
                out = out[name] if name else out[int(index)]
            return out
        if t in ("true", "false"):
            return F.lit(t == "true")
        if peek() == "(":
            take()
            args = []
            while peek() != ")":
                args.append(level(0))
                if peek() == ",":
                    take()
            take()
            return _FUNCTIONS[t](*args)
        return scope[t]

    loose = lambda a, b: F.coalesce(a.try_cast("double") == b.try_cast("double"), a.cast("string") == b.cast("string"), F.lit(False))
    operators: list[dict] = [
        {"||": lambda a, b: a | b}, {"&&": lambda a, b: a & b}, {"==": loose, "!=": lambda a, b: ~loose(a, b)},
        {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b},
        {"+": lambda a, b: a + b, "-": lambda a, b: a - b}, {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)},
    ]

    def level(n: int) -> Column:
        if n == len(operators):
            return primary()
        left = level(n + 1)
        while peek() in operators[n]:
            op = take()
            left = operators[n][op](left, level(n + 1))
        return left

    return level(0)


def interpolate(template: str, scope: dict[str, Column]) -> Column:
    """``{{expression}}`` parts as strings; nulls are empty."""
    parts = re.split(r"\{\{(.*?)\}\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(expression(p.strip(), scope).cast("string"), F.lit("")) for i, p in enumerate(parts)])
