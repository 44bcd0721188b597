"""Predicates as Column expressions, in SQL's three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compare(column: Column | str, op: str, value) -> Column:
    return getattr(_col(column), COMPARISONS[op])(value)


def literal_pattern(value: str) -> str:
    """``value`` with LIKE's wildcards escaped."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like(column: Column | str, pattern: str, fold: bool = False, negate: bool = False) -> Column:
    out = _col(column).ilike(pattern) if fold else _col(column).like(pattern)
    return ~out if negate else out


def starts_with(column: Column | str, value: str, wildcards: bool = False) -> Column:
    return _col(column).like(f"{value if wildcards else literal_pattern(value)}%")


def ends_with(column: Column | str, value: str, wildcards: bool = False) -> Column:
    return _col(column).like(f"%{value if wildcards else literal_pattern(value)}")


def contains(column: Column | str, value: str, wildcards: bool = False) -> Column:
    return _col(column).like(f"%{value if wildcards else literal_pattern(value)}%")


def in_list(column: Column | str, values: list) -> Column:
    """An empty list holds nothing."""
    return _col(column).isin(list(values)) if values else F.lit(False)


def not_in_list(column: Column | str, values: list) -> Column:
    return ~_col(column).isin(list(values)) if values else F.lit(True)


def between(column: Column | str, low, high, negate: bool = False) -> Column:
    out = _col(column).between(low, high)
    return ~out if negate else out


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def none_of(*conditions: Column) -> Column:
    return ~any_of(*conditions)


def flat(terms: list[tuple[str, Column]]) -> Column:
    """A flat list of (connector, condition); AND binds tighter and the first connector does not count."""
    groups: list[Column] = []
    for connector, condition in terms:
        if groups and connector == "and":
            groups[-1] = groups[-1] & condition
        else:
            groups.append(condition)
    return any_of(*groups) if groups else F.lit(True)


def has_labels(labels: Column | str, wanted: dict[str, str]) -> Column:
    """Every wanted label is present and equal."""
    return all_of(*[_col(labels)[k] == v for k, v in wanted.items()])
