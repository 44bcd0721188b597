"""A fluent relational query builder that composes a DataFrame instead of SQL text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import predicates as P

Terms = tuple[tuple[str, Column], ...]


@dataclass(frozen=True)
class Query:
    """One SELECT. Every method returns a new query; ``build`` gives the DataFrame.

    Order of evaluation: source and joins, WHERE, GROUP BY with aggregates, HAVING, ORDER BY (nulls last when
    ascending, first when descending), OFFSET, LIMIT, projection, DISTINCT before ordering.
    """

    source: DataFrame
    columns: tuple = ()
    terms: Terms = ()
    keys: tuple[str, ...] = ()
    sums: tuple[Column, ...] = ()
    kept: tuple[Column, ...] = ()
    order: tuple[Column, ...] = ()
    size: int | None = None
    skip: int = 0
    unique: bool = False

    def select(self, *columns: str | Column | tuple[str, str]) -> Query:
        made = [F.col(c[0]).alias(c[1]) if isinstance(c, tuple) else F.col(c) if isinstance(c, str) else c for c in columns]
        return replace(self, columns=self.columns + tuple(made))

    def select_raw(self, sql: str, alias: str) -> Query:
        return self.select(F.expr(sql).alias(alias))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def _term(self, connector: str, condition: Column) -> Query:
        return replace(self, terms=(*self.terms, (connector, condition)))

    def where(self, column: str, op: str, value) -> Query:
        return self._term("and", P.compare(column, op, value))

    def or_where(self, column: str, op: str, value) -> Query:
        return self._term("or", P.compare(column, op, value))

    def where_in(self, column: str, values: list) -> Query:
        return self._term("and", P.in_list(column, values))

    def where_not_in(self, column: str, values: list) -> Query:
        return self._term("and", P.not_in_list(column, values))

    def where_between(self, column: str, low, high) -> Query:
        return self._term("and", P.between(column, low, high))

    def where_not_between(self, column: str, low, high) -> Query:
        return self._term("and", P.between(column, low, high, negate=True))

    def where_null(self, column: str) -> Query:
        return self._term("and", F.col(column).isNull())

    def where_not_null(self, column: str) -> Query:
        return self._term("and", F.col(column).isNotNull())

    def where_like(self, column: str, pattern: str) -> Query:
        return self._term("and", P.like(column, pattern))

    def where_raw(self, sql: str) -> Query:
        return self._term("and", F.expr(sql))

    def or_where_raw(self, sql: str) -> Query:
        return self._term("or", F.expr(sql))

    def where_group(self, *terms: tuple[str, Column]) -> Query:
        return self._term("and", P.flat(list(terms)))

    def or_where_group(self, *terms: tuple[str, Column]) -> Query:
        return self._term("or", P.flat(list(terms)))

    def where_subquery(self, column: str, op: str, other: DataFrame) -> Query:
        """IN and NOT IN become semi and (null-aware) anti joins; a comparison takes a one-row subquery."""
        name = other.columns[0]
        if op.lower() in ("in", "not in"):
            found = F.col(column).isin(other.select(name))
            return self._term("and", found if op.lower() == "in" else ~found)
        return self._term("and", P.compare(column, op, other.select(name).scalar()))

    def where_exists(self, other: DataFrame, on: Column, negate: bool = False) -> Query:
        return replace(self, source=self.source.join(other, on, "left_anti" if negate else "left_semi"))

    def join(self, other: DataFrame, on=None, how: str = "inner") -> Query:
        return replace(self, source=self.source.crossJoin(other) if how == "cross" else self.source.join(other, on, how))

    def group_by(self, *keys: str) -> Query:
        return replace(self, keys=self.keys + keys)

    def _sum(self, made: Column) -> Query:
        return replace(self, sums=(*self.sums, made))

    def count(self, column: str = "*", alias: str = "count") -> Query:
        return self._sum(F.count(column).alias(alias))

    def sum(self, column: str, alias: str | None = None) -> Query:
        return self._sum(F.sum(column).alias(alias or f"sum_{column}"))

    def avg(self, column: str, alias: str | None = None) -> Query:
        return self._sum(F.avg(column).alias(alias or f"avg_{column}"))

    def min(self, column: str, alias: str | None = None) -> Query:
        return self._sum(F.min(column).alias(alias or f"min_{column}"))

    def max(self, column: str, alias: str | None = None) -> Query:
        return self._sum(F.max(column).alias(alias or f"max_{column}"))

    def having(self, sql: str) -> Query:
        return replace(self, kept=(*self.kept, F.expr(sql)))

    def order_by(self, column: str, direction: str = "asc") -> Query:
        c = F.col(column)
        return replace(self, order=(*self.order, c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()))

    def limit(self, n: int) -> Query:
        return replace(self, size=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def page(self, number: int, size: int) -> Query:
        return self.limit(size).offset((number - 1) * size)

    def build(self) -> DataFrame:
        if self.kept and not (self.keys or self.sums):
            raise ValueError("having needs a group or an aggregate")
        if self.columns and self.sums and not set(self.columns) <= set(self.keys):
            raise ValueError("beside aggregates only grouped columns can be selected")
        df = self.source.where(P.flat(list(self.terms))) if self.terms else self.source
        if self.keys or self.sums:
            df = df.groupBy(*self.keys).agg(*(self.sums or (F.count("*").alias("count"),)))
            if not self.sums:
                df = df.drop("count")
            if self.kept:
                df = df.where(P.all_of(*self.kept))
            if self.columns and not self.sums:
                df = df.select(*self.columns)
        elif self.columns and self.unique:
            df = df.select(*self.columns)
        df = df.distinct() if self.unique else df
        df = df.orderBy(*self.order) if self.order else df
        df = df.offset(self.skip) if self.skip else df
        df = df.limit(self.size) if self.size is not None else df
        return df.select(*self.columns) if self.columns and not self.unique and not (self.keys or self.sums) else df


def after(df: DataFrame, cursor: tuple | None, keys: list[str], size: int) -> DataFrame:
    """Keyset page: rows behind ``cursor`` in descending order of ``keys``, one more than asked to tell if any follow."""
    if cursor is not None:
        terms = []
        for i, (k, v) in enumerate(zip(keys, cursor)):
            terms.append(P.all_of(*[F.col(a) == F.lit(b) for a, b in zip(keys[:i], cursor[:i])], F.col(k) < F.lit(v)))
        df = df.where(P.any_of(*terms))
    return df.orderBy(*[F.desc(k) for k in keys]).limit(size + 1)
