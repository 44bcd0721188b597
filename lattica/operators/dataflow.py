"""A lazily built dataflow: stages append to a DataFrame plan; rows that a stage maps to null vanish."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import sets
from lattica.session import cut


@dataclass(frozen=True)
class Flow:
    """``order`` names the columns that stand for arrival order; stages that depend on it use no other."""

    df: DataFrame
    order: tuple[str, ...] = ()
    rejected: DataFrame | None = None

    def _then(self, df: DataFrame) -> Flow:
        return replace(self, df=df)

    def map(self, **columns: Column) -> Flow:
        """Replace the payload with named columns; a row whose columns are all null is dropped."""
        kept = [F.col(o) for o in self.order if o not in columns]
        out = self.df.select(*kept, *[c.alias(n) for n, c in columns.items()])
        some = F.lit(False)
        for n in columns:
            some = some | F.col(n).isNotNull()
        return self._then(out.where(some))

    def filter(self, condition: Column) -> Flow:
        return self._then(self.df.where(condition))

    def flat_map(self, array: Column, name: str) -> Flow:
        return self._then(self.df.withColumn(name, F.explode(array)))

    def running(self, name: str, value: str, kind: str = "sum") -> Flow:
        """A running sum, count, min or max in arrival order, nulls left out: totals of sorted ranges are carried to
        the ranges behind them, so no task sees all rows. Ties in ``order`` may fall either way."""
        made = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind]
        placed = cut(self.df.repartitionByRange(*self.order).withColumn("_p", F.spark_partition_id()))
        totals = placed.groupBy("_p").agg(made(value).alias("_t"))
        carry = F.sum if kind == "count" else made
        before = totals.select("_p", carry("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_b"))
        inside = made(value).over(Window.partitionBy("_p").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0))
        own, base = F.col("_own"), F.col("_b")
        both = F.coalesce(own + base, own, base) if kind in ("sum", "count") else (F.least if kind == "min" else F.greatest)(own, base)
        return self._then(placed.withColumn("_own", inside).join(before, "_p").withColumn(name, both).drop("_p", "_own", "_b"))

    def scan(self, name: str, aggregate: Column) -> Flow:
        """Any running aggregate in arrival order, in one task; ``running`` scales."""
        w = Window.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        return self._then(self.df.withColumn(name, aggregate.over(w)))

    def reduce(self, **aggregates: Column) -> Flow:
        return Flow(self.df.agg(*[c.alias(n) for n, c in aggregates.items()]))

    def tap(self, name: str, *aggregates: Column) -> Flow:
        """Observe aggregates while rows pass."""
        return self._then(self.df.observe(name, *aggregates))

    def batch(self, n: int, value: str) -> DataFrame:
        return sets.chunks(self.df, list(self.order), n, value)

    def take(self, n: int) -> Flow:
        return self._then(self.df.orderBy(*self.order).limit(n))

    def skip(self, n: int) -> Flow:
        return self._then(self.df.orderBy(*self.order).offset(n))

    def distinct(self) -> Flow:
        return self._then(self.df.distinct())

    def distinct_by(self, *keys: str) -> Flow:
        return self._then(sets.first_by(self.df, list(keys), list(self.order)))

    def on_error(self, name: str, attempt: Column, policy: str = "skip") -> Flow:
        """``attempt`` is null where it fails (a try_ function): skip drops such rows, dead-letter keeps them
        apart in ``rejected``, throw fails the query."""
        made = self.df.withColumn(name, attempt)
        bad = F.col(name).isNull()
        if policy == "throw":
            return self._then(made.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} failed"))).otherwise(F.col(name))))
        return replace(self, df=made.where(~bad), rejected=made.where(bad) if policy == "dead-letter" else None)

    def compose(self, other: Callable[[DataFrame], DataFrame]) -> Flow:
        return self._then(self.df.transform(other))

    def first(self) -> Any:
        return self.df.orderBy(*self.order).first()

    def last(self) -> Any:
        return self.df.orderBy(*[F.desc(o) for o in self.order]).first()

    def count(self) -> int:
        return self.df.count()

    def group(self, key: str, value: str) -> DataFrame:
        """Rows of each key in arrival order."""
        rows = self.df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*self.order, F.col(value).alias("_v")))).alias("_r"))
        return rows.select(key, F.transform("_r", lambda r: r["_v"]).alias("items"))
