"""Schema migration: registered steps between versions, the shortest chain of them, applied to DataFrames."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Migrations:
    """Steps are transformations of a DataFrame, so a chain of them is one plan without passes in between."""

    def __init__(self) -> None:
        self._steps: dict[tuple[str, str], Step] = {}
        self._rules: dict[str, Column] = {}

    def step(self, old: str, new: str, change: Step) -> Migrations:
        self._steps[old, new] = change
        return self

    def rule(self, version: str, valid: Column) -> Migrations:
        """Rows of ``version`` are valid where ``valid`` is true; a version without a rule takes all rows."""
        self._rules[version] = valid
        return self

    def path(self, old: str, new: str) -> list[str] | None:
        """Fewest steps, earlier registered ones first; None where no chain leads there."""
        came: dict[str, str | None] = {old: None}
        queue = deque([old])
        while queue and new not in came:
            at = queue.popleft()
            for a, b in self._steps:
                if a == at and b not in came:
                    came[b] = at
                    queue.append(b)
        if new not in came:
            return None
        chain = [new]
        while came[chain[-1]] is not None:
            chain.append(came[chain[-1]])
        return chain[::-1]

    def migrate(self, df: DataFrame, old: str, new: str) -> DataFrame:
        chain = self.path(old, new)
        if chain is None:
            raise ValueError(f"no chain of migrations from {old} to {new}")
        return reduce(lambda made, pair: self._steps[pair](made), zip(chain, chain[1:]), df)

    def migrate_mixed(self, df: DataFrame, version: str, versions: list[str], new: str) -> DataFrame:
        """Rows of several versions, each brought to ``new`` by its own chain, which ``version`` then states."""
        parts = [self.migrate(df.where(F.col(version) == v).drop(version), v, new) for v in versions]
        return reduce(DataFrame.unionByName, parts).withColumn(version, F.lit(new))

    def valid(self, df: DataFrame, version: str) -> DataFrame:
        return df.where(F.coalesce(self._rules[version], F.lit(False))) if version in self._rules else df
