"""All registered queries and their SQL counterparts.

A query module has ``QUERIES``: name to ``(function of spark and folder, SQL or None)``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with queries, in the order of the operator inventory.
MODULES: list[str] = ["relational", "series", "products", "texts", "graphs", "more", "operations", "formats", "structures", "records", "spreading"]


def _registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"lattica.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _registered().items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}
