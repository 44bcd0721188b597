"""Validation rules as violation tables: each rule is a name, a predicate and a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph_algorithms import topological_levels, weak_components

Rule = tuple[str, Column]


def min_length(c: str, n: int) -> Rule:
    return f"{c}.minLength", F.length(c) >= n


def max_length(c: str, n: int) -> Rule:
    return f"{c}.maxLength", F.length(c) <= n


def pattern(c: str, regex: str) -> Rule:
    return f"{c}.pattern", F.col(c).rlike(regex)


def slug(c: str) -> Rule:
    return f"{c}.slug", F.col(c).rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


def alphanumeric(c: str) -> Rule:
    return f"{c}.alphanumeric", F.col(c).rlike(r"^[A-Za-z0-9]+$")


def no_html(c: str) -> Rule:
    return f"{c}.noHtml", ~F.col(c).rlike(r"<[^>]+>")


def trimmed(c: str) -> Rule:
    return f"{c}.trimmed", F.col(c) == F.trim(c)


def at_least(c: str, n: float) -> Rule:
    return f"{c}.min", F.col(c) >= n


def at_most(c: str, n: float) -> Rule:
    return f"{c}.max", F.col(c) <= n


def integer(c: str) -> Rule:
    return f"{c}.integer", F.col(c) == F.floor(c)


def multiple_of(c: str, n: float) -> Rule:
    return f"{c}.multipleOf", F.abs(F.col(c) / n - F.round(F.col(c) / n)) < 1e-9


def precision(c: str, digits: int) -> Rule:
    return f"{c}.precision", F.abs(F.col(c) - F.round(c, digits)) < 1e-9


def finite(c: str) -> Rule:
    return f"{c}.finite", ~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf"))


def one_of(c: str, values: list) -> Rule:
    return f"{c}.oneOf", F.col(c).isin(values)


def before(c: str, when) -> Rule:
    return f"{c}.before", F.col(c) < when


def after(c: str, when) -> Rule:
    return f"{c}.after", F.col(c) > when


def weekday(c: str) -> Rule:
    return f"{c}.isWeekday", ~F.dayofweek(c).isin(1, 7)


def min_items(c: str, n: int) -> Rule:
    return f"{c}.minItems", F.size(c) >= n


def unique_items(c: str) -> Rule:
    return f"{c}.unique", F.size(c) == F.size(F.array_distinct(c))


def every(c: str, predicate) -> Rule:
    return f"{c}.every", F.forall(c, predicate)


def when(condition: Column, rule: Rule) -> Rule:
    """The rule where the condition holds; elsewhere it passes."""
    return rule[0], ~F.coalesce(condition, F.lit(False)) | rule[1]


def required(c: str) -> Rule:
    return f"{c}.required", F.col(c).isNotNull()


def check(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rule) of every violation; a null value violates all but optional rules."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return df.select(F.col(key), F.explode(F.array_compact(failed)).alias("rule"))


def valid(df: DataFrame, rules: list[Rule]) -> DataFrame:
    out = df
    for _, ok in rules:
        out = out.where(F.coalesce(ok, F.lit(False)))
    return out


# ---- graph rules, each giving (rule, id) of what violates it


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("source = target").select(F.lit("noSelfLoops").alias("rule"), F.col("id").cast("string").alias("id"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """All but the first of the edges of equal source, target and type."""
    w = Window.partitionBy("source", "target", "type").orderBy("id")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n > 1").select(F.lit("noDuplicateEdges").alias("rule"), F.col("id").cast("string").alias("id"))


def crowded_nodes(edges: DataFrame, most: int) -> DataFrame:
    """Nodes with more than ``most`` edge ends; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ends.where(F.col("n") > most).select(F.lit("maxEdgesPerNode").alias("rule"), F.col("id").cast("string").alias("id"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    bad = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").select("id").union(edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("id"))
    return bad.distinct().select(F.lit("validEdgeEndpoints").alias("rule"), F.col("id").cast("string").alias("id"))


def bad_type_pairs(edges: DataFrame, nodes: DataFrame, allowed: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Edges of a constrained type whose end types are not an allowed pair; a missing end type fails."""
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("type").alias(f"t_{c}"))
    typed = edges.where(F.col("type").isin(list(allowed))).join(of("source"), "source", "left").join(of("target"), "target", "left")
    fits = F.lit(False)
    for kind, pairs in allowed.items():
        for a, b in pairs:
            fits = fits | ((F.col("type") == kind) & (F.col("t_source") == a) & (F.col("t_target") == b))
    return typed.where(~F.coalesce(fits, F.lit(False))).select(F.lit("validEdgeTypeCombinations").alias("rule"), F.col("id").cast("string").alias("id"))


def repeated_ids(df: DataFrame, rule: str) -> DataFrame:
    return df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"))


def is_acyclic(edges: DataFrame) -> bool:
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().count()
    return topological_levels(edges).count() == ends


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    """An empty graph is connected."""
    return weak_components(edges, nodes).select("component").distinct().count() <= 1
