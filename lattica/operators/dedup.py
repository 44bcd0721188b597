"""Deduplication of records and the import pipeline around it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph_algorithms import weak_components
from lattica.operators.sets import first_by
from lattica.session import stored


def title_key(c: Column | str, unicode: bool = False) -> Column:
    """Lower case, only word characters and single spaces; ``unicode`` keeps all letters."""
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]" if unicode else r"[^A-Za-z0-9_\s]", ""), r"\s+", " "))


def by_title(df: DataFrame, title: str, order: list[str], content: str, unicode: bool = False) -> DataFrame:
    """The first record of each title key, with the longest content of its group and the group's size."""
    keyed = df.withColumn("_key", title_key(title, unicode))
    firsts = first_by(keyed, ["_key"], order)
    merged = keyed.groupBy("_key").agg(F.max_by(content, F.struct(F.length(content), *[-F.col(o) for o in order])).alias("_content"), F.count("*").alias("copies"))
    return firsts.join(merged, "_key").withColumn(content, F.col("_content")).drop("_key", "_content")


def by_content(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first record of each content hash."""
    key = F.sha2(F.concat_ws("\u0001", *[title_key(c, True) for c in columns]), 256)
    return first_by(df.withColumn("_key", key), ["_key"], order).drop("_key")


def _title_classes(df: DataFrame, id_column: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(id, class) of rows with a title key, the class being the smallest id of the key, and the keys (id, k) of classes."""
    rows = df.select(F.col(id_column).alias("id"), title_key(title, True).alias("k")).where("k <> '' and id is not null")
    classes = stored(rows.groupBy("k").agg(F.min("id").alias("class")))
    return rows.join(classes, "k").select("id", "class"), classes.select(F.col("class").alias("id"), "k")


def similar_title_classes(df: DataFrame, id_column: str, title: str, threshold: float = 0.85) -> DataFrame:
    """(a, b, kind) without the square of copies: every id a in its class b ("member"; the smallest id with the same
    title key), and the pairs of classes with similar keys, a first ("similar"). Two rows are similar if they are of
    one class or of two similar ones."""
    members, keys = _title_classes(df, id_column, title)
    links = _similar_keys(keys, threshold)
    return members.select(F.col("id").alias("a"), F.col("class").alias("b"), F.lit("member").alias("kind")).unionByName(links.withColumn("kind", F.lit("similar")))


def similar_titles(df: DataFrame, id_column: str, title: str, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b) of similar titles, a first; all pairs of copies too, as many as the square of their number."""
    members, keys = _title_classes(df, id_column, title)
    links = _similar_keys(keys, threshold)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(keys.select(F.col("id").alias("a"), F.col("id").alias("b")))
    x = members.select(F.col("id").alias("x"), F.col("class").alias("a"))
    y = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    return x.join(both, "a").join(y, "b").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _similar_keys(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows (id, k) with similar keys, a first.

    An edit changes two letter pairs at most, so similar keys share one among the rarest few of each, more of them
    the longer the key; keys meet on these. At thresholds of 2/3 and less that is no bound, and keys meet in bands
    of their length.
    """
    if threshold > 2 / 3:
        return _by_letter_pairs(rows, threshold)
    rows = rows.withColumn("n", F.length("k"))
    width = F.log("n") / F.log(F.lit(1 / threshold))
    a = rows.withColumn("band", F.floor(width).cast("long"))
    b = rows.withColumn("band", F.explode(F.array(*[F.floor(width).cast("long") + i for i in (-1, 0, 1)])))
    x, y = a.alias("x"), b.alias("y")
    close = F.levenshtein(F.col("x.k"), F.col("y.k"))
    fits = (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
    return x.join(y, fits).where(1 - close / F.greatest("x.n", "y.n") >= threshold).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _by_letter_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    padded = F.concat(F.lit("\u0001"), "k", F.lit("\u0001"))
    pairs = rows.select("id", F.length("k").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("k") + 1), lambda i: F.substr(padded, i, F.lit(2)))).alias("at", "pair"))
    # The second "an" of a key is another pair than the first.
    told = pairs.withColumn("pair", F.concat("pair", F.row_number().over(Window.partitionBy("id", "pair").orderBy("at")).cast("string")))
    ranked = told.join(told.groupBy("pair").agg(F.count("*").alias("f")), "pair")
    edits = F.floor((1 - threshold) * F.floor(F.col("n") / threshold + 1e-9) + 1e-9)
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "pair"))
    keys = ranked.select("id", "pair", (place <= 2 * edits + 1).alias("rare")).where("rare").select("id", "pair")
    met = keys.alias("x").join(keys.alias("y"), (F.col("x.pair") == F.col("y.pair")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    named = met.join(rows.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(rows.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    return named.where(1 - F.levenshtein("ka", "kb") / F.greatest(F.length("ka"), F.length("kb")) >= threshold).select("a", "b")


def combined(df: DataFrame, title: str, columns: list[str], order: list[str]) -> DataFrame:
    """The first record of each title key, then of each content hash among these."""
    return by_content(first_by(df.withColumn("_key", title_key(title)), ["_key"], order).drop("_key"), columns, order)


def fuzzy(df: DataFrame, id_column: str, title: str, threshold: float = 0.85) -> DataFrame:
    """(id, kept): greedy in order of id, a record joins the first kept one that is similar enough.

    Records with the title key of an earlier one join where it stays or has gone, so only the first of each key is
    decided on.
    """
    members, keys = _title_classes(df, id_column, title)
    pairs = stored(_similar_keys(keys, threshold))
    links = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"))
    groups = weak_components(links)
    near = pairs.groupBy(F.col("b").alias("id")).agg(F.sort_array(F.collect_list("a")).alias("before"))
    rows = groups.join(near, "id", "left")

    def walk(pdf):
        kept: set = set()
        out = []
        for i, before in sorted(zip(pdf["id"], pdf["before"])):
            home = next((b for b in (before if before is not None else []) if b in kept), i)
            if home == i:
                kept.add(i)
            out.append((i, home))
        return pd.DataFrame(out, columns=["id", "kept"])

    decided = rows.groupBy("component").applyInPandas(walk, "id long, kept long")
    homes = members.join(decided.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("kept", "class").alias("kept"))
    alone = df.select(F.col(id_column).alias("id"), title_key(title, True).alias("k")).where("k is null or k = '' or id is null")
    return homes.unionByName(alone.select("id", F.col("id").alias("kept")))


def import_rows(df: DataFrame, title: str, content: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Validate, sanitise, deduplicate: (accepted, quarantined with a reason)."""
    reason = F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no title").when(F.length(title) > 500, "long title")
    checked = df.withColumn("reason", reason)
    clean = checked.where("reason is null").drop("reason").withColumn(title, F.trim(F.regexp_replace(title, r"\s+", " "))).withColumn(content, F.regexp_replace(content, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return by_title(clean, title, order, content), checked.where("reason is not null")


def keep_by_date(df: DataFrame, keys: list[str], created: str, newest: bool = True, ties: list[str] = ()) -> DataFrame:
    """The newest or oldest record of each key, equal dates by ``ties`` and then by all columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc(created) if newest else F.asc(created), *(ties or ()), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
