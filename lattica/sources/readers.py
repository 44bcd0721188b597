"""Sources: rows made in place, delimited and nested files, and parsers of text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def array_source(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows with an ``ord`` column that keeps their order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord long, {schema}")


def range_source(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """End-exclusive; negative steps count down."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, end, step)


def repeat_source(spark: SparkSession, value, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(value).alias("value"))


def empty_source(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def concat_source(*frames: DataFrame) -> DataFrame:
    """Union with a ``source_ordinal`` that keeps the order of the sources."""
    out = frames[0].withColumn("source_ordinal", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("source_ordinal", F.lit(i)))
    return out


def merge_source(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def interval_source(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ticks."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of , tab ; | outside quotes in the first line; the earlier one on ties."""
    first = spark.read.text(path).limit(1).collect()
    bare = "".join(part for i, part in enumerate((first[0][0] if first else "").split('"')) if i % 2 == 0)
    return max([",", "\t", ";", "|"], key=bare.count)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, trim: bool = False, max_rows: int | None = None) -> DataFrame:
    """All columns as strings, missing cells empty; quoted newlines are kept."""
    df = spark.read.csv(path, sep=delimiter or sniff_delimiter(spark, path), header=header, multiLine=True, quote='"', escape='"', inferSchema=False)
    df = df.select(*[F.coalesce(F.trim(F.col(f"`{c}`")) if trim else F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return df.limit(max_rows) if max_rows is not None else df


def column_types(df: DataFrame, sample: int = 20) -> DataFrame:
    """(column, kind) from header names, else from up to ``sample`` non-empty values of each column."""
    rules = {"id": r"(?i)^(?:_?id|uuid|key)$", "title": r"(?i)^(?:title|name|label)$", "content": r"(?i)^(?:content|body|text|description)$", "tags": r"(?i)^(?:tags|keywords)$", "date": r"(?i)(?:date|_at)$"}
    tests = [("id", r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", 0.8), ("boolean", r"(?i)^(?:true|false|yes|no|0|1)$", 0.8), ("number", r"^-?[0-9]+(?:\.[0-9]+)?$", 0.8), ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.7)]
    parts = None
    for c in df.columns:
        named = next((k for k, rx in rules.items() if re.search(rx, c)), None)
        v = F.col("v")
        rows = df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v <> ''").limit(sample)
        kind = F.lit("unknown")
        kind = F.when(F.avg(F.length(v)) > 20, "title").otherwise(kind)
        kind = F.when(F.avg(F.length(v)) > 100, "content").otherwise(kind)
        for name, rx, share in reversed(tests):
            kind = F.when(F.avg(v.rlike(rx).cast("int")) > share, name).otherwise(kind)
        part = rows.agg((F.lit(named) if named else kind).alias("kind")).select(F.lit(c).alias("column"), "kind")
        parts = part if parts is None else parts.union(part)
    return parts


def csv_graph(df: DataFrame, source: str, target: str, kind: str | None = None, weight: str | None = None, kinds: tuple[str, ...] = ("related_to",)) -> DataFrame:
    """Edges of a table with endpoints: weights clamped to [0, 1] (1 if unreadable), unknown types related_to."""
    read = F.col(weight).try_cast("double") if weight else F.lit(1.0)
    w = F.when(read.isNull() | F.isnan(read), 1.0).otherwise(F.least(F.greatest(read, F.lit(0.0)), F.lit(1.0)))
    t = F.when(F.col(kind).isin(*kinds), F.col(kind)).otherwise("related_to") if kind else F.lit("related_to")
    return df.where((F.col(source) != "") & (F.col(target) != "")).select(F.col(source).alias("source"), F.col(target).alias("target"), t.alias("type"), w.alias("weight"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as variants, exploded if they are arrays."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.try_parse_json("value").alias("doc"))


def json_nodes(docs: DataFrame, column: str) -> DataFrame:
    """(path, kind) of the top-level fields of a JSON column: containers are nodes, whose id is their path."""
    fields = docs.select(F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))
    return fields.select("path", F.when(F.col("value").rlike(r"^\s*\{"), "object").when(F.col("value").rlike(r"^\s*\["), "array").otherwise("value").alias("kind"))


# ---- HTML

_SCRIPT = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


def html_clean(html: str | Column) -> Column:
    return F.regexp_replace(F.col(html) if isinstance(html, str) else html, _SCRIPT, "")


def html_title(html: str | Column) -> Column:
    """title, else the first h1, else og:title, else Untitled."""
    h = html_clean(html)
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(tidy(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), tidy(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), tidy(F.regexp_extract(h, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)), F.lit("Untitled"))


def html_links(html: str | Column) -> Column:
    """hrefs other than fragments, scripts, mail and telephone."""
    found = F.regexp_extract_all(html_clean(html), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike(r"(?i)^(?:#|javascript:|mailto:|tel:)"))


def html_headings(html: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(html_clean(html), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))


def html_language(html: str | Column) -> Column:
    return F.regexp_extract(F.col(html) if isinstance(html, str) else html, r'(?is)<html[^>]*\slang="([^"]*)"', 1)


def html_main(html: str | Column, least: int = 100) -> Column:
    """Text of the first main or article with over ``least`` characters, else of the whole page."""
    h = html_clean(html)
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"\s+", " "))
    out = text(h)
    for tag in ("article", "main"):
        inner = text(F.regexp_extract(h, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
        out = F.when(F.length(inner) > least, inner).otherwise(out)
    return out


# ---- Markdown


def md_front_matter(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.str_to_map(F.regexp_extract(t, r"(?s)\A---\n(.*?)\n---\n", 1), F.lit("\n"), F.lit(": "))


def md_title(text: str | Column, file_name: str | Column | None = None) -> Column:
    """Front matter, first H1, first heading, file name, Untitled."""
    t = F.col(text) if isinstance(text, str) else text
    name = F.lit(None).cast("string") if file_name is None else F.regexp_replace(F.col(file_name) if isinstance(file_name, str) else file_name, r"\.md$", "")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(F.try_element_at(md_front_matter(t), F.lit("title"))), some(F.regexp_extract(t, r"(?m)^#\s+(.+)$", 1)), some(F.regexp_extract(t, r"(?m)^#{2,6}\s+(.+)$", 1)), some(name), F.lit("Untitled"))


def md_wikilinks(text: str | Column) -> Column:
    """Targets of [[target|label]] links."""
    return F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))


def md_tags(text: str | Column) -> Column:
    bare = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?s)```.*?```|`[^`]*`", " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), F.lit(1)), lambda x: F.lower(x))))


def md_code_blocks(text: str | Column) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))


def chunks(text: str | Column, most: int = 4000) -> Column:
    """Paragraphs packed greedily into chunks of at most ``most`` characters; a longer paragraph stays whole."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, r"\n\n+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) + 2 <= most
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), p.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def vault_edges(notes: DataFrame, name: str, text: str) -> DataFrame:
    """(source, target) of wikilinks that resolve to a note's name or title, whatever the case."""
    titles = notes.select(F.col(name).alias("target"), F.explode(F.array_distinct(F.array(F.lower(F.col(name)), F.lower(md_title(text, name))))).alias("k")).dropDuplicates(["k"])
    links = notes.select(F.col(name).alias("source"), F.explode(md_wikilinks(text)).alias("link")).select("source", F.lower("link").alias("k"))
    return links.join(titles, "k").select("source", "target").distinct()
