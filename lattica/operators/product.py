"""Product analytics: active users, engagement, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight of an action in the engagement score (fixed values).
WEIGHTS = {"create": 10, "edit": 5, "search": 3, "view": 1, "delete": 2, "login": 1, "logout": 0, "share": 4, "export": 3}


def engagement(actions: DataFrame, limit: int = 50) -> DataFrame:
    """Weighted action score of each user, the highest first; ties go to the smaller user id."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("action")], F.lit(0))
    scores = actions.groupBy("user_id").agg(F.sum(weight).cast("long").alias("score"), F.count("*").alias("actions"), F.count_if(F.col("action") == "view").alias("views"), F.count_if(F.col("action") == "create").alias("creates"))
    return scores.orderBy(F.desc("score"), F.asc("user_id")).limit(limit)


def active_users(actions: DataFrame, day, days: int = 1) -> DataFrame:
    """Distinct users of the ``days`` days up to and with ``day``."""
    end = F.date_add(F.lit(day).cast("date"), 1)
    inside = (F.col("ts") >= F.date_add(end, -days)) & (F.col("ts") < end)
    return actions.where(inside).agg(F.count_distinct("user_id").alias("users"))


def active_series(actions: DataFrame) -> DataFrame:
    """Daily, 7-day and 30-day actives of every day, from distinct (user, day) pairs dealt to the days they count for."""
    pairs = actions.select("user_id", F.to_date("ts").alias("d")).distinct()
    bounds = pairs.agg(F.max("d").alias("mx"))
    spread = pairs.crossJoin(F.broadcast(bounds)).select("user_id", "d", F.explode(F.sequence("d", F.least(F.date_add("d", 29), F.col("mx")))).alias("day"))
    nearest = spread.groupBy("day", "user_id").agg(F.max("d").alias("d"))
    age = F.datediff("day", "d")
    return nearest.groupBy("day").agg(F.count_if(age == 0).alias("dau"), F.count_if(age < 7).alias("wau"), F.count("*").alias("mau"))


def heatmap(actions: DataFrame) -> DataFrame:
    """All 24 x 7 cells of hour and day of week (0 is Sunday), in UTC."""
    counts = actions.groupBy(F.hour("ts").cast("long").alias("hour"), (F.dayofweek("ts") - 1).cast("long").alias("dow")).agg(F.count("*").alias("n"))
    spark = actions.sparkSession
    spine = spark.range(24).withColumnRenamed("id", "hour").crossJoin(spark.range(7).withColumnRenamed("id", "dow"))
    return spine.join(counts, ["hour", "dow"], "left").select("hour", "dow", F.coalesce("n", F.lit(0)).alias("n"))


def retention(actions: DataFrame, weeks: int = 8) -> DataFrame:
    """Users of each cohort (ISO Monday of the first action) active in each week since, with the share."""
    first = actions.groupBy("user_id").agg(F.date_trunc("week", F.min("ts")).alias("cohort"))
    week = F.floor((F.unix_millis("ts") - F.unix_millis("cohort")) / (7 * 86_400_000)).cast("long")
    active = actions.join(first, "user_id").withColumn("week", week).where(F.col("week").between(0, weeks)).groupBy("cohort", "week").agg(F.count_distinct("user_id").alias("active"))
    sizes = first.groupBy("cohort").agg(F.count("*").alias("size"))
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), "cohort"), F.lit("-W"), F.lpad(F.weekofyear("cohort").cast("string"), 2, "0"))
    return active.join(sizes, "cohort").select(label.alias("cohort"), "week", "active", "size", (F.col("active") / F.col("size")).alias("share"))


def session_stats(events: DataFrame, session: str, ts: str, order: list[str]) -> DataFrame:
    """Start (first seen), end (last appended) and size of explicit sessions."""
    return events.groupBy(session).agg(F.min(ts).alias("start"), F.max_by(ts, F.struct(*order)).alias("end"), F.count("*").alias("n"))


def most(actions: DataFrame, action: str, node: str, n: int = 10) -> DataFrame:
    return actions.where(F.col("action") == action).groupBy(node).agg(F.count("*").alias("n")).orderBy(F.desc("n"), node).limit(n)


def quality_score(length: str, links: str, fields: str, age_days, tags: str):
    """Length, links, custom fields, freshness and tags, 100 at most, one decimal rounded half up."""
    total = F.least(F.lit(30.0), F.col(length) / 2000 * 30) + F.least(F.lit(25.0), F.col(links) / 10 * 25) + F.least(F.lit(20.0), F.col(fields) / 5 * 20) + F.greatest(F.lit(0.0), 15 * (1 - age_days / 365)) + F.least(F.lit(10.0), F.col(tags) / 5 * 10)
    return F.floor(total * 10 + 0.5) / 10


def score_buckets(scored: DataFrame, score: str) -> DataFrame:
    """Counts of five score ranges of width 20, the last closed; empty ones are listed."""
    at = F.least(F.floor(F.col(score) / 20), F.lit(4)).cast("long")
    spine = scored.sparkSession.range(5).withColumnRenamed("id", "bucket")
    return spine.join(scored.groupBy(at.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def growth(df: DataFrame, created: str, unit: str = "month") -> DataFrame:
    """Cumulative counts by bucket of ``unit``; buckets without rows repeat the total."""
    counts = df.groupBy(F.date_trunc(unit, created).alias("bucket")).agg(F.count("*").alias("new"))
    bounds = counts.agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"), F.expr(f"interval 1 {unit}"))).alias("bucket"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row per bucket of time
    return bounds.join(counts, "bucket", "left").select("bucket", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce(F.sum("new").over(w), F.lit(0)).alias("total"))


def normalized_query(text: str):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def query_stats(searches: DataFrame, query: str, results: str, latency: str) -> DataFrame:
    """Count, zero-result count, mean latency and mean results by normalised query."""
    return searches.groupBy(normalized_query(query).alias("query")).agg(F.count("*").alias("n"), F.count_if(F.col(results) == 0).alias("zero"), F.avg(latency).alias("latency"), F.avg(results).alias("results"))


def click_through(searches: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks per search by query; both have (query, ord), a click counts when its query was searched before."""
    first = searches.groupBy("query").agg(F.count("*").alias("searches"), F.min("ord").alias("first"))
    counted = clicks.join(first.select("query", "first"), "query").where(F.col("ord") > F.col("first")).groupBy("query").agg(F.count("*").alias("clicks"))
    return first.join(counted, "query", "left").select("query", "searches", F.coalesce("clicks", F.lit(0)).alias("clicks"), (F.coalesce("clicks", F.lit(0)) / F.col("searches")).alias("ctr"))


def suggest(stats: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    return stats.where(F.col("query").startswith(prefix.strip().lower())).orderBy(F.desc("n"), "query").limit(n)


def trending(searches: DataFrame, now_ms: int, recent_ms: int, history_ms: int) -> DataFrame:
    """Queries whose recent count exceeds what their history predicts; without history growth is infinite."""
    recent = F.count_if(F.col("ms") > now_ms - recent_ms)
    old = F.count_if((F.col("ms") <= now_ms - recent_ms) & (F.col("ms") > now_ms - recent_ms - history_ms))
    counted = searches.where(F.col("ms").between(now_ms - recent_ms - history_ms + 1, now_ms)).groupBy("query").agg(recent.alias("recent"), old.alias("old")).where("recent > 0")
    rate = F.when(F.col("old") == 0, F.lit(float("inf"))).otherwise(F.col("recent") / (F.col("old") * (recent_ms / history_ms)))
    return counted.withColumn("growth", rate).where("growth > 1")


def report(actions: DataFrame, day, days: int) -> DataFrame:
    """Actions, distinct users, creates, edits and views of a period and of the one before it."""
    end = F.date_add(F.lit(day).cast("date"), 1)
    now = actions.where((F.col("ts") >= F.date_add(end, -2 * days)) & (F.col("ts") < end))
    period = F.when(F.col("ts") >= F.date_add(end, -days), "current").otherwise("previous")
    count = lambda a: F.count_if(F.col("action") == a)
    return now.groupBy(period.alias("period")).agg(F.count("*").alias("actions"), F.count_distinct("user_id").alias("users"), count("create").alias("creates"), count("edit").alias("edits"), count("view").alias("views"))
