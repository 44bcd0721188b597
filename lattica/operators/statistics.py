"""Statistics of columns. ``population`` and ``sample`` conventions are named apart."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.quantiles import exact_quantiles, with_quantiles
from lattica.operators.timeseries import average_ranks

#: Normal quantiles of two-sided confidence levels (fixed values).
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


def modes(df: DataFrame, value: str) -> DataFrame:
    """All most frequent values."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(top), "n").select(value)


def skewness_sample(value: str | Column) -> Column:
    """Null for fewer than three values."""
    n, g = F.count(value), F.skewness(value)
    return F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.when(n > 2, g)


def kurtosis_sample(value: str | Column) -> Column:
    """Null for fewer than four values."""
    n, g = F.count(value), F.kurtosis(value)
    return F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.when(n > 3, g) + 6)


def describe(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Both variance conventions, shape and range in one aggregation; quartiles from sorted ranges."""
    keys = list(keys or [])
    made = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var_pop"), F.var_samp(value).alias("var_samp"),
        F.stddev_pop(value).alias("sd_pop"), F.stddev_samp(value).alias("sd_samp"), (F.max(value) - F.min(value)).alias("range"),
        skewness_sample(value).alias("skewness"), kurtosis_sample(value).alias("kurtosis"),
    )
    full = with_quantiles(made, df, value, {"median": 0.5, "_q1": 0.25, "_q3": 0.75}, keys).withColumn("iqr", F.col("_q3") - F.col("_q1"))
    return full.select(*keys, "n", "mean", "median", "var_pop", "var_samp", "sd_pop", "sd_samp", "iqr", "range", "skewness", "kurtosis")


def linear_regression(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2; slope 0 where x does not vary, r2 1 where y does not."""
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    return df.groupBy(*(keys or [])).agg(slope.alias("slope"), F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"), F.when(F.var_pop(y) == 0, 1.0).otherwise(F.coalesce(F.regr_r2(y, x), F.lit(0.0))).alias("r2"))


def polynomial_regression(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients from the lowest power; the sums of powers are aggregated in Spark, 4 by 4 at most solved here."""
    sums = df.agg(*[F.sum(F.pow(F.col(x), k)).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(F.col(x), k) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)]).first()
    a = np.array([[sums[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    return np.linalg.solve(a, np.array([sums[f"t{i}"] for i in range(degree + 1)], float)).tolist()


def pearson(x: str, y: str) -> Column:
    return F.coalesce(F.when(F.isnan(F.corr(x, y)), 0.0).otherwise(F.corr(x, y)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(pearson("_rx", "_ry").alias("spearman"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    grid = rows.crossJoin(columns).crossJoin(total).join(cells, [row, column], "left")
    expected = F.col("r") * F.col("c") / F.col("n")
    return grid.agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - expected, 2) / expected).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("df"))


def t_test(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Welch's statistic of two groups."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    ea, eb = of(F.var_samp, a) / of(F.count, a), of(F.var_samp, b) / of(F.count, b)
    return df.agg(((of(F.avg, a) - of(F.avg, b)) / F.sqrt(ea + eb)).alias("t"))


def confidence_interval(value: str, level: float = 0.95) -> tuple[Column, Column]:
    half = Z[level] * F.stddev_samp(value) / F.sqrt(F.count(value))
    return F.avg(value) - half, F.avg(value) + half


def power_law(df: DataFrame, x: str, y: str, least_r2: float = 0.85) -> DataFrame:
    """Log-log regression over positive points; at least three are needed."""
    points = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log(x).alias("lx"), F.log(y).alias("ly"))
    fit = points.agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("slope"), F.regr_r2("ly", "lx").alias("r2"))
    return fit.select((-F.col("slope")).alias("exponent"), "r2", ((F.col("n") >= 3) & (F.col("r2") >= least_r2)).alias("is_power_law"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins with counts and shares; the maximum is in the last bin, empty bins are listed."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0).cast("long")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(bounds))
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def bin_counts(df: DataFrame, value: str) -> DataFrame:
    """Bins by the rules of Sturges, Scott and Freedman-Diaconis."""
    made = df.agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("spread"), F.stddev_samp(value).alias("sd"))
    full = with_quantiles(made, df, value, {"q1": 0.25, "q3": 0.75})
    n = F.col("n")
    width = lambda w: F.when(w > 0, F.ceil(F.col("spread") / w)).otherwise(1).cast("long")
    return full.select(F.ceil(F.log2(n) + 1).cast("long").alias("sturges"), width(3.49 * F.col("sd") / F.cbrt(n)).alias("scott"), width(2 * (F.col("q3") - F.col("q1")) / F.cbrt(n)).alias("freedman_diaconis"))


def iqr_outliers(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    out = df.crossJoin(F.broadcast(q))
    reach = factor * (F.col("q3") - F.col("q1"))
    return out.where((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)).drop("q1", "q3")


def z_outliers(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    q = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.crossJoin(F.broadcast(q)).where(F.abs((F.col(value) - F.col("_m")) / F.col("_s")) > threshold).drop("_m", "_s")


def trend(df: DataFrame, order: list[str], value: str, keys: list[str], least_r2: float = 0.3) -> DataFrame:
    """rising, falling or stable: the sign of a regression on the row number, if it explains enough."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fit = linear_regression(df.withColumn("_i", (F.row_number().over(w) - 1).cast("double")), "_i", value, keys)
    return fit.withColumn("trend", F.when((F.col("r2") < least_r2) | (F.col("slope") == 0), "stable").when(F.col("slope") > 0, "rising").otherwise("falling"))
