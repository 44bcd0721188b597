"""Windows, ordered analytics, time series and statistics over the events and sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import statistics as S
from lattica.operators import timeseries as TS
from lattica.operators import windows as W
from lattica.session import table as T


def _ev(s, d):
    return T(s, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def _r(df, places=6, *columns):
    return df.select(*[F.round(c, places).alias(c) if (not columns and t in ("double", "float")) or c in columns else F.col(c) for c, t in df.dtypes])


_E = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)"
H, D = 3_600_000, 86_400_000

QUERIES = {
    "win_tumbling": (lambda s, d: _r(W.window_metrics(W.tumbling(_ev(s, d), "ms", 6 * H), ["window_start", "window_end"], "value")), f"WITH e AS {_E}, b AS (SELECT min(ms) AS t0 FROM e) SELECT t0 + (ms - t0) // {6 * H} * {6 * H} AS window_start, t0 + (ms - t0) // {6 * H} * {6 * H} + {6 * H} AS window_end, count(value) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max FROM e, b GROUP BY 1, 2"),
    "win_tumbling_keyed": (lambda s, d: W.tumbling(_ev(s, d), "ms", D, ["event_type"]).groupBy("event_type", "window_start").agg(F.count("*").alias("n")), f"WITH e AS {_E} SELECT event_type, t0 + (ms - t0) // {D} * {D} AS window_start, count(*) AS n FROM e JOIN (SELECT event_type, min(ms) AS t0 FROM e GROUP BY 1) USING (event_type) GROUP BY 1, 2"),
    "win_sliding": (lambda s, d: W.sliding(_ev(s, d), "ms", D, 6 * H).groupBy("window_start", "window_end").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")), f"WITH e AS {_E}, b AS (SELECT min(ms) AS t0, max(ms) AS mx FROM e), w AS (SELECT t0, t0 + k * {6 * H} - {D} AS window_start, t0 + k * {6 * H} AS window_end FROM b, LATERAL (SELECT unnest(range(1, (mx - t0) // {6 * H} + 2)) AS k)) SELECT window_start, window_end, count(*) AS n, min(event_id) AS first_id FROM w JOIN e ON ms >= window_start AND ms < window_end GROUP BY 1, 2"),
    "win_session": (lambda s, d: W.session_bounds(_ev(s, d), "ms", 6 * H, ["user_id"], ["event_id"]), f"WITH e AS {_E}, f AS (SELECT *, CAST(coalesce(ms - lag(ms) OVER w >= {6 * H}, false) AS INT) AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), g AS (SELECT *, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f) SELECT user_id, session, min(ms) AS start, max(ms) AS \"end\", count(*) AS n FROM g GROUP BY 1, 2"),
    "win_count": (lambda s, d: W.count_windows(_ev(s, d), ["ms", "event_id"], 10, ["user_id"]).groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")), f"WITH e AS {_E} SELECT user_id, CAST((i - 1) // 10 AS BIGINT) AS batch, count(*) AS n, max(event_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e) GROUP BY 1, 2"),
    "win_throttle": (lambda s, d: W.throttle(_ev(s, d), "ms", H, ["user_id"], ["event_id"]).groupBy("user_id").agg(F.count("*").alias("n")), f"WITH e AS {_E} SELECT user_id, count(*) AS n FROM (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS g FROM e) WHERE g IS NULL OR g >= {H} GROUP BY 1"),
    "win_debounce": (lambda s, d: W.debounce(_ev(s, d), "ms", 2 * H, ["user_id"], ["event_id"]).select("event_id"), f"WITH e AS {_E} SELECT event_id FROM (SELECT event_id, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) - ms AS g FROM e) WHERE g IS NULL OR g >= {2 * H}"),
    "win_event_dedupe": (lambda s, d: W.dedupe_events(_ev(s, d), "ms", 12 * H, ["user_id", "event_type"], ["event_id"]).select("event_id"), f"WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), k AS (SELECT user_id, event_type, min(ms) AS ms FROM e GROUP BY 1, 2 UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.ms) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.ms >= k.ms + {12 * H}) AS ms FROM k WHERE k.ms IS NOT NULL) SELECT event_id FROM e JOIN (SELECT * FROM k WHERE ms IS NOT NULL) USING (user_id, event_type, ms)"),
    "win_scan_running": (lambda s, d: _r(_ev(s, d).withColumn("running", F.expr("sum(value) over (partition by user_id order by ms, event_id rows unbounded preceding)")).select("event_id", "running"), 4), f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM {_E}"),
    "ts_downsample": (lambda s, d: _r(TS.downsample(_ev(s, d), H, "avg")), f"SELECT ms // {H} * {H} AS bucket, round(avg(value), 6) AS value, count(*) AS n FROM {_E} GROUP BY 1"),
    "ts_downsample_p95": (lambda s, d: _r(TS.downsample(_ev(s, d), D, "p95", ["event_type"])), f"SELECT event_type, ms // {D} * {D} AS bucket, round(quantile_cont(value, 0.95), 6) AS value, count(*) AS n FROM {_E} GROUP BY 1, 2"),
    "ts_query_range": (lambda s, d: _r(TS.query_range(_ev(s, d), 1704500000000, 1705000000000, 12 * H, "max")), f"SELECT ms // {12 * H} * {12 * H} AS bucket, round(max(value), 6) AS value, count(*) AS n FROM {_E} WHERE ms BETWEEN 1704500000000 AND 1705000000000 GROUP BY 1"),
    "ts_summary": (lambda s, d: _r(TS.summary(_ev(s, d)), 4), f"SELECT count(value) AS count, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS avg, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM {_E}"),
    "ts_rolling": (lambda s, d: _r(TS.rolling(_ev(s, d), D, "sum", ["user_id"]).select("event_id", "rolling"), 4), f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {D} PRECEDING AND CURRENT ROW), 4) AS rolling FROM {_E}"),
    "ts_sma": (lambda s, d: _r(TS.moving_average(_ev(s, d), 5, ["user_id"], ["ms", "event_id"]).select("event_id", "sma")), f"SELECT event_id, round(sma, 6) AS sma FROM (SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS 4 PRECEDING) AS sma, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM {_E}) WHERE i >= 5"),
    "ts_wma": (lambda s, d: _r(TS.weighted_average(_ev(s, d), [1.0, 2.0, 3.0], ["user_id"], ["ms", "event_id"]).select("event_id", "wma")), f"SELECT event_id, round((lag(value, 2) OVER w + 2 * lag(value, 1) OVER w + 3 * value) / 6, 6) AS wma FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id) QUALIFY wma IS NOT NULL"),
    "ts_ema": (lambda s, d: _r(TS.exponential_average(_ev(s, d), 0.3, ["user_id"], ["ms", "event_id"]).select("event_id", "ema")), f"WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM {_E}), r AS (SELECT event_id, user_id, i, value AS ema FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, 0.3 * o.value + 0.7 * r.ema FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT event_id, round(ema, 6) AS ema FROM r"),
    "ts_rate": (lambda s, d: _r(TS.rate(_ev(s, d), D, H, ["user_id"]).select("event_id", "rate")), f"WITH e AS {_E} SELECT event_id, round((value - bv) / (ms - bms) * {H}, 6) AS rate FROM (SELECT e.event_id, e.value, e.ms, coalesce(b.ms, f.ms) AS bms, coalesce(b.value, f.value) AS bv FROM e ASOF LEFT JOIN (SELECT user_id AS u, ms + {D} AS m2, ms, value FROM e) b ON e.user_id = b.u AND e.ms >= b.m2 JOIN (SELECT user_id, min(ms) AS ms, arg_min(value, ms) AS value FROM e GROUP BY 1) f ON f.user_id = e.user_id) WHERE ms > bms"),
    "ts_fill_gaps": (lambda s, d: _r(TS.fill_gaps(TS.downsample(_ev(s, d), H, "sum", ["event_type"]).select("event_type", F.col("bucket").alias("ms"), "value"), H, ["event_type"])), f"WITH b AS (SELECT event_type, ms // {H} * {H} AS ms, sum(value) AS value FROM {_E} GROUP BY 1, 2), p AS (SELECT *, lead(ms) OVER w AS t, lead(value) OVER w AS v FROM b WINDOW w AS (PARTITION BY event_type ORDER BY ms)) SELECT event_type, ms, round(value, 6) AS value, false AS filled FROM b UNION ALL SELECT event_type, ms + s * {H} AS ms, round(value + (v - value) * s / ((t - ms) // {H}), 6) AS value, true AS filled FROM p, LATERAL (SELECT unnest(range(1, (t - ms) // {H})) AS s) WHERE t - ms > {H} AND t - ms <= 5 * {H}"),
    "ts_latest": (lambda s, d: TS.latest(_ev(s, d), 30, ties=["event_id"]).select("event_id", "ms"), f"SELECT event_id, ms FROM {_E} ORDER BY ms DESC, event_id LIMIT 30"),
    "ts_delta": (lambda s, d: TS.deltas(_ev(s, d), ["user_id"], ["ms", "event_id"], "ms").select("event_id", "delta"), f"SELECT event_id, ms - coalesce(lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id), 0) AS delta FROM {_E}"),
    "ts_undelta": (lambda s, d: TS.undelta(TS.deltas(_ev(s, d).drop("value"), ["user_id"], ["ms", "event_id"], "ms"), ["user_id"], ["ms", "event_id"], "delta").select("event_id", "value"), f"SELECT event_id, ms AS value FROM {_E}"),
    "ts_zscore": (lambda s, d: _r(TS.z_scores(_ev(s, d), ["event_type"]).select("event_id", "z")), f"SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM {_E} WINDOW w AS (PARTITION BY event_type)"),
    "ts_anomalies": (lambda s, d: TS.anomalies(TS.downsample(_ev(s, d), H, "sum", ["event_type"]), ["event_type"], 2.5).select("event_type", "bucket", "n"), f"WITH b AS (SELECT event_type, ms // {H} * {H} AS bucket, sum(value) AS value, count(*) AS n FROM {_E} GROUP BY 1, 2) SELECT event_type, bucket, n FROM b QUALIFY abs((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type)) >= 2.5"),
    "ts_ranks_ties": (lambda s, d: TS.average_ranks(T(s, d, "lineitem").select("l_returnflag", "l_quantity").distinct().unionAll(T(s, d, "part").select(F.lit("P"), F.col("p_size").cast("double"))), ["l_returnflag"], "l_quantity"), "WITH v AS (SELECT DISTINCT l_returnflag, l_quantity FROM lineitem UNION ALL SELECT 'P', CAST(p_size AS DOUBLE) FROM part) SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank FROM v"),
    "ts_heatmap": (lambda s, d: T(s, d, "events").withColumn("hour", F.hour("ts").cast("long")).groupBy("hour").pivot("event_type", ["click", "view"]).agg(F.count("event_id")).select("hour", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view")), "SELECT hour(ts) AS hour, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1"),
    # ---- statistics
    "stat_describe": (lambda s, d: _r(S.describe(T(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), 3).withColumnRenamed("range", "spread"), "SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 3) AS mean, round(median(l_extendedprice), 3) AS median, round(var_pop(l_extendedprice), 3) AS var_pop, round(var_samp(l_extendedprice), 3) AS var_samp, round(stddev_pop(l_extendedprice), 3) AS sd_pop, round(stddev_samp(l_extendedprice), 3) AS sd_samp, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 3) AS iqr, round(max(l_extendedprice) - min(l_extendedprice), 3) AS spread, round(skewness(l_extendedprice), 3) AS skewness, round(kurtosis(l_extendedprice), 3) AS kurtosis FROM lineitem GROUP BY 1"),
    "stat_modes": (lambda s, d: S.modes(T(s, d, "part"), "p_size"), "SELECT p_size FROM part GROUP BY 1 QUALIFY count(*) = max(count(*)) OVER ()"),
    "stat_linear_regression": (lambda s, d: _r(S.linear_regression(T(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"]), 6), "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1"),
    "stat_polynomial_regression": (lambda s, d: s.createDataFrame([(i, round(c, 3)) for i, c in enumerate(S.polynomial_regression(T(s, d, "part").withColumn("x", F.col("p_size") / 50.0), "x", "p_retailprice", 2))], "power int, coefficient double"), None),
    "stat_correlation": (lambda s, d: _r(T(s, d, "lineitem").groupBy("l_returnflag").agg(S.pearson("l_quantity", "l_extendedprice").alias("r"), F.covar_pop("l_quantity", "l_discount").alias("cov_pop"), F.covar_samp("l_quantity", "l_discount").alias("cov_samp"))), "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cov_pop, round(covar_samp(l_quantity, l_discount), 6) AS cov_samp FROM lineitem GROUP BY 1"),
    "stat_spearman": (lambda s, d: _r(S.spearman(T(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])), "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1"),
    "stat_chi_square": (lambda s, d: _r(S.chi_square(T(s, d, "orders"), "o_orderstatus", "o_orderpriority"), 6), "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS o FROM orders GROUP BY 1, 2), r AS (SELECT o_orderstatus, sum(o) AS r FROM c GROUP BY 1), k AS (SELECT o_orderpriority, sum(o) AS k FROM c GROUP BY 1), g AS (SELECT r.o_orderstatus, k.o_orderpriority, r * k / (SELECT sum(o) FROM c) AS e, coalesce(o, 0) AS o FROM r CROSS JOIN k LEFT JOIN c USING (o_orderstatus, o_orderpriority)) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, (count(DISTINCT o_orderstatus) - 1) * (count(DISTINCT o_orderpriority) - 1) AS df FROM g"),
    "stat_t_test": (lambda s, d: _r(S.t_test(T(s, d, "events"), "event_type", "value", "click", "view"), 6), "WITH v AS (SELECT avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') AS ea, var_samp(value) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'view') AS eb FROM events) SELECT round((a - b) / sqrt(ea + eb), 6) AS t FROM v"),
    "stat_confidence": (lambda s, d: _r(T(s, d, "events").groupBy("event_type").agg(S.confidence_interval("value")[0].alias("low"), S.confidence_interval("value")[1].alias("high"))), "SELECT event_type, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS high FROM events GROUP BY 1"),
    "stat_power_law": (lambda s, d: _r(S.power_law(T(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m")), "n", "m")), "WITH p AS (SELECT n, count(*) AS m FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1) SELECT round(-regr_slope(ln(m), ln(n)), 6) AS exponent, round(regr_r2(ln(m), ln(n)), 6) AS r2, count(*) >= 3 AND regr_r2(ln(m), ln(n)) >= 0.85 AS is_power_law FROM p"),
    "stat_histogram": (lambda s, d: _r(S.histogram(T(s, d, "orders"), "o_totalprice", 12)), "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS t FROM orders), c AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 12)) AS BIGINT), 11) AS bin, count(*) AS n FROM orders, b GROUP BY 1) SELECT r AS bin, round(lo + r * (hi - lo) / 12, 6) AS low, coalesce(n, 0) AS n, round(coalesce(n, 0) / t, 6) AS share FROM range(12) s(r) CROSS JOIN b LEFT JOIN c ON r = bin"),
    "stat_bin_counts": (lambda s, d: S.bin_counts(T(s, d, "orders"), "o_totalprice"), "SELECT CAST(ceil(log2(count(*)) + 1) AS BIGINT) AS sturges, CAST(ceil((max(o_totalprice) - min(o_totalprice)) / (3.49 * stddev_samp(o_totalprice) / cbrt(count(*)))) AS BIGINT) AS scott, CAST(ceil((max(o_totalprice) - min(o_totalprice)) / (2 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / cbrt(count(*)))) AS BIGINT) AS freedman_diaconis FROM orders"),
    "stat_iqr_outliers": (lambda s, d: S.iqr_outliers(T(s, d, "events").select("event_id", "value"), "value"), "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"),
    "stat_z_outliers": (lambda s, d: S.z_outliers(T(s, d, "events").select("event_id", "value"), "value", 2.0), "WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, value FROM events, q WHERE abs((value - m) / s) > 2"),
    "stat_trend": (lambda s, d: S.trend(TS.downsample(_ev(s, d), D, "sum", ["event_type"]), ["bucket"], "value", ["event_type"]).select("event_type", "trend"), f"WITH b AS (SELECT event_type, ms // {D} AS day, sum(value) AS v FROM {_E} GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM b) SELECT event_type, CASE WHEN regr_r2(v, i) < 0.3 OR regr_slope(v, i) = 0 THEN 'stable' WHEN regr_slope(v, i) > 0 THEN 'rising' ELSE 'falling' END AS trend FROM i GROUP BY 1"),
}
