"""Validation, event sourcing, replicated data, audit, metrics, alerts and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import history as H
from lattica.operators import observability as O
from lattica.operators import quality as V
from lattica.operators.graph import vertices
from lattica.plans.graphs import _G, _N, forward, trade
from lattica.session import table as T


def _ev(s, d):
    return T(s, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def _log(s, d):
    return _ev(s, d).select(F.col("event_id").alias("sequence"), F.col("user_id").alias("aggregate"), F.col("event_type").alias("type"), "value", "ms")


def _nodes(s, d):
    return vertices(trade(s, d)).withColumn("type", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))


def _r(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _paths(s, d, keep, raise_):
    base = T(s, d, "nation").where(keep)
    name = F.when(raise_, F.upper("n_name")).otherwise(F.lower("n_name"))
    return base.select(F.col("n_nationkey").alias("id"), F.lit("name").alias("path"), name.alias("value")).union(base.select("n_nationkey", F.lit("region"), F.col("n_regionkey").cast("string")))


_E = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)"
_BOUNDS = [10.0, 25.0, 50.0, 75.0, 90.0]
_BK = f"b AS (SELECT event_type, x AS le, count(*) FILTER (value <= x) AS n FROM events, (SELECT unnest([10, 25, 50, 75, 90, 'inf'::DOUBLE]) AS x) GROUP BY 1, 2)"
_PCT = f"WITH {_BK}, p AS (SELECT *, coalesce(lag(le) OVER w, 0) AS pb, coalesce(lag(n) OVER w, 0) AS pc, 0.8 * max(n) OVER (PARTITION BY event_type) AS t FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN pb ELSE pb + (t - pc) / (n - pc) * (le - pb) END, 6) AS value FROM p WHERE n >= t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1"


def _limit_sql(start, allowed, after):
    """Sequential rate limit as a recursive query over numbered requests."""
    return f"WITH RECURSIVE r AS (SELECT event_id, user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM {_E}), f AS ({start} UNION ALL SELECT r.event_id, r.user_id, r.i, r.ms, {after}, {allowed} FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1) SELECT event_id, allowed FROM f"


QUERIES = {
    "rules_fields": (lambda s, d: V.check(T(s, d, "part"), "p_partkey", [V.min_length("p_name", 12), V.max_length("p_type", 20), V.pattern("p_brand", "^Brand#[0-9]+$"), V.at_least("p_size", 5), V.at_most("p_retailprice", 1500.0), V.multiple_of("p_size", 2), V.no_html("p_name"), V.trimmed("p_name"), V.one_of("p_size", list(range(1, 46)))]), "SELECT p_partkey, unnest(list_filter([CASE WHEN NOT length(p_name) >= 12 THEN 'p_name.minLength' END, CASE WHEN NOT length(p_type) <= 20 THEN 'p_type.maxLength' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[0-9]+$') THEN 'p_brand.pattern' END, CASE WHEN NOT p_size >= 5 THEN 'p_size.min' END, CASE WHEN NOT p_retailprice <= 1500 THEN 'p_retailprice.max' END, CASE WHEN p_size % 2 <> 0 THEN 'p_size.multipleOf' END, CASE WHEN p_size NOT BETWEEN 1 AND 45 THEN 'p_size.oneOf' END], lambda x: x IS NOT NULL)) AS rule FROM part"),
    "rules_conditional": (lambda s, d: V.check(T(s, d, "orders"), "o_orderkey", [V.when(F.col("o_orderstatus") == "F", V.at_least("o_totalprice", 50000.0)), V.before("o_orderdate", F.lit("2001-01-01").cast("timestamp")), V.weekday("o_orderdate"), V.required("o_custkey"), V.finite("o_totalprice"), V.precision("o_totalprice", 2)]), "SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'o_totalprice.min' END, CASE WHEN NOT o_orderdate < '2001-01-01' THEN 'o_orderdate.before' END, CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'o_orderdate.isWeekday' END], lambda x: x IS NOT NULL)) AS rule FROM orders"),
    "rules_valid_rows": (lambda s, d: V.valid(T(s, d, "customer"), [V.at_least("c_acctbal", 0.0), V.slug("c_mktsegment")]).select("c_custkey").union(V.valid(T(s, d, "customer"), [V.at_least("c_acctbal", 5000.0)]).select("c_custkey")), "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND regexp_matches(c_mktsegment, '^[a-z0-9]+(-[a-z0-9]+)*$') UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal >= 5000"),
    "rules_arrays": (lambda s, d: V.check(T(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("items")), "o_custkey", [V.min_items("items", 8), V.unique_items("items"), V.every("items", lambda x: x != "1-URGENT")]), "WITH c AS (SELECT o_custkey, list(o_orderpriority) AS items FROM orders GROUP BY 1) SELECT o_custkey, unnest(list_filter([CASE WHEN len(items) < 8 THEN 'items.minItems' END, CASE WHEN len(items) <> len(list_distinct(items)) THEN 'items.unique' END, CASE WHEN list_contains(items, '1-URGENT') THEN 'items.every' END], lambda x: x IS NOT NULL)) AS rule FROM c"),
    "rules_graph": (lambda s, d: V.crowded_nodes(trade(s, d), 7).union(V.duplicate_edges(trade(s, d).unionAll(trade(s, d).where("weight = 1").withColumn("id", F.col("id") + 100000)))).union(V.self_loops(trade(s, d))).union(V.missing_endpoints(trade(s, d), _nodes(s, d).where("id > 3"))).union(V.bad_type_pairs(trade(s, d), _nodes(s, d), {"first": [("even", "odd"), ("odd", "even")]})), f"WITH {_G}, {_N}, e AS (SELECT source * 100 + target AS id, * FROM g) SELECT 'maxEdgesPerNode' AS rule, CAST(id AS VARCHAR) AS id FROM (SELECT unnest([source, target]) AS id FROM g) GROUP BY 2 HAVING count(*) > 7 UNION ALL SELECT 'noDuplicateEdges', CAST(id + 100000 AS VARCHAR) FROM e WHERE weight = 1 UNION ALL SELECT 'validEdgeEndpoints', CAST(id AS VARCHAR) FROM e WHERE source <= 3 OR target <= 3 UNION ALL SELECT 'validEdgeTypeCombinations', CAST(id AS VARCHAR) FROM e WHERE type = 'first' AND source % 2 = target % 2"),
    "rules_graph_global": (lambda s, d: s.createDataFrame([(V.is_acyclic(forward(s, d)), V.is_acyclic(trade(s, d)), V.is_connected(trade(s, d), _nodes(s, d)))], "forward boolean, whole boolean, connected boolean"), "SELECT true AS forward, false AS whole, true AS connected"),
    "rules_integrity": (lambda s, d: T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("orders").alias("t"), F.col("o_orderkey").alias("k")).union(V.repeated_ids(T(s, d, "lineitem").select(F.col("l_orderkey").alias("id")).where("id < 50"), "uniqueNodeIds").select("rule", F.col("id").cast("long"))), "SELECT 'orders' AS t, o_orderkey AS k FROM orders ANTI JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'uniqueNodeIds', l_orderkey FROM lineitem WHERE l_orderkey < 50 GROUP BY 2 HAVING count(*) > 1"),
    # ---- history
    "log_query": (lambda s, d: H.query_log(_log(s, d), ["click", "view"], None, 100, 9000, 250, 60).select("sequence", "type"), f"SELECT event_id AS sequence, event_type AS type FROM events WHERE event_type IN ('click', 'view') AND event_id BETWEEN 100 AND 9000 AND event_id > 250 ORDER BY 1 LIMIT 60"),
    "log_replay": (lambda s, d: _r(H.replay(_log(s, d), "aggregate", "sequence", ["type", "value"], F.lit(0.0), lambda acc, e: F.when(e["type"] == "error", 0.0).otherwise(acc + e["value"])).select("aggregate", "state", F.col("version").cast("long").alias("version")), 4), f"WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) SELECT user_id AS aggregate, round(coalesce(sum(value) FILTER (event_type <> 'error' AND g = mg), 0), 4) AS state, count(*) AS version FROM r JOIN (SELECT user_id, max(g) AS mg FROM r GROUP BY 1) USING (user_id) GROUP BY 1"),
    "log_last_write": (lambda s, d: H.last_write(_log(s, d), ["aggregate", "type"], "value", ["sequence"]), "SELECT user_id AS aggregate, event_type AS type, arg_max(value, event_id) AS value, max(event_id) AS sequence FROM events GROUP BY 1, 2"),
    "log_compact": (lambda s, d: H.compact_log(_log(s, d), _log(s, d).where("aggregate % 2 = 0").groupBy("aggregate").agg(F.percentile_approx("sequence", 0.5, 1000000).alias("sequence")), "aggregate", "sequence").groupBy("aggregate").agg(F.count("*").alias("n")), "WITH s AS (SELECT user_id, quantile_disc(event_id, 0.5) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT e.user_id AS aggregate, count(*) AS n FROM events e LEFT JOIN s USING (user_id) WHERE v IS NULL OR event_id > v GROUP BY 1"),
    "log_as_of": (lambda s, d: H.as_of(_log(s, d), ["aggregate"], "ms", 1705000000000, "value"), f"SELECT user_id AS aggregate, arg_max(value, ms) AS value, max(ms) AS ms FROM {_E} WHERE ms <= 1705000000000 GROUP BY 1"),
    "log_prune": (lambda s, d: H.prune_versions(_log(s, d), ["aggregate"], ["sequence"], 5).select("sequence"), "SELECT event_id AS sequence FROM (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE i % 5 = 0 OR i = n - 1"),
    "log_version_numbers": (lambda s, d: H.version_numbers(_log(s, d), ["aggregate", "type"], ["sequence"]).select("sequence", "version"), "SELECT event_id AS sequence, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS version FROM events"),
    "diff_objects": (lambda s, d: H.diff_rows(_paths(s, d, "n_nationkey < 20", F.lit(False)), _paths(s, d, "n_nationkey > 4", F.col("n_nationkey") % 3 == 0)), "SELECT n_nationkey AS id, p AS path, CASE WHEN n_nationkey >= 20 THEN 'add' WHEN n_nationkey <= 4 THEN 'delete' ELSE 'modify' END AS kind, CASE WHEN n_nationkey < 20 THEN CASE p WHEN 'name' THEN lower(n_name) ELSE CAST(n_regionkey AS VARCHAR) END END AS before, CASE WHEN n_nationkey > 4 THEN CASE WHEN p = 'region' THEN CAST(n_regionkey AS VARCHAR) WHEN n_nationkey % 3 = 0 THEN upper(n_name) ELSE lower(n_name) END END AS after FROM nation, (SELECT unnest(['name', 'region']) AS p) WHERE n_nationkey >= 20 OR n_nationkey <= 4 OR (p = 'name' AND n_nationkey % 3 = 0)"),
    "merge_three_way": (lambda s, d: H.merge_rows(_paths(s, d, "n_nationkey >= 0", F.lit(False)), _paths(s, d, "n_nationkey < 20", F.col("n_nationkey") % 2 == 0), _paths(s, d, "n_nationkey >= 2", F.lit(False))).where("path = 'name'"), "SELECT n_nationkey AS id, 'name' AS path, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS value, n_nationkey % 2 = 0 AND n_nationkey < 2 AS conflict FROM nation WHERE n_nationkey < 20 AND (n_nationkey >= 2 OR n_nationkey % 2 = 0)"),
    "crdt_counters": (lambda s, d: _r(H.merge_counters(_log(s, d), "type", "aggregate", "value"), 4), "SELECT event_type AS type, round(sum(m), 4) AS value FROM (SELECT event_type, user_id, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1"),
    "crdt_pn_counters": (lambda s, d: H.merge_pn_counters(_log(s, d).withColumn("down", F.col("sequence") % 7), "type", "aggregate", "sequence", "down"), "SELECT event_type AS type, CAST(sum(p) - sum(n) AS BIGINT) AS value FROM (SELECT event_type, user_id, max(event_id) AS p, max(event_id % 7) AS n FROM events GROUP BY 1, 2) GROUP BY 1"),
    "crdt_or_sets": (lambda s, d: H.merge_or_sets(_log(s, d), _log(s, d).where("type = 'error'"), "aggregate", "sequence"), "SELECT user_id AS aggregate, count(*) AS tags FROM events WHERE event_type <> 'error' GROUP BY 1"),
    "crdt_clocks": (lambda s, d: T(s, d, "nation").select("n_nationkey", H.compare_clocks(F.create_map(F.lit("a"), F.col("n_regionkey"), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.col("n_nationkey") % 4)).alias("c"), H.merge_clocks(F.create_map(F.lit("a"), F.col("n_regionkey")), F.create_map(F.lit("a"), F.lit(2)))["a"].alias("m")), "SELECT n_nationkey, CASE WHEN (n_regionkey < 2 OR 2 < n_nationkey % 4) AND (n_regionkey > 2 OR 2 > n_nationkey % 4) THEN 'concurrent' WHEN n_regionkey < 2 OR 2 < n_nationkey % 4 THEN 'before' WHEN n_regionkey > 2 OR 2 > n_nationkey % 4 THEN 'after' ELSE 'equal' END AS c, greatest(n_regionkey, 2) AS m FROM nation"),
    "audit_alerts": (lambda s, d: H.audit_alerts(_ev(s, d).where("event_type = 'error'"), ["user_id"], "ms", 172_800_000, 3), None),
    "backup_retention": (lambda s, d: H.retained(T(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "2001-01-01", 3, 7, 4, 6).select("o_orderkey"), "WITH o AS (SELECT o_orderkey, o_orderdate FROM orders) SELECT DISTINCT o_orderkey FROM o WHERE o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 180 DAY OR o_orderkey IN (SELECT o_orderkey FROM o ORDER BY o_orderdate DESC LIMIT 3)"),
    # ---- metrics, alerts, limits
    "metric_gauges": (lambda s, d: O.gauges(_ev(s, d), ["event_type"], "value", ["ms", "event_id"]), f"SELECT event_type, arg_max(value, (ms, event_id)) AS value, min(value) AS min, max(value) AS max FROM {_E} GROUP BY 1"),
    "metric_counters": (lambda s, d: O.counters(_ev(s, d), ["event_type", "user_id"], "event_id"), "SELECT event_type, user_id, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY 1, 2"),
    "metric_buckets": (lambda s, d: O.bucket_counts(_ev(s, d), ["event_type"], "value", _BOUNDS), f"WITH {_BK} SELECT * FROM b"),
    "metric_percentile": (lambda s, d: _r(O.bucket_percentile(O.bucket_counts(_ev(s, d), ["event_type"], "value", _BOUNDS), ["event_type"], 0.8)), _PCT),
    "metric_exposition": (lambda s, d: O.exposition(_ev(s, d).groupBy("event_type").agg(F.count("*").alias("n")), "events_total", ["event_type"], "n"), "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type"),
    "alert_islands": (lambda s, d: O.firing_islands(_ev(s, d), ["user_id"], "ms", F.col("value") > 40, 3_600_000), f"WITH f AS (SELECT *, value > 40 AS f FROM {_E}), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, min(ms) AS start, max(ms) AS \"end\" FROM g WHERE f GROUP BY user_id, g HAVING max(ms) - min(ms) >= 3600000"),
    "alert_absent": (lambda s, d: O.absent(_ev(s, d), ["user_id", "event_type"], "ms", 1706600000000, 432_000_000), f"SELECT user_id, event_type, max(ms) AS last FROM {_E} GROUP BY 1, 2 HAVING max(ms) < 1706600000000 - 432000000"),
    "trace_self_time": (lambda s, d: O.span_tree(_ev(s, d).select(F.col("event_id").alias("span"), F.floor(F.col("event_id") / 4).alias("parent"), F.col("event_id").alias("start"), (F.col("event_id") * 2).alias("end")), "span", "parent", "start", "end").select("span", "self_time", "children"), "SELECT e.event_id AS span, e.event_id - coalesce(c, 0) AS self_time, coalesce(k, 0) AS children FROM events e LEFT JOIN (SELECT event_id // 4 AS p, CAST(sum(event_id) AS BIGINT) AS c, count(*) AS k FROM events GROUP BY 1) ON p = e.event_id"),
    "health_services": (lambda s, d: O.health(T(s, d, "orders").select((F.col("o_custkey") % 50).alias("service"), F.when(F.col("o_totalprice") > 180000, "unhealthy").when(F.col("o_totalprice") > 150000, "degraded").otherwise("healthy").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("critical")), "service", "status", "critical"), "SELECT o_custkey % 50 AS service, CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_totalprice > 180000) THEN 'unhealthy' WHEN bool_or(o_totalprice > 150000) THEN 'degraded' ELSE 'healthy' END AS health FROM orders GROUP BY 1"),
    "limit_fixed_window": (lambda s, d: O.fixed_window(_ev(s, d), "user_id", "ms", 86_400_000, 2, ["event_id"]).select("event_id", "allowed"), f"SELECT event_id, row_number() OVER (PARTITION BY user_id, ms // 86400000 ORDER BY ms, event_id) <= 2 AS allowed FROM {_E}"),
    "limit_token_bucket": (lambda s, d: O.token_bucket(_ev(s, d), "user_id", "ms", 2.0, 1 / 43_200_000, ["event_id"]).select("event_id", "allowed"), _limit_sql("SELECT event_id, user_id, i, ms, 1.0::DOUBLE AS tokens, true AS allowed FROM r WHERE i = 1", "least(2.0, f.tokens + (r.ms - f.ms) / 43200000) >= 1", "least(2.0, f.tokens + (r.ms - f.ms) / 43200000) - CASE WHEN least(2.0, f.tokens + (r.ms - f.ms) / 43200000) >= 1 THEN 1 ELSE 0 END")),
    "limit_leaky_bucket": (lambda s, d: O.leaky_bucket(_ev(s, d), "user_id", "ms", 2.0, 1 / 43_200_000, ["event_id"]).select("event_id", "allowed"), _limit_sql("SELECT event_id, user_id, i, ms, 1.0::DOUBLE AS q, true AS allowed FROM r WHERE i = 1", "greatest(0.0, f.q - (r.ms - f.ms) / 43200000) < 2", "greatest(0.0, f.q - (r.ms - f.ms) / 43200000) + CASE WHEN greatest(0.0, f.q - (r.ms - f.ms) / 43200000) < 2 THEN 1 ELSE 0 END")),
    "limit_sliding_log": (lambda s, d: O.sliding_log(_ev(s, d), "user_id", "ms", 86_400_000, 2, ["event_id"]).select("event_id", "allowed"), _limit_sql("SELECT event_id, user_id, i, ms, [ms] AS l, true AS allowed FROM r WHERE i = 1", "len(list_filter(f.l, lambda x: x > r.ms - 86400000)) < 2", "CASE WHEN len(list_filter(f.l, lambda x: x > r.ms - 86400000)) < 2 THEN list_append(list_filter(f.l, lambda x: x > r.ms - 86400000), r.ms) ELSE list_filter(f.l, lambda x: x > r.ms - 86400000) END")),
    "limit_sliding_counter": (lambda s, d: O.sliding_counter(_ev(s, d), "user_id", "ms", 86_400_000, 2.0, ["event_id"]).groupBy("allowed").agg(F.count("*").alias("n")), None),
}
