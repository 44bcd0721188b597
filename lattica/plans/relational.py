"""Predicates, builder clauses, joins, aggregates, ordering and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import joins as J
from lattica.operators import predicates as P
from lattica.operators import sets as S
from lattica.operators.builder import Query, after
from lattica.operators.quantiles import exact_quantiles
from lattica.session import table as T


def _q(spark, d, name):
    return Query(T(spark, d, name))


def _users(spark, d):
    return T(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def _half(spark, d, name, key, keep):
    return T(spark, d, name).where(F.col(key) % 3 != keep)



QUERIES = {
    # ---- predicates
    "pred_comparisons": (lambda s, d: T(s, d, "orders").where(P.all_of(P.compare("o_totalprice", ">", 1000.0), P.compare("o_totalprice", "<=", 200000.0), P.compare("o_orderstatus", "!=", "F"))).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000 AND o_orderstatus <> 'F'"),
    "pred_like": (lambda s, d: T(s, d, "part").where(P.any_of(P.like("p_name", "%a%e%"), P.like("p_type", "%BRASS%", fold=True)) & P.like("p_brand", "%1%", negate=True)).select("p_partkey"), "SELECT p_partkey FROM part WHERE (p_name LIKE '%a%e%' OR p_type ILIKE '%BRASS%') AND p_brand NOT LIKE '%1%'"),
    "pred_starts_ends_contains": (lambda s, d: T(s, d, "customer").where(P.any_of(P.starts_with("c_mktsegment", "AUTO"), P.ends_with("c_mktsegment", "LD"), P.contains("c_name", "_1"), P.contains("c_name", "99"))).select("c_custkey"), "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'AUTO') OR ends_with(c_mktsegment, 'LD') OR contains(c_name, '_1') OR contains(c_name, '99')"),
    "pred_in_lists": (lambda s, d: T(s, d, "nation").where(P.in_list("n_regionkey", [1, 2, 3]) & P.not_in_list("n_nationkey", [5, 8]) & P.not_in_list("n_name", [])).select("n_nationkey"), "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2, 3) AND n_nationkey NOT IN (5, 8)"),
    "pred_empty_in": (lambda s, d: T(s, d, "nation").where(P.in_list("n_nationkey", [])).select("n_nationkey"), "SELECT n_nationkey FROM nation WHERE 1 = 0"),
    "pred_between": (lambda s, d: T(s, d, "part").where(P.between("p_size", 5, 15) & P.between("p_retailprice", 950.0, 1000.0, negate=True)).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice NOT BETWEEN 950 AND 1000"),
    "pred_nulls": (lambda s, d: T(s, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v").isNotNull()).alias("others")), "SELECT count(*) FILTER (o_orderkey % 2 <> 0) AS nulls, count(*) FILTER (o_orderkey % 2 = 0) AS others FROM orders"),
    "pred_exists": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)"),
    "pred_not_exists": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "pred_flat_groups": (lambda s, d: _q(s, d, "part").where("p_size", "=", 1).or_where("p_size", ">", 40).where("p_retailprice", "<", 1200.0).or_where_group(("and", P.compare("p_size", "=", 7)), ("or", P.compare("p_size", "=", 9))).select("p_partkey").build(), "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size > 40 AND p_retailprice < 1200 OR (p_size = 7 OR p_size = 9)"),
    "pred_raw": (lambda s, d: _q(s, d, "lineitem").where_raw("l_quantity * l_discount > 4").where_raw("year(l_shipdate) = 1997").count().build(), "SELECT count(*) AS count FROM lineitem WHERE l_quantity * l_discount > 4 AND year(l_shipdate) = 1997"),
    "pred_labels": (lambda s, d: T(s, d, "events").withColumn("labels", F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))).where(P.has_labels("labels", {"type": "click", "user": "7"})).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 7"),
    # ---- builder clauses
    "sql_distinct": (lambda s, d: _q(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct().build(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "sql_alias_raw": (lambda s, d: _q(s, d, "nation").select("n_nationkey", ("n_name", "nation")).select_raw("n_regionkey * 10", "region10").build(), "SELECT n_nationkey, n_name AS nation, n_regionkey * 10 AS region10 FROM nation"),
    "sql_from_subquery": (lambda s, d: Query(_q(s, d, "orders").where("o_totalprice", ">", 100000.0).build()).group_by("o_orderpriority").count(alias="n").build(), "SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 100000) GROUP BY o_orderpriority"),
    "sql_where_subquery_in": (lambda s, d: _q(s, d, "customer").where_subquery("c_nationkey", "in", T(s, d, "nation").where("n_regionkey = 1").select("n_nationkey")).count().build(), "SELECT count(*) AS count FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "sql_where_subquery_not_in": (lambda s, d: _q(s, d, "customer").where_subquery("c_nationkey", "not in", T(s, d, "nation").where("n_regionkey = 1").select("n_nationkey")).count().build(), "SELECT count(*) AS count FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "sql_where_scalar_subquery": (lambda s, d: _q(s, d, "orders").where_subquery("o_totalprice", ">", T(s, d, "orders").agg(F.avg("o_totalprice").alias("a"))).count().build(), "SELECT count(*) AS count FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "sql_group_having": (lambda s, d: _q(s, d, "orders").group_by("o_custkey").count(alias="n").sum("o_totalprice", "total").having("n > 12").having("total > 100000").build().select("o_custkey", "n", F.round("total", 2).alias("total")), "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000"),
    "sql_aggregates": (lambda s, d: _q(s, d, "lineitem").group_by("l_returnflag", "l_linestatus").count().sum("l_quantity").avg("l_discount").min("l_extendedprice").max("l_tax").build().withColumn("avg_l_discount", F.round("avg_l_discount", 9)), "SELECT l_returnflag, l_linestatus, count(*) AS count, sum(l_quantity) AS sum_l_quantity, round(avg(l_discount), 9) AS avg_l_discount, min(l_extendedprice) AS min_l_extendedprice, max(l_tax) AS max_l_tax FROM lineitem GROUP BY ALL"),
    "sql_order_limit": (lambda s, d: _q(s, d, "orders").select("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey").limit(25).build(), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25"),
    "sql_page": (lambda s, d: _q(s, d, "supplier").select("s_suppkey").order_by("s_acctbal").order_by("s_suppkey").page(3, 10).build(), "SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 10 OFFSET 20"),
    "sql_cursor_page": (lambda s, d: after(T(s, d, "orders").select("o_orderdate", "o_orderkey"), None, ["o_orderkey"], 20).union(after(T(s, d, "orders").select("o_orderdate", "o_orderkey"), (500,), ["o_orderkey"], 20)), "(SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 21) UNION ALL (SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 21)"),
    "sql_list_nodes": (lambda s, d: _q(s, d, "part").where_raw("p_name ilike '%s%'").where("p_size", ">", 10).select("p_partkey").order_by("p_retailprice", "desc").order_by("p_partkey").page(2, 15).build(), "SELECT p_partkey FROM part WHERE p_name ILIKE '%s%' AND p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 15"),
    "sql_point_lookup": (lambda s, d: _q(s, d, "customer").where("c_custkey", "=", 77).select("c_custkey", "c_name").build(), "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77"),
    # ---- joins
    "join_inner": (lambda s, d: J.equi_join(T(s, d, "customer"), T(s, d, "orders"), [("c_custkey", "o_custkey")]).groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "join_inner_null_safe": (lambda s, d: J.equi_join(T(s, d, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("a")), T(s, d, "nation").select(F.col("n_nationkey").alias("m"), F.expr("nullif(n_regionkey, 2)").alias("b")), [("a", "b")]).select("n_nationkey", "m"), "SELECT x.n_nationkey, y.n_nationkey AS m FROM nation x JOIN nation y ON nullif(x.n_regionkey, 2) IS NOT DISTINCT FROM nullif(y.n_regionkey, 2)"),
    "join_left_outer": (lambda s, d: J.equi_join(T(s, d, "customer"), T(s, d, "orders").where("o_totalprice > 180000"), [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 180000"),
    "join_hash": (lambda s, d: J.equi_join(T(s, d, "orders"), T(s, d, "lineitem"), [("o_orderkey", "l_orderkey")], hint="shuffle_hash").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")), "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "join_merge": (lambda s, d: J.equi_join(T(s, d, "supplier"), T(s, d, "lineitem"), [("s_suppkey", "l_suppkey")], hint="merge").groupBy("s_nationkey").agg(F.count("*").alias("n")), "SELECT s_nationkey, count(*) AS n FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1"),
    "join_cross": (lambda s, d: Query(T(s, d, "region")).join(T(s, d, "nation").limit(25), how="cross").count().build(), "SELECT count(*) AS count FROM region, nation"),
    "join_right_full": (lambda s, d: Query(_half(s, d, "nation", "n_nationkey", 0).select(F.col("n_nationkey").alias("a"))).join(_half(s, d, "nation", "n_nationkey", 1).select(F.col("n_nationkey").alias("b")), F.col("a") == F.col("b"), "full").build().union(_half(s, d, "nation", "n_nationkey", 0).select(F.col("n_nationkey").alias("a")).join(_half(s, d, "nation", "n_nationkey", 1).select(F.col("n_nationkey").alias("b")), F.col("a") == F.col("b"), "right")), "WITH x AS (SELECT n_nationkey AS a FROM nation WHERE n_nationkey % 3 <> 0), y AS (SELECT n_nationkey AS b FROM nation WHERE n_nationkey % 3 <> 1) SELECT a, b FROM x FULL JOIN y ON a = b UNION ALL SELECT a, b FROM x RIGHT JOIN y ON a = b"),
    "join_theta": (lambda s, d: Query(T(s, d, "region")).join(T(s, d, "nation"), F.expr("n_regionkey < r_regionkey AND n_nationkey % 5 = r_regionkey")).build().select("r_name", "n_name"), "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey < r_regionkey AND n_nationkey % 5 = r_regionkey"),
    "join_semi_anti": (lambda s, d: T(s, d, "part").join(T(s, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").join(T(s, d, "lineitem").where("l_tax > 0.07 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07 AND l_returnflag = 'R')"),
    "join_interval": (lambda s, d: J.interval_join(_users(s, d).where("event_type = 'click'").select("event_id", "user_id", F.timestamp_millis("ms").alias("t")), _users(s, d).where("event_type = 'purchase'").select(F.col("event_id").alias("other"), F.col("user_id").alias("u"), F.timestamp_millis("ms").alias("t2")), [("user_id", "u")], "t", "t2", 3_600_000).select("event_id", "other"), f"SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) // 1000 - epoch_us(b.ts) // 1000) <= 3600000"),
    "join_overlap": (lambda s, d: J.overlap_join(T(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") / 10).alias("hi")), T(s, d, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("lo2"), (F.abs("s_acctbal") + 3).alias("hi2")), ("lo", "hi"), ("lo2", "hi2"), 10.0).select("p_partkey", "s_suppkey"), "SELECT p_partkey, s_suppkey FROM part, supplier WHERE p_retailprice <= abs(s_acctbal) + 3 AND abs(s_acctbal) <= p_retailprice + p_size / 10"),
    "join_as_of": (lambda s, d: J.as_of_join(_users(s, d).where("event_type = 'purchase'").select("event_id", "user_id", "ms"), _users(s, d).where("event_type = 'view'").select("user_id", F.col("ms").alias("vms"), F.col("event_id").alias("seen")), "user_id", "ms", "vms", "seen").select("event_id", "as_of_seen"), f"SELECT a.event_id, (SELECT arg_max(b.event_id, b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS as_of_seen FROM events a WHERE a.event_type = 'purchase'"),
    "join_zip": (lambda s, d: J.zip_join(T(s, d, "supplier").select("s_suppkey"), T(s, d, "nation").select("n_nationkey"), ["s_suppkey"], ["n_nationkey"]).select("s_suppkey", "n_nationkey"), "SELECT s_suppkey, n_nationkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) USING (i)"),
    "join_batch_lookup": (lambda s, d: s.createDataFrame([(i, k) for i, k in enumerate([9, 3, 9, 700000])], "ord int, k long").join(T(s, d, "part").select("p_partkey", "p_name"), F.col("k") == F.col("p_partkey"), "left").select("ord", "k", "p_name"), "SELECT CAST(ord AS INTEGER) AS ord, CAST(k AS BIGINT) AS k, p_name FROM (VALUES (0, 9), (1, 3), (2, 9), (3, 700000)) v(ord, k) LEFT JOIN part ON k = p_partkey"),
    # ---- aggregates, ordering, sets
    "agg_percentiles": (lambda s, d: exact_quantiles(T(s, d, "lineitem"), "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["l_returnflag"]).select("l_returnflag", *[F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")]), "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1"),
    "agg_grouping_sets": (lambda s, d: T(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupingSets([["day"], ["user_id"], ["event_type"]], "day", "user_id", "event_type").agg(F.count("*").alias("n")), "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, count(*) AS n FROM events GROUP BY GROUPING SETS ((1), (user_id), (event_type))"),
    "agg_distinct_by_first": (lambda s, d: S.first_by(T(s, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"]), "SELECT arg_min(event_id, event_id) AS event_id, user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "agg_frequencies": (lambda s, d: S.frequencies(T(s, d, "documents"), "lang"), "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "agg_collect_by_key": (lambda s, d: T(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), ",").alias("names")), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1"),
    "agg_partition_split": (lambda s, d: S.split(T(s, d, "orders"), F.col("o_totalprice") > 100000)[0].agg(F.count("*").alias("n"), F.lit("yes").alias("side")).union(S.split(T(s, d, "orders"), F.col("o_totalprice") > 100000)[1].agg(F.count("*"), F.lit("no"))), "SELECT count(*) AS n, 'yes' AS side FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT count(*), 'no' FROM orders WHERE NOT o_totalprice > 100000"),
    "agg_compact": (lambda s, d: T(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("user_id", "event_type", "day").agg(F.min_by("event_id", "ts").alias("first_id"), F.count("*").alias("n"), F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("from_ms"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("to_ms")), f"SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, arg_min(event_id, ts) AS first_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS from_ms, epoch_us(max(ts)) // 1000 AS to_ms FROM events GROUP BY 1, 2, 3"),
    "agg_nearest_rank_p95": (lambda s, d: T(s, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v")).select("event_type", F.element_at("v", (F.floor(F.size("v") * 0.95) + 1).cast("int")).alias("p95")), "SELECT event_type, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1"),
    "agg_by_month": (lambda s, d: T(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "sort_stable": (lambda s, d: T(s, d, "nation").orderBy(F.desc("n_regionkey"), "n_nationkey").select("n_nationkey"), "SELECT n_nationkey FROM nation ORDER BY n_regionkey DESC, n_nationkey"),
    "take_skip": (lambda s, d: T(s, d, "orders").orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100"),
    "chunked": (lambda s, d: S.chunks(T(s, d, "supplier").select("s_suppkey"), ["s_suppkey"], 7, "s_suppkey").select("batch", "n", F.array_join("items", ",").alias("items")), "SELECT CAST(i // 7 AS BIGINT) AS batch, count(*) AS n, string_agg(s_suppkey, ',' ORDER BY s_suppkey) AS items FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) GROUP BY 1"),
    "top_k": (lambda s, d: S.top_by(T(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", ["l_partkey"], 20), "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20"),
    "top_k_per_key": (lambda s, d: S.top_per_key(T(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", ["s_suppkey"], 3), "SELECT s_suppkey, s_nationkey, s_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3"),
    "set_union": (lambda s, d: S.union_distinct(T(s, d, "supplier").select(F.col("s_nationkey").alias("k")), T(s, d, "customer").select(F.col("c_nationkey").alias("k"))), "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer"),
    "set_intersection": (lambda s, d: S.intersection(T(s, d, "lineitem").select(F.col("l_partkey").alias("k")), T(s, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("k")), ["k"]).groupBy("k").agg(F.count("*").alias("n")), "SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY 1"),
    "set_difference": (lambda s, d: S.difference(T(s, d, "customer").select(F.col("c_custkey").alias("k")), T(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"]), "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "set_compare_versions": (lambda s, d: S.compare_versions(T(s, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_acctbal"), T(s, d, "customer").where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal")), "c_custkey"), "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'modified' END AS change FROM customer WHERE (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) OR (c_custkey % 5 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 11 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_acctbal <> 0)"),
    "set_apply_versions": (lambda s, d: S.apply_versions(T(s, d, "nation").where("n_nationkey < 15"), T(s, d, "nation").where("n_nationkey > 5").withColumn("n_name", F.upper("n_name")), "n_nationkey").select("n_nationkey", "n_name"), "SELECT n_nationkey, upper(n_name) AS n_name FROM nation WHERE n_nationkey > 5"),
    "sample_seeded": (lambda s, d: S.sample_rows(T(s, d, "customer").select("c_custkey"), ["c_custkey"], 40), None),
    "set_or_set_merge": (lambda s, d: T(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("element")).agg(F.count_distinct(F.struct("l_orderkey", "l_linenumber")).alias("tags")), "SELECT l_suppkey AS element, count(DISTINCT (l_orderkey, l_linenumber)) AS tags FROM lineitem GROUP BY 1"),
}
