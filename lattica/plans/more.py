"""Further graph measures and step-by-step functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import filters as X
from lattica.functions import sequential as Q
from lattica.functions.text import tokens, word_tokens
from lattica.operators import more_graph as M
from lattica.operators.dataflow import Flow
from lattica.operators.graph_algorithms import random_walks
from lattica.plans.graphs import _G, _N, _U, _r, _rounds, trade
from lattica.session import cut
from lattica.session import table as T

QUERIES = {
    "graph_dyad_census": (lambda s, d: M.dyad_census(trade(s, d)), f"WITH {_G}, {_N}, p AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(DISTINCT source) AS k FROM g GROUP BY 1, 2), c AS (SELECT count(*) AS v FROM n) SELECT count(*) FILTER (k = 2) AS mutual, count(*) FILTER (k = 1) AS asymmetric, CAST(v * (v - 1) // 2 - count(*) AS BIGINT) AS none FROM p, c GROUP BY v"),
    "graph_triad_census": (lambda s, d: M.triad_census(trade(s, d)), f"WITH {_G}, {_N}, p AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(DISTINCT source) AS k FROM g GROUP BY 1, 2), t AS (SELECT x.id AS i, y.id AS j, z.id AS k FROM n x, n y, n z WHERE x.id < y.id AND y.id < z.id), r AS (SELECT i, j, t.k AS l, coalesce(p.k, 0) AS p, coalesce(q.k, 0) AS q, coalesce(w.k, 0) AS w FROM t LEFT JOIN p ON p.a = i AND p.b = j LEFT JOIN p q ON q.a = i AND q.b = t.k LEFT JOIN p w ON w.a = j AND w.b = t.k) SELECT CAST((p > 0)::INT + (q > 0)::INT + (w > 0)::INT AS BIGINT) AS sides, CAST(p + q + w AS BIGINT) AS links, CAST((p = 2)::INT + (q = 2)::INT + (w = 2)::INT AS BIGINT) AS mutual, count(*) AS n FROM r WHERE (p > 0)::INT + (q > 0)::INT + (w > 0)::INT >= 2 GROUP BY 1, 2, 3"),
    "graph_stationary": (lambda s, d: _r(M.stationary(trade(s, d), 8)), f"WITH {_G}, {_N}, l AS (SELECT source AS u, target AS v FROM g UNION SELECT target, source FROM g), o AS (SELECT u, count(*) AS d FROM l GROUP BY 1), " + _rounds(8, "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS x FROM n", "SELECT n.id, coalesce(sum(p.x / o.d), 0) AS x FROM n LEFT JOIN l ON l.v = n.id LEFT JOIN o ON o.u = l.u LEFT JOIN {p} p ON p.id = l.u GROUP BY 1") + " SELECT id, round(x, 6) AS share FROM r8"),
    "graph_hitting_time": (lambda s, d: _r(M.hitting_time(cut(random_walks(trade(s, d), 8, 4)), 7)), None),
    "graph_link_auc": (lambda s, d: M.link_auc(trade(s, d).where("weight < 3"), "common", trade(s, d).where("weight = 3"), per_edge=4), None),
    "graph_bisect": (lambda s, d: M.bisect(trade(s, d)).groupBy("part").agg(F.count("*").alias("n")), None),
    "graph_biased_walks": (lambda s, d: M.biased_walks(trade(s, d), 5, 2, 0.5, 2.0), None),
    "text_stems": (lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(F.pandas_udf(Q.stems, "array<string>")(word_tokens("p_type")), " ").alias("stems")), None),
    "text_textrank": (lambda s, d: Q.textrank_keywords(T(s, d, "documents").select("doc_id", tokens("text").alias("w")), "doc_id", "w", 5), None),
    "text_line_diff": (lambda s, d: Q.diff_lines(T(s, d, "nation").select("n_nationkey", F.concat(F.lit("a\nb\n"), "n_name").alias("x"), F.concat(F.lit("a\nc\n"), "n_name", F.lit("\nd")).alias("y")), "n_nationkey", "x", "y").groupBy("n_nationkey", "op").agg(F.count("*").alias("n")), "SELECT n_nationkey, op, CAST(n AS BIGINT) AS n FROM nation, (VALUES ('equal', 2), ('delete', 1), ('insert', 2)) v(op, n)"),
    "fn_cron": (lambda s, d: Q.schedule(T(s, d, "nation").select("n_nationkey", F.lit("30 6 * * 1-5").alias("e"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).cast("timestamp").alias("t")), "n_nationkey", "e", "t", 2).select("n_nationkey", "ord", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at")), "SELECT n_nationkey, CAST(o AS BIGINT) AS ord, strftime(list_filter(list_transform(range(0, 6), lambda i: DATE '2024-01-01' + CAST(n_nationkey + i AS INTEGER)), lambda x: dayofweek(x) NOT IN (0, 6))[o + 1], '%Y-%m-%d') || ' 06:30' AS at FROM nation, (SELECT unnest([0, 1]) AS o)"),
    "crdt_text": (lambda s, d: Q.merge_texts(T(s, d, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").cast("long").alias("id"), F.lit(None).cast("long").alias("after"), F.substring("n_name", 1, 1).alias("char"), (F.col("n_nationkey") == 3).alias("deleted")), "doc"), "SELECT n_regionkey AS doc, coalesce(string_agg(n_name[1], '' ORDER BY n_nationkey DESC) FILTER (n_nationkey <> 3), '') AS text FROM nation GROUP BY 1"),
    "graph_top_similar": (lambda s, d: _r(M.top_similar(trade(s, d), "jaccard", 3)).select("id", "other", "score"), f"WITH {_G}, {_U}, p AS (SELECT x.v AS id, y.v AS other, count(*) / (p.d + q.d - count(*)) AS j FROM b x JOIN b y ON x.u = y.u AND x.v <> y.v JOIN dg p ON p.id = x.v JOIN dg q ON q.id = y.v GROUP BY x.v, y.v, p.d, q.d) SELECT id, other, round(j, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY j DESC, other) <= 3"),
    "graph_sampled_paths": (lambda s, d: _r(M.sampled_paths(trade(s, d)), 9), f"WITH RECURSIVE {_G}, {_N}, f AS (SELECT source, target FROM g UNION SELECT target, source FROM g), w AS (SELECT id AS s, id, 0 AS depth FROM n UNION SELECT w.s, f.target, w.depth + 1 FROM w JOIN f ON f.source = w.id WHERE w.depth < 25), m AS (SELECT s, id, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT round(avg(depth), 9) AS mean_path, max(depth) AS diameter, count(*) AS pairs FROM m WHERE depth > 0"),
    "flow_running": (lambda s, d: Flow(T(s, d, "orders").select("o_orderkey", "o_custkey"), ("o_orderkey",)).running("total", "o_custkey").running("most", "o_custkey", "max").running("n", "o_custkey", "count").df.drop("o_custkey"), "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS total, max(o_custkey) OVER w AS most, count(o_custkey) OVER w AS n FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"),
    "fn_template_text": (lambda s, d: T(s, d, "part").select("p_partkey", X.render("{{ name | upper | truncate(12) }}/{{ type | capitalize | replace('plated', 'P|') }}/{{ name | slugify | reverse }}/{{ name | wordcount }}/{{ none | default('-') }}", {"name": F.col("p_name"), "type": F.col("p_type"), "none": F.lit(None).cast("string")}).alias("t")), r"SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN upper(p_name) ELSE upper(p_name)[:9] || '...' END || '/' || replace(upper(p_type[1]) || lower(p_type[2:]), 'plated', 'P|') || '/' || reverse(regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name)), '[^\w\s-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')) || '/' || len(list_filter(regexp_split_to_array(p_name, '\s+'), lambda x: x <> '')) || '/-' AS t FROM part"),
    "fn_template_html": (lambda s, d: T(s, d, "pages").select("page_id", F.md5(X.FILTERS["escape"](F.col("html"))).alias("escaped"), (X.FILTERS["unescape"](X.FILTERS["escape"](F.col("url"))) == F.col("url")).alias("back"), F.md5(X.FILTERS["striptags"](F.col("html"))).alias("plain")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS escaped, url = url AS back, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain FROM pages"),
    "fn_template_numbers": (lambda s, d: T(s, d, "supplier").select("s_suppkey", X.rounded(F.col("s_acctbal"), 1).alias("r"), X.FILTERS["ceil"](F.col("s_acctbal")).alias("c"), X.FILTERS["join"](X.FILTERS["sort"](F.array("s_suppkey", "s_nationkey")), "+").alias("j")), "SELECT s_suppkey, floor(s_acctbal::DOUBLE * 10 + 0.5) / 10 AS r, CAST(ceil(s_acctbal) AS BIGINT) AS c, least(s_suppkey::VARCHAR, s_nationkey::VARCHAR) || '+' || greatest(s_suppkey::VARCHAR, s_nationkey::VARCHAR) AS j FROM supplier"),
}
