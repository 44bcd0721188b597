"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import chat_format, decontaminate, lang_nb, license_scan, ngram_lm, quality_gbt, secret_crf, sp_tokenizer, url_trust
from lattica.llm.jaccard_join import jaccard_components
from lattica.session import table

#: The tokenizer model; its place is a parameter of the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_pages(table(spark, sf_dir, "pages")).select("row.page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_crf.find_secrets(docs, secret_crf.fit_secrets(docs), columns=["doc_id", "text"])
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("row.doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(secret_crf.spelled(base), 256).alias("base_sha256"), secret_crf.spelled(F.col("spans")).alias("spans"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), columns=["doc_id", "text"])
    return found.select("row.doc_id", F.size("licenses").cast("long").alias("n_licenses"), "licenses")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality_gbt.judge_quality(docs, quality_gbt.fit_quality(docs, table(spark, sf_dir, "labels")), columns=["doc_id", "text"])
    return judged.select("row.doc_id", *quality_gbt.BASE, "base_failed", "kept", "quality")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sp_tokenizer.encode_texts(table(spark, sf_dir, "documents"), MODEL_PATH, columns=["doc_id", "text"])
    return encoded.select("row.doc_id", "n_tokens", "n_bytes", "ids_sha256", "exact")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_nb.fit_languages(docs.where(~held_out("doc_id", 3, 1)))
    predicted = lang_nb.predict_languages(docs, model, columns=["doc_id", "text"])
    return predicted.select("row.doc_id", held_out("row.doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def held_out(id_column: str, parts: int, held: int):
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % parts == held, F.lit(False))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema)
    return chat_format.format_conversations(rows.union(own))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id", "text"])
    return scanned.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_secret_scans": op3_secret_scans,
    "op4_license_scans": op4_license_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_ESCAPED = "(length({0}) + length({0}) - length(replace({0}, '\\', '')) + " + " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROL) + ")"
_SPACED = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rank_sql(name: str, seeds: str, links: str, rounds: int = 15) -> str:
    """CTEs of a personalised PageRank: ``name`` has (host, score)."""
    out = [f"{name}s AS (SELECT host, n / sum(n) OVER () AS seed FROM {seeds})", f"{name}e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS d FROM {links})", f"{name}h AS (SELECT host, sum(seed) AS seed FROM (SELECT host, seed FROM {name}s UNION ALL SELECT dst, 0 FROM {name}e WHERE EXISTS (SELECT 1 FROM {name}s)) GROUP BY 1)", f"{name}0 AS (SELECT host, seed AS score FROM {name}h)"]
    for i in range(1, rounds + 1):
        out.append(f"{name}m{i} AS MATERIALIZED (SELECT dst, sum(score / d) AS got FROM {name}e JOIN {name}{i - 1} ON host = src GROUP BY 1)")
        out.append(f"{name}{i} AS MATERIALIZED (SELECT host, 0.85 * coalesce(got, 0) + (1 - 0.85 * coalesce((SELECT sum(got) FROM {name}m{i}), 0)) * seed AS score FROM {name}h LEFT JOIN {name}m{i} ON dst = host)")
    return ", ".join([*out, f"{name} AS (SELECT * FROM {name}{rounds})"])


_FITS = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(url_trust.RULES, key=lambda x: -len(x[1])))
_VERDICTS = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in url_trust.RULES)
_HREFS = r"""regexp_extract_all(html, '\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1, 'si')"""
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS id, a AS m FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.m)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(m) FROM r WHERE r.id = d.doc_id), d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id)""",
    "op2_url_filters": f"""
        WITH p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN {_LOWER_SQL.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")} ELSE '' END AS host,
                   CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
        f AS (SELECT page_id, host, path, CASE {_FITS} END AS rule FROM p),
        l AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {_LOWER_SQL.format("unnest(" + _HREFS + ")")} AS dst FROM p) WHERE src <> '' AND dst <> '' AND src <> dst),
        k AS (SELECT src AS host FROM l UNION SELECT dst FROM l UNION SELECT host FROM p WHERE host <> ''),
        v AS (SELECT host, CASE rule {_VERDICTS} END AS verdict, CAST(count(*) AS DOUBLE) AS n FROM f WHERE rule IS NOT NULL GROUP BY 1, 2),
        va AS (SELECT * FROM v WHERE verdict = 'allow'), vb AS (SELECT * FROM v WHERE verdict = 'block'), lb AS (SELECT dst AS src, src AS dst FROM l),
        {_rank_sql("good", "va", "l")}, {_rank_sql("bad", "vb", "lb")},
        h AS (SELECT host, coalesce(g.score, 0) AS trust, coalesce(b.score, 0) AS distrust FROM good g FULL JOIN bad b USING (host)),
        j AS (SELECT f.*, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM f LEFT JOIN h USING (host))
        SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE rule {_VERDICTS} END
               WHEN distrust > 0.5 * (trust + distrust) AND distrust > 1 / greatest((SELECT count(*) FROM k), 1) THEN 'block' ELSE 'allow' END AS verdict,
               CAST(round(trust, 9) AS DOUBLE) AS trust, CAST(round(distrust, 9) AS DOUBLE) AS distrust FROM j""",
    "op9_chat_formatting": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(22 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewrites
        FROM t GROUP BY conv_id""",
    "op10_benchmark_decontamination": f"""
        WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t
                FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) WHERE len(w) > 0),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        g AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t
              FROM d, (SELECT DISTINCT k FROM win), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
        hit AS (SELECT doc_id, g.k, i, item_id FROM g JOIN win USING (k, t)),
        n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
