"""Nothing is cut off, bounds bound rows, and rows are judged one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, frame, sentence

from lattica.llm import chat_format, common, lang_nb, license_scan, quality_gbt, secret_crf, sp_tokenizer, url_trust
from lattica.llm.queries import MODEL_PATH

CHAT = "conv_id long, turn long, role string, text string"


# ---- 7: language


def test_pieces_have_every_ngram_once():
    draw = random.Random(2)
    text = "".join(draw.choice("abc é日") for _ in range(10_000))
    whole = np.sort(lang_nb.gram_buckets(text, 16))
    for size in (1, 2, 7, 4096, 9999, 10_000):
        assert (np.sort(np.concatenate(list(lang_nb.text_pieces(text, 16, size)))) == whole).all()


def test_a_long_text_is_scored_as_a_whole(spark):
    draw = random.Random(7)
    texts = [sentence(draw, 30) for _ in range(20)]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    languages, priors, matrix = model = lang_nb.fit_languages(docs)
    text = " ".join(texts * 400)
    assert len(text) > 2 * lang_nb.PIECE
    sums = priors + matrix[lang_nb.gram_buckets(text, 16)].sum(axis=0)
    got = lang_nb.predict_languages(frame(spark, [text]), model).first()
    assert got["lang_pred"] == languages[int(np.argmax(sums))]
    assert got["score"] == pytest.approx(1 / np.exp(sums - sums.max()).sum(), rel=1e-6)


def test_too_many_languages_are_an_error(spark):
    docs = frame(spark, ["a b"] * 9).withColumn("lang", F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="languages"):
        lang_nb.fit_languages(docs, most_languages=8)


# ---- fits


def test_samples_bound_rows(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(i, "x") for i in range(2, 40)] + [(None, "n")], "id long, text string")
    got = common.bounded_sample(docs, "id", 30).collect()
    assert len(got) == 30 == len({r["id"] for r in got}) and None not in {r["id"] for r in got}
    assert sorted(got) == sorted(common.bounded_sample(docs.repartition(5), "id", 30).collect())


# ---- 9: chat


def digest_rows(spark, turns, template, read=None):
    rows = spark.createDataFrame([(4, i, t["role"], t["text"]) for i, t in enumerate(turns)], CHAT)
    made = chat_format.format_turns(rows, template).collect()
    return made, chat_format.format_conversations(rows, template, read=read).first()


def test_any_template_is_a_black_box(spark):
    draw = random.Random(3)
    template = lambda ts: "# chat\n" + "".join(f"<{t['role']}#{i}>{t['text']}</{t['role']}>\n" for i, t in enumerate(ts))
    turns = [{"role": "assistant" if i % 2 else "user", "text": draw.choice(["", "a", "</assistant>", "<user#0>", "é", sentence(draw, 5)])} for i in range(100)]
    made, row = digest_rows(spark, turns, template)
    whole = template(turns)
    assert "".join(r["piece"] for r in made) == whole and row["formatted_chars"] == len(whole) and row["rewrites"] == 0
    assert [whole[r["text_start"] : r["text_end"]] for r in made if r["place"] >= 0] == [t["text"] for t in turns]
    assert [r["trained"] for r in made if r["place"] >= 0] == [t["role"] == "assistant" for t in turns]
    assert row["loss_chars"] == sum(len(t["text"]) for t in turns if t["role"] == "assistant")


def test_rewritten_history_is_reported_and_masked_where_it_is_left(spark):
    template = lambda ts: "".join(f"[{t['text'] if t['role'] == 'user' or i == len(ts) - 1 else '...'}]" for i, t in enumerate(ts))
    turns = [{"role": "assistant" if i % 2 else "user", "text": f"t{i}"} for i in range(6)]
    made, row = digest_rows(spark, turns, template)
    assert [r["place"] for r in made if r["rewrites"]] == [2, 4] and row["rewrites"] == 2
    assert [r["text_start"] is None for r in made] == [False, True, False, True, False, False]
    whole = template(turns)
    assert [whole[r["text_start"] : r["text_end"]] for r in made if r["trained"]] == ["t5"]


def test_the_incremental_form_equals_whole_prefixes(spark):
    turns = [{"role": "assistant" if i % 3 else "user", "text": "</s> [INST] \\ x" * (i % 5)} for i in range(130)]
    fast, slow = digest_rows(spark, turns, chat_format.BUILT_IN), digest_rows(spark, turns, chat_format.Template(chat_format.render, None, chat_format.unescape))
    assert fast == slow
    with pytest.raises(ValueError, match="incremental"):
        chat_format.Template(lambda ts: f"{len(ts)}", lambda k, t: "x").verify()


# ---- 6: tokenizer


def test_ids_decode_as_rows(spark):
    texts = [*ODD, "two  spaces é 日本 🙂"]
    encoded = sp_tokenizer.encode_texts(frame(spark, texts), MODEL_PATH, with_ids=True).select("row.doc_id", "ids", F.lit("clash").alias("decoded"))
    got = {r[0]: r[1] for r in sp_tokenizer.decode_ids(encoded, MODEL_PATH).select("row.doc_id", "decoded").collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    none = sp_tokenizer.decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), MODEL_PATH).select("row.doc_id", "decoded").collect()
    assert [tuple(r) for r in none] == [(1, None), (2, "")]


# ---- empty tables, clashing names


def test_empty_tables_and_clashing_names(spark):
    docs = frame(spark, ["plain words here", None])
    clash = docs.select("*", *(F.lit("clash").alias(c) for c in ("row", "spans", "licenses", "kept", "n_words", "ids", "exact", "lang_pred", "score")))
    model = lang_nb.fit_languages(docs)
    for run in (lambda d: secret_crf.find_secrets(d, secret_crf.Field(np.zeros((secret_crf.BUCKETS, 3)), np.zeros((3, 3)), frozenset())), license_scan.scan_licenses, lambda d: quality_gbt.judge_quality(d, quality_gbt.Trees(0.0)), lambda d: sp_tokenizer.encode_texts(d, MODEL_PATH), lambda d: lang_nb.predict_languages(d, model)):
        assert run(clash.limit(0)).count() == 0
        got = run(clash).select("row.row", "row.doc_id").orderBy("doc_id").collect()
        assert [tuple(r) for r in got] == [("clash", 0), ("clash", 1)]


def test_a_ruled_host_without_links_is_judged_by_its_own_distrust(spark):
    pages = [(1, "http://a.org/es/x", ""), (2, "http://a.org/other", ""), (3, "http://b.io/", ""), (4, "http://c.io/", "")]
    got = {r[0]: r[1] for r in url_trust.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).select("row.page_id", "verdict").collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


# ---- pipeline


def test_near_copies_are_judged_row_by_row(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(9)
    a, b, c = (sentence(draw, 60) for _ in range(3))
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, b + " end", "x"), (3, c, "x"), (3, c, "x"), (None, c, "x"), (None, sentence(draw, 60), "x"), (4, "", "x"), (5, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("key", F.lit(1)).withColumn("h", F.lit(2))
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got if r["text"] not in (rows[7][1],)) == sorted([(1, a), (1, b), (3, c), (4, ""), (5, "")])
    assert sum(r["doc_id"] is None for r in got) == 1
    assert corpus_pipeline.near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0
