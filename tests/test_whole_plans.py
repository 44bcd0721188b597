"""Queries without SQL read whole tables and whole texts."""

from __future__ import annotations

import pytest

import __spark_entry__
from lattica.session import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, source", [("text_lcs", "part"), ("text_word_cosine", "part"), ("dedup_fuzzy", "part"), ("text_sentences", "documents")])
def test_a_row_for_every_row(spark, name, source):
    assert __spark_entry__.queries()[name](spark, SF).count() == table(spark, SF, source).count()


def test_long_texts_and_late_documents_are_read(spark):
    run = lambda name: __spark_entry__.queries()[name](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert sum(r["n"] for r in run("text_language")) == len(docs)
    assert any(len(docs[r["doc_id"]]) >= 1500 for r in run("search_highlights"))
    worded = {i for i, t in docs.items() if any(c.isalnum() for c in t)}
    assert {r["doc_id"] for r in run("document_chunks")} >= worded
    assert {r["doc"] for r in run("text_summary")} >= worded
    assert max(r["doc"] for r in run("text_rake")) >= 60
