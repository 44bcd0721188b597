"""Secret scans: what the field finds beyond a pattern match is kept."""

from __future__ import annotations

from lattica.llm import secret_crf


def test_spans_that_reach_beyond_the_patterns_are_kept(spark, monkeypatch):
    text = 'set password = "abcdef!Gh7kQ2mN9" and token = "abcdef123456"'
    ends = [(text.index("abcdef!"), text.index('" and')), (text.index("abcdef1"), len(text) - 1)]
    monkeypatch.setattr(secret_crf, "crf_spans", lambda *_: [("crf", a, b) for a, b in ends])
    base = secret_crf.base_spans(text)
    assert [text[a:b] for _, a, b in base] == ['password = "abcdef', 'token = "abcdef123456']
    kept = [s for s in secret_crf.crf_spans(None, None, text, b"") if secret_crf.adds(s, base)]
    assert [text[a:b] for _, a, b in kept] == ["abcdef!Gh7kQ2mN9"]
    assert secret_crf.redacted(text, [s[1:] for s in base + kept]) == 'set [SECRET]" and [SECRET]"'
    assert not secret_crf.adds(("crf", 2, 9), [("assign", 0, 5), ("hex", 4, 9)]) and secret_crf.adds(("crf", 2, 9), [("assign", 0, 5), ("hex", 6, 9)])


def test_the_operator_redacts_whole_tokens(spark):
    model = secret_crf.fit_field(secret_crf.made_phrases(500, seed=1))
    draw = secret_crf.made_phrases(60, seed=8)
    texts = [b" ".join(words).decode() + ' password = "abcdef!Gh7kQ2mN9xR4tY8uW3zP6"' for words, _, _ in draw]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_crf.find_secrets(docs, model, redact=True).select("row.text", "spans", "redacted").collect()
    for r in rows:
        base = secret_crf.base_spans(r["text"])
        expected = base + [s for s in secret_crf.crf_spans(model, secret_crf._Words(model), r["text"], r["text"].encode()) if secret_crf.adds(s, base)]
        assert sorted(tuple(s) for s in r["spans"]) == sorted(expected)
    assert any(r["redacted"].endswith('[SECRET]"') for r in rows)
