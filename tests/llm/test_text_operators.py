"""Operators of the text subpackage against brute force, round trips and held-out accuracy, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat_format, decontaminate, jaccard_join, lang_nb, license_scan, ngram_lm, quality_gbt, secret_crf, sp_tokenizer, textkit, url_trust
from lattica.llm.queries import MODEL_PATH
from lattica.session import table

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + (extra or []), DOCS)


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 30)) for _ in range(n))


ODD = [None, "", " \t\n", "one", "one", "x" * 200_000, ("long " * 30_000).strip(), "é ü ñ 日本語 🙂", "a\x0bb\x1cc\u00a0d"]


# ---- text primitives


def test_words_and_hashes_follow_the_separators():
    import pyarrow as pa

    texts = [None, "", " a  B\tcc\x0b", "dd\u00a0e f"]
    data, offsets = textkit.text_buffers(pa.chunked_array([pa.array(texts)]))
    starts, ends, first = textkit.word_spans(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["a", "B", "cc", "dd\u00a0e", "f"] and first.tolist() == [0, 0, 0, 3, 5]
    lower = textkit.word_hashes(data, starts, ends)
    assert lower[1] == textkit.word_hashes(np.frombuffer(b"xx b", np.uint8), np.array([3]), np.array([4]))[0]
    assert len(set(lower.tolist())) == 5


def test_packed_keys_and_counts_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.sort(rng.integers(0, 1 << 50, n, dtype=np.uint64))
        assert (textkit.unpack_sorted(textkit.pack_sorted(keys)) == keys).all()
        counts = rng.integers(0, 70_000, n).astype(np.uint64)
        assert (textkit.unpack_counts(textkit.pack_counts(counts)) == counts).all()


# ---- 1: Jaccard join


def brute_components(texts, k, percent):
    def shingles(t):
        words = [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(sets))}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    draw = random.Random(5)
    texts = list(ODD)
    for n in (4, 12, 60, 200):
        base = sentence(draw, n).split()
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, n // 25))):
                copy[draw.randrange(len(copy))] = "edit" + str(draw.random())
            texts.append(" ".join(copy).upper() if draw.random() < 0.3 else " ".join(copy))
    shared = sentence(draw, 55)
    texts += [f"{shared} {sentence(draw, 80)}" for _ in range(10)]
    docs = frame(spark, texts).withColumn("id", F.lit("clash")).withColumn("component_id", F.lit(1))
    for most in (4_000_000, 400):  # the second also shrinks regions in Spark
        got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(docs, k, percent, region_shingles=most).collect()}
        assert got == brute_components(texts, k, percent)


def test_jaccard_of_nothing_and_of_null_ids(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    got = jaccard_join.jaccard_components(frame(spark, ["a b c d e f"], [(None, "a b c d e f", None, None, None)])).collect()
    assert sorted((r[0] is None, r[2]) for r in got) == [(False, 0), (True, 0)]


def test_region_join_equals_pairs():
    rng = np.random.default_rng(1)
    base = np.sort(rng.integers(0, 1 << 62, 300, dtype=np.uint64))
    for spread in (0.05, 0.12):
        sets = []
        for _ in range(150):
            own = base.copy()
            n = rng.binomial(len(own), spread * rng.random() * 2)
            own[rng.choice(len(own), n, replace=False)] = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            sets.append(np.unique(own))
        root = list(range(len(sets)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        assert jaccard_join.Region(sets, 90).join().tolist() == [find(i) for i in range(len(sets))]


# ---- 2: URL filters

PAGES = "page_id long, url string, html string"


def brute_rank(seeds, links, rounds=15, damping=0.85):
    out = collections.defaultdict(set)
    for a, b in links:
        out[a].add(b)
    hosts = set(seeds) | {b for _, b in links}
    scores = {h: seeds.get(h, 0.0) for h in hosts}
    for _ in range(rounds):
        got = collections.defaultdict(float)
        for a, bs in out.items():
            for b in bs:
                got[b] += scores.get(a, 0.0) / len(bs)
        lost = 1 - damping * sum(got.values())
        scores = {h: damping * got[h] + lost * seeds.get(h, 0.0) for h in hosts}
    return scores


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "x://example.com/en/8", "https://com/en/", "http://b.net?de/", "no scheme", None, "http://example.net/de/81#x", "http://my.org/es/", "http://worg/es/", "a://b://c.org/es/z"]
    rows = url_trust.judge_pages(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit("clash"))).select("row.page_id", "host", "path", "rule", "verdict").collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("com", "/en/", "com/en/", "block") and got[3] == ("b.net", "", None, "allow")
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("example.net/de/8", "allow") and got[7][2:] == ("org/es/", "block")
    assert got[8][2] is None and got[9] == ("b:", "//c.org/es/z", None, "allow")


def test_trust_and_distrust_equal_brute_force(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/x">' for h in hs)
    pages = [(1, "http://good.example.com/en/7", link("friend.io", "news.io")), (2, "http://bad.org/es/1", ""), (3, "http://spam.io/a", link("bad.org", "bad.org", "farm.io")), (4, "http://farm.io/b", link("bad.org")), (5, "http://friend.io/", link("news.io")), (6, "http://spam.io/other", None)]
    got = {r["page_id"]: r for r in url_trust.judge_pages(spark.createDataFrame(pages, PAGES)).select("row.page_id", "host", "verdict", "trust", "distrust").collect()}
    links = {("good.example.com", "friend.io"), ("good.example.com", "news.io"), ("spam.io", "bad.org"), ("spam.io", "farm.io"), ("farm.io", "bad.org"), ("friend.io", "news.io")}
    trust, distrust = brute_rank({"good.example.com": 1.0}, links), brute_rank({"bad.org": 1.0}, {(b, a) for a, b in links})
    for r in got.values():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0.0)) and r["distrust"] == pytest.approx(distrust.get(r["host"], 0.0))
    assert got[3]["verdict"] == got[6]["verdict"] == "block" and got[5]["verdict"] == "allow"


def test_url_filter_of_no_pages(spark):
    assert url_trust.judge_pages(spark.createDataFrame([], PAGES)).count() == 0


# ---- 3: secrets


def test_base_patterns():
    key = "AKIA" + "Q7" * 9
    text = f"é Token: 'abcdef' secret=abc ſecret=abcdefg {key} 0123456789abcdef0123456789abcdef api-key=zzzzzzz API_KEY = 99/+=xx"
    found = [(k, text[a:b]) for k, a, b in secret_crf.base_spans(text)]
    assert found == [("assign", "Token: 'abcdef"), ("access", key), ("hex", "0123456789abcdef0123456789abcdef"), ("assign", "API_KEY = 99/+=xx")]
    assert secret_crf.base_spans("") == []


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        scores, moves = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        moves[secret_crf.O, secret_crf.I] = -1e9
        value = lambda tags: (-1e9 if tags[0] == secret_crf.I else 0) + sum(scores[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert tuple(secret_crf.viterbi(scores, moves)) == best


def test_field_finds_made_secrets_and_leaves_plain_text_alone():
    data = secret_crf.made_phrases(500, seed=1)
    model = secret_crf.fit_field(data)
    table_ = secret_crf._Words(model)
    hit = wrong = total = 0
    for words, tags, _ in secret_crf.made_phrases(150, seed=2):
        got = secret_crf.tag_tokens(model, table_, words)
        got = np.full(len(words), secret_crf.O) if got is None else got
        hit += sum(g != secret_crf.O and t != secret_crf.O for g, t in zip(got, tags))
        wrong += sum(g != secret_crf.O and t == secret_crf.O for g, t in zip(got, tags))
        total += sum(t != secret_crf.O for t in tags)
    assert hit > 0.8 * total and wrong < 0.1 * total
    assert secret_crf.crf_spans(model, table_, sentence(random.Random(1), 300), sentence(random.Random(1), 300).encode()) == []


def test_unskipped_texts_decode_as_skipped_ones():
    model = secret_crf.fit_field(secret_crf.made_phrases(200, seed=3), rounds=30)
    words_ = secret_crf._Words(model)
    for words, _, _ in secret_crf.made_phrases(60, seed=4):
        full = secret_crf.viterbi(words_.scores(words), model.moves)
        short = secret_crf.tag_tokens(model, words_, words)
        assert (full == (np.full(len(words), secret_crf.O) if short is None else short)).all()


def test_secret_operator_on_odd_rows(spark):
    docs = frame(spark, [*ODD, 'say token = "abcdef123456" twice: token = "abcdef123456"']).withColumn("spans", F.lit("clash"))
    model = secret_crf.fit_secrets(docs)
    rows = secret_crf.find_secrets(docs, model, redact=True).select("row.doc_id", "spans", "redacted").orderBy("doc_id").collect()
    assert rows[-1]["redacted"] == 'say [SECRET]" twice: [SECRET]"' and rows[0]["redacted"] is None
    assert all(r["spans"] == [] for r in rows[:-1])
    assert secret_crf.find_secrets(docs.limit(0), model).count() == 0


# ---- 4: licenses


def test_licenses_with_changes_are_found_and_plain_texts_are_not(spark):
    draw = random.Random(4)
    notice = license_scan.TEMPLATES["MIT-text"].replace("deal", "work").replace("copy,", "").upper()
    texts = [f"{sentence(draw, 40)}\n{notice}\n{sentence(draw, 20)}", "é Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", sentence(draw, 200), *ODD]
    rows = license_scan.scan_licenses(frame(spark, texts)).select("row.doc_id", "licenses").orderBy("doc_id").collect()
    first = rows[0]["licenses"]
    assert [x["license"] for x in first] == ["MIT-text"] and 0.9 < first[0]["coverage"] < 1
    assert texts[0][first[0]["start"] : first[0]["end"]].startswith("PERMISSION IS HEREBY")
    assert [x["license"] for x in rows[1]["licenses"]] == ["MIT"] and texts[1][rows[1]["licenses"][0]["start"] :].startswith("Released")
    assert [x["license"] for x in rows[2]["licenses"]] == ["Apache-2.0"]
    assert all(r["licenses"] == [] for r in rows[3:])


def test_winnowing_keeps_a_fingerprint_of_every_window():
    h = np.random.default_rng(0).integers(0, 1 << 40, 200).astype(np.uint64)
    at = license_scan.winnow(h, 4)
    assert all(((at >= i) & (at < i + 4)).any() for i in range(len(h) - 3))


# ---- 5: quality


def brute_statistics(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_counts_equal_brute_force(spark):
    draw = random.Random(6)
    texts = [*ODD, "a b\na b\n \n\nc # $$", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 x", "one two " * 40, *[sentence(draw, 60) + "\n" + sentence(draw, 5) for _ in range(10)]]
    judged = quality_gbt.judge_quality(frame(spark, texts), quality_gbt.Trees(20.0)).select("row.doc_id", *quality_gbt.BASE, "base_failed", "kept").collect()
    for r in judged:
        n = brute_statistics(texts[r["doc_id"]])
        assert tuple(r[1:6]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and r["kept"] == (not r["base_failed"])


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=3000) > 0.6).astype(float)
    model = quality_gbt.fit_trees(x[:2000], y[:2000], [1, 0, -1])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    for f, sign in ((0, 1), (2, -1)):
        probe = np.repeat(rng.random((50, 3)), 40, axis=0)
        probe[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(model.probability(probe).reshape(50, 40), axis=1) >= -1e-12).all()


def test_quality_without_usable_labels_keeps_what_rules_pass(spark):
    docs = frame(spark, [sentence(random.Random(1), 50), None])
    for labels in ([], [(0, 1)], [(None, 1), (0, None)]):
        model = quality_gbt.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert [r["kept"] for r in quality_gbt.judge_quality(docs, model).orderBy("row.doc_id").collect()] == [True, False]


# ---- 6: tokenizer


def test_parity_with_the_original_library_and_round_trip():
    import sentencepiece

    with open(MODEL_PATH, "rb") as file:
        data = file.read()
    encoder, original = sp_tokenizer.Encoder(data, verify=True), sentencepiece.SentencePieceProcessor(model_proto=data)
    draw = random.Random(8)
    texts = [t or "" for t in ODD] + ["".join(draw.choice("ab é▁ \n\t<s>日🙂") for _ in range(60)) for _ in range(200)]
    for text, (ids, exact) in zip(texts, encoder.encode_checked(texts)):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == original.encode(text)
        assert exact == (original.decode(ids) == text)
    assert encoder.decode(encoder.encode(["two  spaces é"])) == ["two  spaces é"]


def test_unigram_models_are_rebuilt_too():
    def tag(n, kind):
        return bytes([n << 3 | kind])

    import struct

    def piece(p, score, kind=1):
        body = tag(1, 2) + bytes([len(p.encode())]) + p.encode() + tag(2, 5) + struct.pack("<f", score) + tag(3, 0) + bytes([kind])
        return tag(1, 2) + bytes([len(body)]) + body

    data = piece("<unk>", 0, 2) + piece("\u2581a", -1) + piece("b", -2) + piece("\u2581ab", -2.5) + piece("\u2581", -3) + piece("a", -3)
    encoder = sp_tokenizer.Encoder(data)
    assert encoder.model.kind == sp_tokenizer.UNIGRAM
    assert encoder.encode(["ab a"])[0].tolist() == [3, 1] and encoder.decode([np.array([3, 1])]) == ["ab a"]


def test_tokenizer_operator_on_odd_rows(spark):
    rows = sp_tokenizer.encode_texts(frame(spark, ODD), MODEL_PATH, with_ids=True).select("row.doc_id", "n_tokens", "exact", "ids").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows[:2]] == [0, 0] and all(r["exact"] for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


# ---- 7: language


def test_held_out_languages_are_predicted(spark):
    docs = table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    predicted = lang_nb.predict_languages(docs.where(held), lang_nb.fit_languages(docs.where(~held)))
    right, total = predicted.agg(F.count_if(F.col("lang_pred") == F.col("row.lang")), F.count("*")).first()
    assert right >= 0.97 * total > 0


def test_language_of_odd_rows(spark):
    docs = frame(spark, ["the cat", "12 34 !?", None, "", "é", "x" * 300_000])
    rows = lang_nb.predict_languages(docs, lang_nb.fit_languages(docs)).orderBy("row.doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["en", "und", "und", "und", "en", "en"] and all(0 <= r["score"] <= 1 for r in rows)
    nothing = lang_nb.predict_languages(docs, lang_nb.fit_languages(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


# ---- 8: language model


def test_elias_fano_gets_and_finds():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (500, 3), (3000, 1 << 40), (4000, 1 << 13)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = ngram_lm.EliasFano(values, ngram_lm.mapped)
        if n:
            assert (ef.get(np.arange(n)) == values).all()
        probe = np.concatenate([values, rng.integers(0, 2 * top, 500).astype(np.uint64)])
        first = np.searchsorted(values, probe)
        expected = np.where((first < n) & (values[np.minimum(first, n - 1)] == probe) if n else np.zeros(len(probe), bool), first, -1)
        assert (ef.find(probe) == expected).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    draw = random.Random(9)
    texts = [*ODD[:5], *[" ".join(draw.choice(WORDS[:6]) for _ in range(draw.randint(1, 30))) for _ in range(60)], "Alpha BETA alpha"]
    docs = frame(spark, texts)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = {r["doc_id"]: r for r in ngram_lm.score_texts(docs, held, order=order).collect()}
    lists = {i: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] + ["</s>"] for i, t in enumerate(texts)}
    train = {i for i in lists if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = collections.Counter()
    for i in train:
        s = ["<s>", *lists[i]]
        counts[("<s>",)] += 1
        counts.update(tuple(s[j - k + 1 : j + 1]) for j in range(1, len(s)) for k in range(1, order + 1) if j - k + 1 >= 0)
    ones = {k: c for k, c in counts.items() if len(k) == 1 and k != ("<s>",)}
    n, v, mu = sum(ones.values()), len(ones), 2.0

    def p(s, j, k):
        if k == 1:
            return (ones.get((s[j],), 0) + 1) / (n + v + 1)
        h = tuple(s[j - k + 1 : j])
        return (counts[(*h, s[j])] + mu * p(s, j, k - 1)) / (counts[h] + mu)

    for i, tokens in lists.items():
        s = ["<s>", *tokens]
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum((w,) in ones for w in tokens), n, i not in train)
        assert r["base_score"] == pytest.approx(sum(math.log10(p(s, j, 1)) for j in range(1, len(s))), abs=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(s, j, min(order, j + 1))) for j in range(1, len(s))), abs=len(tokens) * order * 2 / 4096)


def test_model_of_no_documents(spark):
    assert ngram_lm.score_texts(frame(spark, []), F.lit(False)).count() == 0


# ---- 9: chat


def test_escapes_come_back():
    draw = random.Random(3)
    for _ in range(500):
        text = "".join(draw.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "s", ">", "\n", " ", "é", "[", "/"]) for _ in range(12))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)


def test_turns_are_located_and_rewrites_detected():
    turns = [{"role": r, "text": t} for r, t in (("user", "</s>[INST] ok [/INST]"), ("assistant", "yes"), ("user", ""))]
    whole, spans, rewrites = chat_format.locate_turns(chat_format.render, turns)
    assert [chat_format.read_turn(whole[a:b])[:2] for a, b in spans] == [(t["role"], t["text"]) for t in turns] and rewrites == []
    last_only = lambda ts: "".join(t["text"] if i == len(ts) - 1 else "..." for i, t in enumerate(ts))
    assert chat_format.locate_turns(last_only, turns)[2] == [1, 2]


def test_conversations_of_any_length_and_odd_rows(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(150)] + [(None, 0, None, None), (2, None, "user", "a"), (2, 1, "assistant", None), (2, 1, "assistant", None)]
    got = {r["conv_id"]: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest(f"{r}\n{t}\n" for _, _, r, t in rows[:150])
    assert got[1]["loss_sha256"] == digest(t for _, _, r, t in rows[:150] if r == "assistant") and got[1]["n_turns"] == 150
    assert got[None]["turns_sha256"] == digest(["\n\n"]) and got[2]["n_turns"] == 3 and got[2]["loss_chars"] == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 10: decontamination


def brute_hits(text, items, size=13):
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        k = min(size, len(own))
        parts = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in parts:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), found


@pytest.mark.parametrize("limit", [32 << 20, 2000])
def test_hits_equal_brute_force(spark, limit):
    draw = random.Random(11)
    items = [(i, sentence(draw, n)) for i, n in enumerate((3, 13, 20, 40))] + [(9, None), (10, " ;; "), (11, "lone"), (11, "lone")]
    texts = [*ODD, f"{sentence(draw, 9)} {items[2][1].upper()}, tail", f"É {items[3][1].replace(' ', '; ')} lone x", items[1][1], f"{items[0][1]}x", " ".join(items[3][1].split()[5:30])]
    docs = frame(spark, texts).withColumn("items", F.lit("clash")).withColumn("_scan", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    scanned = decontaminate.scan_benchmark(docs, bench, automaton_bytes=limit)
    for r in decontaminate.hit_spans(scanned).collect():
        n, hits, found = brute_hits(texts[r["row"]["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (n, hits, found) and r["row"]["_scan"] == 1
        text = texts[r["row"]["doc_id"]]
        assert sum(len(decontaminate.normal_words(text[s["start"] : s["end"]].encode())) for s in r["spans"]) == hits
    empty = decontaminate.scan_benchmark(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert empty == 0 and decontaminate.scan_benchmark(docs.limit(0), bench).count() == 0


# ---- the pipeline


def test_pipeline_decisions_take_effect(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(12)
    clean = [sentence(draw, 120) for _ in range(8)]
    item = sentence(draw, 30)
    texts = [*clean, clean[0], clean[1].replace("alpha", "alpha ", 1), f"{item} {sentence(draw, 40)}", "too short", None, f'{sentence(draw, 30)} token = "abcdef0123456789"']
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality"]) == {*range(11), 13} and set(seen["near_copies"]) == {*range(8), 10, 13}
    assert set(seen["decontamination"]) == {*range(8), 13}
    assert "abcdef0123456789" not in seen["secrets"][13]["text"] and all(seen["secrets"][i]["text"] == clean[i] for i in range(8))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: list(r["ids"]) for i, r in got.items()} == {i: list(r["ids"]) for i, r in seen["sentencepiece"].items()}
