"""Secret scans: a token is scored with the features it is fitted with."""

from __future__ import annotations

import random

import numpy as np

from lattica.llm import secret_crf


def test_scores_are_those_of_the_fitted_features():
    draw = random.Random(5)
    rng = np.random.default_rng(5)
    model = secret_crf.Field(rng.normal(size=(secret_crf.BUCKETS, 3)), np.zeros((3, 3)), frozenset([b"a", b"pwd", b"token"]))
    words = [b"CorrectHorseTab", b"AaaaaaaAaaaaAaa", b"b", b"pwd:", b"x=AbcdefGhij", "éàü".encode()]
    words += [bytes(draw.choice(b"abcXYZ=.:\"") for _ in range(draw.randint(1, 18))) for _ in range(300)]
    got = secret_crf._Words(model).scores(words)
    for i, word in enumerate(words):
        names = secret_crf.own_features(word, model.lexicon) + [secret_crf.file_feature(words)]
        names += secret_crf.neighbour_features(words[i - 1], model.lexicon, "before") if i else []
        names += secret_crf.neighbour_features(words[i + 1], model.lexicon, "after") if i + 1 < len(words) else []
        assert np.allclose(got[i], model.rows(names))


def test_all_marks_count_in_texts_of_any_length():
    for n in (10, 1 << 16, 1 << 17):
        assert secret_crf.file_feature([b"a"] * n + [b":="] * 3) == "file3"
