"""License scans: every diagonal counts, and alignments equal the longest common subsequence."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lattica.llm import license_scan

WORDS = [f"w{i}" for i in range(60)]
INDEX = license_scan.Index({"T": " ".join(WORDS)})


def found(words):
    return license_scan.licenses_of(" ".join(words), INDEX, 0.8, 4)


def with_gaps(gaps, size):
    cut = [len(WORDS) * k // (gaps + 1) for k in range(gaps + 2)]
    return [w for k in range(gaps + 1) for w in ([f"x{k}{i}" for i in range(size)] if k else []) + WORDS[cut[k] : cut[k + 1]]]


@pytest.mark.parametrize("gaps", [1, 2, 3, 6])
def test_notices_with_insertions_are_found(gaps):
    got = found(["before", *with_gaps(gaps, 4), "after"])
    assert [x["coverage"] for x in got] == [1.0]


def test_a_stray_fingerprint_beside_the_match_takes_nothing_away():
    # the fingerprints of the first words lie four diagonals lower; the rest moves away in two steps
    assert [x["coverage"] for x in found(WORDS[:6] + ["a", "b", "c"] + WORDS[6:30] + ["d", "e", "f"] + WORDS[30:])] == [1.0]


def test_two_copies_are_two_matches_whole_or_in_part():
    got = found(WORDS + ["and"] + WORDS)
    assert [x["coverage"] for x in got] == [1.0, 1.0] and got[0]["end"] < got[1]["start"]
    assert [x["coverage"] for x in found(WORDS[:48] + WORDS)] == [0.8, 1.0]


def test_alignment_equals_longest_common_subsequence():
    draw = random.Random(1)
    for _ in range(300):
        text, template = (np.array([draw.randrange(6) for _ in range(draw.randint(1, 12))], np.uint64) for _ in range(2))
        low = draw.randint(-12, 12)
        high = low + draw.randint(0, 12)
        best = {(-1, k): 0 for k in range(-1, len(text))} | {(k, -1): 0 for k in range(len(template))}
        for j in range(len(template)):
            for i in range(len(text)):
                best[j, i] = max(best[j - 1, i], best[j, i - 1], best[j - 1, i - 1] + (text[i] == template[j] and low <= i - j <= high))
        score, a, b = license_scan.align(text, template, low, high)
        assert score == best[len(template) - 1, len(text) - 1]
        assert not score or (text[a] in template and text[b] in template and b - a + 1 >= score)
