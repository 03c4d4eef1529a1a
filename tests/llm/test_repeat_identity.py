"""Windows that share their hash, prefilters that let everything through, and a very long text."""

import hashlib
import random

import numpy as np
import pytest
from test_dedup import removed, repeats_by_brute_force

from tidemark.llm import debruijn_dedup
from tidemark.llm.words import BASE, least_positions, mix, shingle_hashes


def texts_of(seed, n=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 25)))) for i in range(n)]


@pytest.mark.parametrize(("bits", "seed"), [(4, 0), (6, 1), (9, 2)])
def test_colliding_windows_are_verified(spark, monkeypatch, bits, seed):
    """Window hashes of few bits: paths of different words meet, and only true repeats go."""
    monkeypatch.setattr(debruijn_dedup, "WINDOW", 5)
    monkeypatch.setattr(debruijn_dedup, "ANCHOR", 2)
    full = debruijn_dedup.identity

    def narrow(words):
        h, c = full(words)
        return (h >> np.uint64(64 - bits)) * np.uint64(2) + np.uint64(1), np.zeros(len(c), dtype=np.int32)

    monkeypatch.setattr(debruijn_dedup, "identity", narrow)
    texts = texts_of(seed) + [(100, "a b c d e a"), (101, "a b c d e a"), (101, "a b c d e a"), (None, None)]
    assert removed(spark, texts) == repeats_by_brute_force(texts, 5)


def test_links_need_all_bits(spark, monkeypatch):
    """The first 64 bits of all windows alike: the other 32 tell them apart, in links and ends too."""
    monkeypatch.setattr(debruijn_dedup, "WINDOW", 5)
    monkeypatch.setattr(debruijn_dedup, "ANCHOR", 2)
    full = debruijn_dedup.identity
    monkeypatch.setattr(debruijn_dedup, "identity", lambda words: (np.ones(len(full(words)[0]), dtype=np.uint64), full(words)[1]))
    texts = texts_of(7)
    assert removed(spark, texts) == repeats_by_brute_force(texts, 5)


def test_full_prefilters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(debruijn_dedup, "bitmap", lambda *_: b"\xff" * 32768)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(90)) + (f" {passage} end" if i % 4 == 0 else "")) for i in range(30)]
    assert removed(spark, texts) == repeats_by_brute_force(texts, 35)


@pytest.mark.parametrize("window", [5, 35])
def test_lists_in_place_of_prefilters(spark, monkeypatch, window):
    """More repeated grams than the bitmap holds: texts get their own by a semi-join, copies, nulls and short texts too."""
    monkeypatch.setattr(debruijn_dedup, "ANCHOR_BITS", 0)
    monkeypatch.setattr(debruijn_dedup, "MERGED", 100)
    monkeypatch.setattr(debruijn_dedup, "bitmap", None)
    if window == 5:
        monkeypatch.setattr(debruijn_dedup, "WINDOW", 5)
        monkeypatch.setattr(debruijn_dedup, "ANCHOR", 2)
        texts = texts_of(11, 90)
    else:
        rng = random.Random(3)
        passage = " ".join(f"p{i}" for i in range(50))
        texts = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(90)) + (f" {passage} end" if i % 4 == 0 else "")) for i in range(30)]
    texts += [(i, texts[2][1]) for i in range(200, 260)] + [(None, None), (3, ""), (4, "a b")]
    assert removed(spark, texts) == repeats_by_brute_force(texts, window)


def test_lists_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(debruijn_dedup, "ANCHOR_BITS", -1)
    assert removed(spark, []) == [] and [r[1:3] for r in removed(spark, [(1, "alone"), (2, None)])] == [(1, 0), (0, 0)]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 16, 20, 35])
def test_hashes_of_runs_and_least_positions(k):
    rng = np.random.default_rng(k)
    for n in (0, k - 1, k, k + 1, 3 * k, 500):
        words = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        runs = [0 if n < k else sum(int(w) * pow(BASE, k - 1 - j, 1 << 64) for j, w in enumerate(words[i : i + k])) for i in range(max(0, n - k + 1))]
        want = mix(np.array([(r + k) % (1 << 64) for r in runs], dtype=np.uint64))
        assert (shingle_hashes(words, k) == want).all() and len(shingle_hashes(words, k)) == len(want)
        few = words % np.uint64(4)
        if n >= k:
            assert least_positions(few, k).tolist() == [i + int(few[i : i + k].argmin()) for i in range(n - k + 1)]


def test_a_very_long_text(spark):
    """A million words, with a passage of 80 words twice in it and once in a short text."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**9)}" for _ in range(1_000_000)]
    passage = [f"p{i}" for i in range(80)]
    long = words[:400_000] + passage + words[400_000:999_000] + passage + words[999_000:]
    found = {r[0]: r for r in removed(spark, [(1, " ".join(long)), (2, "before " + " ".join(passage) + " after"), (3, "alone")])}
    assert found[1] == (1, 1_000_160, 160, hashlib.sha256(" ".join(words).encode()).hexdigest())
    assert found[2][1:3] == (82, 80) and found[3][1:3] == (1, 0)
