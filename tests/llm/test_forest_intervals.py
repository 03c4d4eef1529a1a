"""The forest's intervals against comparing all pairs of a region, and recall close to the threshold."""

import random

import numpy as np
import pytest

from tidemark.llm import minhash_forest as forest
from tidemark.llm.linking import roots_of


def sorted_region(seed, families, copies, change):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(families):
        base = rng.integers(0, 6, forest.BITS).astype(np.uint8)
        for _ in range(rng.integers(1, copies + 1)):
            row = base.copy()
            at = rng.choice(forest.BITS, rng.integers(0, change + 1), replace=False)
            row[at] = rng.integers(0, 256, len(at))
            rows.append(row)
    sigs = np.array(rows)
    orders = sigs[:, : forest.ORDER_BYTES]
    order = np.lexsort(orders.T[::-1])
    return orders[order], sigs[order]


@pytest.mark.parametrize(("families", "copies", "change"), [(1, 300, 40), (40, 12, 70), (120, 2, 90), (5, 60, 100), (1, 1, 0)])
def test_intervals_link_like_all_pairs(families, copies, change):
    orders, sigs = sorted_region(families, families, copies, change)
    m = len(sigs)
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m) if (sigs[i] == sigs[j]).sum() >= forest.AGREE]
    want = roots_of(m, np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int))
    a, b = forest.interval_links(orders, sigs)
    assert (roots_of(m, a, b) == want).all()


def test_common_prefixes():
    orders = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 4], [2, 0, 0]], dtype=np.uint8)
    assert forest.common_prefixes(orders).tolist() == [2, 3, 0]


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80, which share nothing with other pairs: nearly all are found."""
    rng, rows, sure = random.Random(5), [], []
    for i in range(400):
        words = [f"p{i}w{j}" for j in range(rng.randrange(60, 200))]
        other = list(words)
        n = len(words) - 4
        # cutting c shingles off one end gives a similarity of (n - c) / n
        c = rng.randrange(int(0.2 * n), int(0.25 * n) + 1)
        if 100 * (n - c) < 75 * n:
            c = n // 4
        other = other[: len(words) - c]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        sure.append(100 * (n - c) >= 75 * n)
    found = {r["doc_id"]: r["component_id"] for r in forest.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    met = sum(found[2 * i + 1] == 2 * i for i in range(400))
    assert all(sure) and met >= 396


def test_a_large_family_is_dealt_to_blocks(spark, monkeypatch):
    """Several blocks, pivots, and components inside one candidate family: exact links all the same."""
    monkeypatch.setattr(forest, "FAMILY", 40)
    monkeypatch.setattr(forest, "BLOCK", 20)
    monkeypatch.setattr(forest, "PIVOTS", 2)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            t[rng.randrange(100)] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(t)))
    from test_dedup import near_by_brute_force

    found = forest.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == near_by_brute_force(rows)
