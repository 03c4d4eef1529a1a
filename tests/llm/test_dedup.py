"""Exact, near, substring and vector dedup against brute force, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import debruijn_dedup, embedding_lsh, fingerprint_dedup, minhash_forest
from tidemark.llm.common import components
from tidemark.llm.linking import exact_links, roots_of

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, node string, keep_id string, n string, h string, a string"


def docs_of(spark, texts, parts=3):
    """Rows with extra columns of clashing names."""
    rows = [(i, t, None, "s", None, "x", "y", "z", "n", "h", "a") for i, t in texts]
    return spark.createDataFrame(rows, DOC).repartition(parts, "doc_id")


def stored(spark, tmp_path, texts):
    path = str(tmp_path / "docs")
    docs_of(spark, texts).write.parquet(path)
    return spark.read.parquet(path)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def words(text, fold):
    text = text or ""
    if fold:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# exact


def test_fingerprints_compose():
    data = bytes(random.Random(1).randbytes(300_000))
    for cut in (0, 1, 65_535, 65_536, 200_001, 300_000):
        a, b = fingerprint_dedup.fingerprint(data[:cut]), fingerprint_dedup.fingerprint(data[cut:])
        assert fingerprint_dedup.combine(a, b) == fingerprint_dedup.fingerprint(data)
    assert fingerprint_dedup.fingerprint(b"a\0") != fingerprint_dedup.fingerprint(b"a")


EXACT = [(1, "x"), (2, None), (3, ""), (4, "x"), (5, "X"), (6, "x "), (7, "y" * 200_000), (8, "y" * 200_000), (9, "y" * 199_999 + "z"), (4, "x"), (None, "x"), (None, "lone")]


def test_exact_groups(spark, tmp_path):
    found = fingerprint_dedup.exact_groups(stored(spark, tmp_path, EXACT)).collect()
    assert len(found) == len(EXACT)
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found]
    assert sorted(r for r in rows if r[0] in (1, 2, 3, 7, 8, 9)) == [(1, 4, 4, False), (2, 3, 2, False), (3, 3, 2, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True)]
    assert sorted(r[3] for r in rows if r[0] == 4) == [False, True]
    assert {(r[2], r[3]) for r in rows if r[0] is None} == {(4, False), (1, True)}
    texts = {i: t or "" for i, t in EXACT}
    assert all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in found if r["doc_id"] is not None)
    kept = fingerprint_dedup.without_copies(stored(spark, tmp_path / "again", EXACT))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")] and all(r["node"] == "y" for r in kept.collect())
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, "lone"), (3, ""), (4, "x"), (5, "X"), (6, "x "), (8, "y" * 200_000), (9, "y" * 199_999 + "z")], key=str)


def test_exact_groups_of_colliding_fingerprints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint_dedup, "fingerprint", lambda data: (0, 0, 0))
    found = by_id(fingerprint_dedup.exact_groups(stored(spark, tmp_path, [(1, "x"), (2, "y"), (3, "x"), (4, "")])).collect())
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in found.items()} == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_chunks_of_huge_texts_are_hashed_apart(spark, tmp_path, monkeypatch):
    """Texts of many chunks and tasks: the same fingerprints as in one piece, and the same groups."""
    from pyspark.sql import functions as F

    huge = "ab\u00e9" * 120_000
    texts = [(1, huge), (2, huge), (3, huge[:-1] + "!"), (4, "!" + huge[1:]), (5, "s"), (6, ""), (7, "x" * fingerprint_dedup.CHUNK), (8, "x" * (2 * fingerprint_dedup.CHUNK))]
    docs = stored(spark, tmp_path, texts)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_text"))
    want = {i: fingerprint_dedup.fingerprint(t.encode()) for i, t in texts}
    monkeypatch.setattr(fingerprint_dedup, "LONG", fingerprint_dedup.CHUNK // 2)
    assert {r["doc_id"]: (r["_n"], r["_a"], r["_b"]) for r in fingerprint_dedup.described(rows).collect()} == want
    found = by_id(fingerprint_dedup.exact_groups(docs).collect())
    assert {i: (r["keep_id"], r["group_size"]) for i, r in found.items()} == {1: (2, 2), 2: (2, 2), **{i: (i, 1) for i in range(3, 9)}}


def test_exact_groups_of_nothing(spark, tmp_path):
    assert fingerprint_dedup.exact_groups(stored(spark, tmp_path, [])).collect() == []


# components and links


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    label = roots_of(2000, a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {n: label[n] for e in edges for n in e if e[0] != e[1] or (label == label[n]).sum() > 1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_exact_links():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    a, b = exact_links(sets, 3, 4)
    pairs = [(i, j) for i in range(60) for j in range(i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))]
    want = roots_of(60, np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int))
    assert (roots_of(60, a, b) == want).all()


# near copies


def near_by_brute_force(texts):
    sets = []
    for _, t in texts:
        w = words(t, True)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    a, b = [], []
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a.append(i)
                b.append(j)
    label = roots_of(len(texts), np.array(a, dtype=int), np.array(b, dtype=int))
    least = {}
    for i, (d, _) in enumerate(texts):
        least[label[i]] = min(least.get(label[i], d), d)
    return {d: (len(sets[i]), least[label[i]], least[label[i]] == d) for i, (d, _) in enumerate(texts)}


def near_texts(seed=5, groups=12, copies=14):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 160))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 30)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(3000)}"
            texts.append(" ".join(t) if rng.random() < 0.5 else "\t".join(t).upper())
    texts += [None, "", " \n", "one two", "ONE  two", "one two three", "é" * 50, "long " * 30_000, "a b c d e", "a b c d e", "É x", "é x"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_near_components(spark, monkeypatch, small):
    texts = near_texts()
    if small:  # every limit passed, so that the ways beyond them are taken
        for name, value in (("REGION", 4), ("FAMILY", 5), ("BLOCK", 3), ("PIVOTS", 1)):
            monkeypatch.setattr(minhash_forest, name, value)
    found = minhash_forest.near_components(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == near_by_brute_force(texts)


def test_one_of_each(spark, tmp_path):
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "A b c d e f"), (None, "q r s"), (None, "q r s"), (3, None), (3, None), (4, "other words")]
    kept = minhash_forest.one_of_each(stored(spark, tmp_path, texts))
    assert kept.columns[:2] == ["doc_id", "text"] and "_row" not in minhash_forest.near_components(kept).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "q r s"), (3, None), (3, None), (4, "other words")], key=str)


def test_near_components_of_nothing(spark):
    assert minhash_forest.near_components(docs_of(spark, [])).collect() == []
    assert len(minhash_forest.near_components(docs_of(spark, [(1, None)])).collect()) == 1


# repeated passages


def repeats_by_brute_force(texts, window):
    split = [words(t, False) for _, t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (d, _), w in zip(texts, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def removed(spark, texts):
    found = debruijn_dedup.without_repeats(docs_of(spark, texts)).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=str)


def test_repeats_of_whole_windows(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(40):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            lo = rng.randrange(0, 20)
            w[len(w) // 2 : len(w) // 2] = passage[lo : lo + rng.randrange(30, 41)]
        texts.append((i, rng.choice([" ", "\n\n", " \t"]).join(w)))
    same = " ".join(f"s{i}" for i in range(50))
    texts += [(100, same), (101, same), (101, same), (None, same), (102, None), (103, ""), (104, "x " * 500), (105, " ".join(f"t{i}" for i in range(34))), (106, " ".join(f"t{i}" for i in range(34)))]
    texts += [(107, "Ü é " * 40), (108, "lone")]
    assert removed(spark, texts) == repeats_by_brute_force(texts, 35)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_short_windows(spark, monkeypatch, seed):
    monkeypatch.setattr(debruijn_dedup, "WINDOW", 5)
    monkeypatch.setattr(debruijn_dedup, "ANCHOR", 2)
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    assert removed(spark, texts) == repeats_by_brute_force(texts, 5)


def test_repeats_of_nothing(spark):
    assert removed(spark, []) == []


# vectors

VEC = "vec_id bigint, embedding array<float>, label int, node string, value string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, l, "x", "y") for i, e, l in rows], VEC).repartition(3)  # noqa: E741


def links_by_brute_force(rows):
    unit = []
    for _, e, label in rows:
        ok = label is not None and e and None not in e and np.isfinite(np.array(e, dtype=float)).all() and any(e)
        x = np.array(e, dtype=np.float32).astype(float) if ok else None
        unit.append(None if x is None else x / np.sqrt(x @ x))
    n, a, b = [0] * len(rows), [], []
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                n[i] += 1
                n[j] += 1
                a.append(i)
                b.append(j)
    label = roots_of(len(rows), np.array(a, dtype=int), np.array(b, dtype=int))
    least = {}
    for i, (v, *_) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], v), v)
    return {v: (n[i], least[label[i]], least[label[i]] == v) for i, (v, *_) in enumerate(rows)}


@pytest.mark.parametrize("chunk", [1024, 5])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_lsh, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(14):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, 20)):
            rows.append([*(base + rng.standard_normal(24) * rng.choice([0.05, 0.2, 0.3]))] if rng.random() < 0.8 else [*base])
    rows = [(int(i), [float(np.float32(x)) for x in e], int(i % 2)) for i, e in zip(rng.permutation(len(rows)), rows, strict=True)]
    n = len(rows)
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [nan] * 24, 1), (n + 4, [inf] + [1.0] * 23, 1), (n + 5, [None] + [1.0] * 23, 1), (n + 6, [1.0] * 24, None), (n + 7, [1.0] * 24, None)]
    rows += [(n + 8, [1.0, 2.0], 1), (n + 9, [2.0, 4.0], 1), (n + 10, [1e-30, 2e-30], 1), (n + 11, [5.0], 1), (n + 12, [7.0], 1), (n + 13, [-7.0], 1)]
    found = embedding_lsh.near_vectors(vectors_of(spark, rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == links_by_brute_force(rows)


def test_near_vectors_recall():
    """Of random pairs right at the threshold nearly all meet in a bucket."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = embedding_lsh.hashes(x), embedding_lsh.hashes(y)
    meets = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert meets.mean() > 0.999


def test_hadamard_is_orthogonal():
    h = embedding_lsh.hadamard(np.eye(8))
    assert (h @ h.T == 8 * np.eye(8)).all()


def test_near_vectors_of_nothing(spark):
    assert embedding_lsh.near_vectors(vectors_of(spark, [])).collect() == []
    assert [tuple(r) for r in embedding_lsh.near_vectors(vectors_of(spark, [(3, None, None)])).collect()] == [(3, 0, 3, True)]
