"""Pairs at the threshold meet whatever the number of components."""

import numpy as np
import pytest

from tidemark.llm import embedding_lsh


def pairs(dim, n, seed=9):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    return x, 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize(("dim", "rows"), [(64, 1000), (384, 1000), (1024, 1000), (64, 10**9), (384, 10**9)])
def test_recall_by_dimension_and_size(dim, rows):
    """Of pairs at the threshold, also with the parameters of a very large table."""
    n = 4000 if dim < 100 else 1000
    x, y = pairs(dim, n)
    met, functions = 0, embedding_lsh.functions_of(rows)
    for at in range(0, n, 500):
        a, b = embedding_lsh.hashes(x[at : at + 500], functions), embedding_lsh.hashes(y[at : at + 500], functions)
        met += ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1).sum()
    assert met / n > 0.998


def test_near_vectors_of_many_components(spark):
    x, y = pairs(300, 12)
    y = x + 0.1 * (y - x)
    rows = [(2 * i + j, v[i].tolist(), 1) for i in range(12) for j, v in enumerate((x, y))] + [(100 + i, [float(i), 1.0], 1) for i in range(3)]
    found = {r["vec_id"]: r["component_id"] for r in embedding_lsh.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert all(found[2 * i] == found[2 * i + 1] == 2 * i for i in range(12))
