"""Recall of the vector search as shipped, on planted pairs right above the threshold, in blocks as well."""

import numpy as np
import pytest

from trackloom.llm import embeddings


@pytest.mark.parametrize("block", [1024, 16])
def test_planted_pairs_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    n, dim = 2000, 32
    x = rng.standard_normal((n, dim))
    for k in range(300):  # neighbours at a cosine of 0.931 to 0.96
        a = x[k] / np.linalg.norm(x[k])
        side = rng.standard_normal(dim)
        side -= side @ a * a
        c = rng.uniform(0.931, 0.96)
        x[1000 + k] = 3 * (c * a + np.sqrt(1 - c * c) * side / np.linalg.norm(side))
    x[1500:1600] = x[1700] + 0.01 * rng.standard_normal((100, dim))  # a group of near copies
    x[1900:1950] = x[5]  # exact copies
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), 0) for i in range(n)] + [(n, None, 0), (n + 1, [float("nan")] * dim, 0), (n + 2, x[5].tolist(), 1)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = ((u @ u.T) >= 0.93) & ~np.eye(n, dtype=bool)
    want = links.sum(axis=1)
    found = np.array([got[i].n_links for i in range(n)])
    assert len(got) == n + 3 and (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert [got[n + k].n_links for k in range(3)] == [0, 0, 0]
    assert all(got[i].component_id == 5 for i in range(1900, 1950)) and got[1599].component_id == 1500
