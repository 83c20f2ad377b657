"""Operator 1 against all pairs."""

import math

import numpy as np
import pytest

from curbwatch.llm import forest


def brute(rows):
    """{id: (links, component)} by comparing every pair in double precision."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {k: k for k in range(len(good))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y >= 0.9 * math.sqrt((x @ x) * (y @ y)):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(good):
        low[root(k)] = min(low.get(root(k), i), i)
    out = {i: (0, i) for i, _ in rows}
    return out | {i: (links[k], low[root(k)]) for k, (i, _) in enumerate(good)}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((30, 16))
    rows = [centers[k % 30] + rng.standard_normal(16) * (0.12 if k % 3 else 0.02) for k in range(400)] + list(rng.standard_normal((300, 16)))
    rows = [r.tolist() for r in rows] + [rows[0].tolist()] * 5 + [(2 * rows[1]).tolist(), [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], None, [1.0, 0.0], [0.9, 0.1]]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


def check(spark, rows, kind):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, point string")
    return {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(df).collect()}


def test_one_leaf_finds_every_link(spark, vectors):
    assert check(spark, vectors, "double") == brute(vectors)


def test_forest_of_small_leaves(spark, vectors, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 40)
    monkeypatch.setattr(forest, "LEVELS", 2)
    monkeypatch.setattr(forest, "SAMPLE", 64)
    monkeypatch.setattr(forest, "BLOCK", 4)
    got, want = check(spark, vectors, "float"), brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors])
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_pairs_in_a_dense_cluster(spark, monkeypatch):
    """Pairs at cosine 0.905 without other neighbours, where all vectors are alike to 0.7, in deep trees."""
    monkeypatch.setattr(forest, "LEAF", 32)
    monkeypatch.setattr(forest, "QUERIES", 300, raising=False)
    rng = np.random.default_rng(5)
    normed = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    around = np.zeros(48)
    around[0] = np.sqrt(0.7)
    own = normed(np.insert(rng.standard_normal((2000, 47)), 0, 0.0, axis=1))
    other = normed(np.insert(rng.standard_normal((1000, 47)), 0, 0.0, axis=1))
    other = normed(other - (other * own[:1000]).sum(axis=1, keepdims=True) * own[:1000])
    share = (0.905 - 0.7) / 0.3
    twin = share * own[:1000] + np.sqrt(1 - share * share) * other
    rows = [(i, v.tolist()) for i, v in enumerate(around + np.sqrt(0.3) * np.concatenate([own, twin]))]
    got = check(spark, rows, "double")
    found = sum(got[2000 + i] == (1, i) and got[i] == (1, i) for i in range(1000))
    assert found >= 980, found


def test_empty_table(spark):
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
