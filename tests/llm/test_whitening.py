"""Operator 13 against a direct eigendecomposition."""

import math

import numpy as np
import pytest

from conftest import FOLDER
from curbwatch.llm import queries, whitening


def direct(rows, components=16):
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    grid = np.floor(np.array([v for _, v in rows], float) * 64).astype(np.int64) + 1_000_000
    distinct = np.unique(grid, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (distinct * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    there = [k for k in range(min(components, len(values))) if values[k] > 1e-12 * values[0]]
    return rows, n, ((grid * n - sums) ** 2).sum(axis=1), (grid * n - sums) / n @ vectors[:, there] / np.sqrt(values[there]), values[there] / values.sum()


def check(out, rows, components=16, tolerance=1e-9):
    rows, n, deviation, white, explained = direct(rows, components)
    m = len(explained)
    got = out.orderBy("vec_id", "component").collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0]))
    assert len(got) == len(rows) * m
    assert [r.vec_id for r in got] == [rows[i][0] for i in order for _ in range(m)]
    assert [r.component for r in got] == list(range(1, m + 1)) * len(rows)
    assert {r.n for r in got} <= {n} and [int(r.deviation) for r in got] == [int(deviation[i]) for i in order for _ in range(m)]
    mine = np.array([r.whitened for r in got]).reshape(len(rows), m)
    white = white[order]
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < tolerance
    assert np.allclose([r.explained for r in got[:m]], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    return got


def test_whitening_of_all_embeddings(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    check(queries.PLANS["op13_embedding_whitening"](spark, FOLDER), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("spread", ["steep", "repeated", "low rank"])
def test_spectra(spark, spread):
    """Eigenvalues far apart, the same one often, and vectors that span few dimensions."""
    random = np.random.default_rng(4)
    x = random.standard_normal((300, 12))
    if spread == "steep":
        x *= 3.0 ** -np.arange(12) * 200
    elif spread == "repeated":
        x = np.concatenate([np.eye(12) * 3, -np.eye(12) * 3, np.eye(12) * 0])
    else:
        x = random.integers(-9, 9, (300, 3)) @ random.integers(-9, 9, (3, 12)) / 64.0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = whitening.whiten(df, components=5)
    if spread != "repeated":
        check(out, [(r.vec_id, r.embedding) for r in df.collect()], 5, 1e-7)
        return
    rows = out.collect()
    assert {r.component for r in rows} == set(range(1, 6)) and np.allclose([r.explained for r in rows], 1 / 12) and rows[0].identity_error < 1e-9


def test_few_of_many_dimensions(spark):
    """The sweeps end before all dimensions are used."""
    random = np.random.default_rng(6)
    x = random.standard_normal((200, 150)) * 0.6 ** np.arange(150) * 100
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df, components=3), [(r.vec_id, r.embedding) for r in df.collect()], 3, 1e-8)


def test_odd_vectors(spark):
    random = np.random.default_rng(8)
    good = [[float(c) for c in v] for v in random.standard_normal((30, 4)) * 3]
    rows = [(i, v) for i, v in enumerate(good + good[:10])] + [(None, good[3]), (3, good[4])]
    odd = [(100, None), (101, [None, 1.0, 2.0, 3.0]), (102, [math.nan, 1.0, 2.0, 3.0]), (103, [math.inf, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2.0, [3]) for r in rows + odd], "vec_id long, embedding array<double>, n int, x double, _x array<int>")
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    assert {r.vec_id for r in got} == {r[0] for r in rows} and {r.component for r in got} == {1, 2, 3, 4}
    assert len(got) == 4 * len(rows)
    check(whitening.whiten(df.filter("vec_id < 40 and vec_id <> 3")), [r for r in rows[:40] if r[0] != 3])
    for few in (df.filter("vec_id >= 100"), df.filter("vec_id = 7"), df.filter("vec_id > 999")):
        out = whitening.whiten(few)
        assert out.count() == 0 and out.columns[0] == "vec_id"


def test_deviation_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [s * 3e13, float(i)]) for i, s in enumerate((1, -1, 1, -1, 1))], "vec_id long, embedding array<double>")
    x = [[math.floor(s * 3e13 * 64) + 1_000_000, 64 * i + 1_000_000] for i, s in enumerate((1, -1, 1, -1, 1))]
    sums = [sum(v[k] for v in x) for k in range(2)]
    want = {i: sum((5 * v[k] - sums[k]) ** 2 for k in range(2)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()} == want
