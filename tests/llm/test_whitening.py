"""Whitening against the library's eigenvectors and exact sums of Python integers."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from wardlens.llm import whitening as W
from wardlens.llm.queries import QUERIES


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def check(rows, given, width=None):
    """``rows`` of the query against ``given`` pairs (id, vector)."""
    kept = [(i, v) for i, v in given if good(v) and (width is None or len(v) == width)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > values[0] * d * 1e-14).sum())
    k = min(32, rank)
    expected = y @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    assert len(rows) == n * k
    by = defaultdict(dict)
    for r in rows:
        assert r.n == n and 0 <= r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        by[r.vec_id, r.deviation].setdefault(r.component, []).append(r.whitened)
    assert {key[0] for key in by} == {i for i, _ in kept}
    if len({i for i, _ in kept}) == n:
        got = np.array([[by[i, dev][c + 1][0] for c in range(k)] for (i, _), dev in zip(kept, deviation)])
        sign = np.sign((got * expected).sum(axis=0))
        apart = np.abs(np.diff(values[: k + 1] if k < d else values)) / values[0] > 1e-6
        clear = [c for c in range(k) if (c == 0 or apart[c - 1]) and (c >= len(apart) or apart[c])]
        assert len(clear) >= min(k, 1)
        assert np.abs(got * sign - expected)[:, clear].max() < 1e-6
        assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (20, 5), (64, 64), (65, 65)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(200, rank)) * np.logspace(0, -3, rank) @ rng.normal(size=(rank, d))
    scatter = x.T @ x
    factor, order = W.pivoted_cholesky(scatter)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, scatter[np.ix_(order, order)])
    assert np.allclose(factor, np.tril(factor)) and (np.diff(np.abs(np.diagonal(factor))) <= 1e-9).all()
    values, vectors = W.components_of(scatter)
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:rank], rtol=1e-9)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-10)
    assert np.allclose(vectors * values @ vectors.T, scatter, atol=1e-9 * values[0])


def test_equal_eigenvalues():
    values, vectors = W.components_of(np.eye(6) * 3)
    assert np.allclose(values, 3) and np.allclose(vectors @ vectors.T, np.eye(6))


def test_given_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op11_whitening"](spark, sf_dir).collect(), given)


def test_faulty_vectors_null_ids_and_other_columns(spark):
    rng = np.random.default_rng(1)
    given = [(k, [float(c) for c in rng.normal(size=3) * (1, 5, 0.5)]) for k in range(50)]
    faulty = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 1.0]), (104, [float("inf"), 0.0, 1.0]), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, id int, vector string, n int, i int"
    df = spark.createDataFrame([(*r, 1, "v", 2, 3) for r in given + faulty + [(None, [9.0, 9.0, 9.0])]], schema).repartition(5)
    check(W.digest(df).collect(), [*given, *faulty, (None, [9.0, 9.0, 9.0])], width=3)


def test_large_entries_are_exact(spark):
    given = [(1, [1e8, 0.0]), (2, [-1e8, 1.5]), (3, [3e7, 2.0]), (4, [12.25, -7.0])]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    rows, n = W._of_width(W.usable(df))
    found = W.whiten(rows, W.fit(rows, n)).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in given]
    sums = [sum(c) for c in zip(*x)]
    assert {r.id: int(r.deviation) for r in found} == {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(given, x)}


def test_repeated_rows_and_low_rank(spark):
    given = [(k % 5, [float(k % 5), 2.0 * (k % 5), 1.0]) for k in range(20)]
    check(W.digest(spark.createDataFrame(given, "vec_id long, embedding array<float>")).collect(), given)


@pytest.mark.parametrize("given", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)]])
def test_nothing_to_whiten(spark, given):
    df = W.digest(spark.createDataFrame(given, "vec_id long, embedding array<float>"))
    assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
