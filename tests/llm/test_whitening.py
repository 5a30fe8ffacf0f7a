"""Whitened vectors against a dense eigendecomposition and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import whitening


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], f"vec_id long, embedding array<{kind}>, component string")


def run(spark, vectors, kind="float", **options):
    table, dims = whitening.packed(frame(spark, vectors, kind), "vec_id", "embedding", 64)
    fit = whitening.fit_whitening(table, dims, **options)
    return table, fit


def exact(vectors):
    """(integers, deviations) of the contract."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    return x, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]


def dense(vectors):
    x, deviations = exact(vectors)
    a = np.array([[float(Fraction(c) - Fraction(s, len(x))) for c, s in zip(v, map(sum, zip(*x, strict=True)), strict=True)] for v in x])
    values, axes = np.linalg.eigh(a.T @ a / len(x))
    return deviations, values[::-1], a @ axes[:, ::-1]


def same_up_to_sign(got, want):
    for j in range(got.shape[1]):
        sign = np.sign(got[:, j] @ want[:, j])
        assert np.abs(got[:, j] * sign - want[:, j]).max() < 1e-8


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [[float(c) for c in r.embedding] for r in docs]
    deviations, values, projected = dense(vectors)
    got = whitening.q_whitening(spark, small).orderBy("vec_id", "component").collect()
    assert len(got) == 32 * len(docs)
    table = np.array([r.whitened for r in got]).reshape(-1, 32)
    same_up_to_sign(table, projected[:, :32] / np.sqrt(values[:32]))
    for i, r in enumerate(got):
        assert (r.vec_id, r.component, r.n, r.deviation) == (docs[i // 32].vec_id, i % 32 + 1, len(docs), deviations[i // 32])
    assert np.allclose([r.explained for r in got[:32]], values[:32] / values.sum(), rtol=1e-10)
    assert got[0].identity_error < 1e-9


def test_null_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 5)).astype(np.float32))]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    table, fit = run(spark, good + bad + [(None, good[0][1])])
    assert (fit.n, fit.dims, len(fit.values)) == (61, 5, 5)
    out = whitening.whiten(table, fit)
    assert out.count() == 61 * 5 and out.where("vec_id is null").count() == 5
    assert whitening.identity_error(table, fit) < 1e-10
    for vectors in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 7):
        table, fit = run(spark, vectors)
        assert whitening.whiten(table, fit).collect() == [] and whitening.identity_error(table, fit) == 0.0


@pytest.mark.parametrize(("dims", "wanted", "block", "fall"), [(40, 8, 4, 0.7), (40, 40, 16, 0.9), (7, 32, 16, 0.7), (60, 3, 2, 0.5)])
def test_falling_spectrum(spark, dims, wanted, block, fall):
    rng = np.random.default_rng(dims)
    raw = rng.standard_normal((300, dims)) * (30 * fall ** np.arange(dims)) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0] + 3
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(raw)]
    table, fit = run(spark, vectors, "double", components=wanted, block=block)
    deviations, values, projected = dense([v for _, v in vectors])
    k = len(fit.values)
    assert k <= min(wanted, dims) and np.allclose(fit.values, values[:k], rtol=1e-9)
    got = whitening.whiten(table, fit).orderBy("vec_id", "component").collect()
    same_up_to_sign(np.array([r.whitened for r in got]).reshape(-1, k), projected[:, :k] / np.sqrt(values[:k]))
    assert [int(r.deviation) for r in got[::k]] == deviations
    if (dims, wanted) == (60, 3):  # the leading part of a falling spectrum needs no full basis
        assert fit.passes * block < dims


def test_equal_eigenvalues_restart(spark):
    """Six directions of one eigenvalue, blocks of two: an invariant subspace after each pass."""
    vectors = [(2 * j + s, [(-1.0) ** s * (4.0 if i == j else 0.0) for i in range(6)]) for j in range(6) for s in range(2)]
    table, fit = run(spark, vectors, components=6, block=2)
    assert len(fit.values) == 6 and np.ptp(fit.values) < 1e-6 and fit.restarts > 0
    assert whitening.identity_error(table, fit) < 1e-10
    vectors += [(99, [0.0] * 6)]
    assert run(spark, vectors, components=2, block=2)[1].restarts > 0  # the trace left over tells that more is there


def test_rank_deficient(spark):
    rng = np.random.default_rng(5)
    raw = rng.integers(-9, 9, (50, 2)) @ rng.integers(-3, 4, (2, 12))
    table, fit = run(spark, [(i, [float(c) for c in v]) for i, v in enumerate(raw)])
    assert len(fit.values) == 2 and whitening.identity_error(table, fit) < 1e-9


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(9)
    vectors = [(i, [float(c) for c in rng.integers(-(10**12), 10**12, 4)]) for i in range(20)] + [(20, [1e300, 0.0, 0.0, 0.0])]
    table, fit = run(spark, vectors[:20], "double")
    got = whitening.whiten(table, fit).where(F.col("component") == 1).orderBy("vec_id").collect()
    assert [int(r.deviation) for r in got] == exact([v for _, v in vectors[:20]])[1]
    table, fit = run(spark, vectors, "double")
    assert fit.n == 21 and whitening.whiten(table, fit).count() == 21 * len(fit.values)
