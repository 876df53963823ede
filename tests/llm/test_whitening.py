"""Whitening against a dense eigendecomposition with exact moments."""

import math
from collections import defaultdict

import numpy as np
import pytest

from skirmish.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string, `size` long"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "mine", 3) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def integers(vectors):
    return {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors}


def compare(out, vectors, components):
    x = integers(vectors)
    ids, n = list(x), len(vectors)
    table = np.array([x[i] for i, _ in vectors], object)
    sums = table.sum(axis=0)
    centred = (n * table - sums).astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, int((values > 1e-9 * values.sum()).sum()))
    rows = out.collect()
    assert len(rows) == k * n
    got = defaultdict(dict)
    for r in rows:
        got[r.component][r.vec_id] = r.whitened
        assert r.n == n and r.deviation == int(((n * np.array(x[r.vec_id], object) - sums) ** 2).sum())
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
    assert sorted(got) == list(range(1, k + 1))
    of = dict(zip([i for i, _ in vectors], centred, strict=True))
    for c in got:
        want = np.array([of[i] @ basis[:, c - 1] for i in ids]) / math.sqrt(values[c - 1])
        have = np.array([got[c][i] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7


@pytest.mark.parametrize(("d", "components", "guard"), [(24, 32, 16), (40, 6, 4)])
def test_leading_components(spark, d, components, guard):
    rnd = np.random.default_rng(d + guard)
    vectors = [(i, v) for i, v in enumerate(rnd.standard_normal((400, d)) * np.linspace(2, 0.5, d) + rnd.standard_normal(d))]
    compare(whitening.whiten(table(spark, vectors), components, guard), vectors, components)


def test_awkward_rows(spark):
    rnd = np.random.default_rng(5)
    vectors = [(i, list(v)) for i, v in enumerate(rnd.standard_normal((60, 5)))]
    vectors += [(60 + i, vectors[7][1]) for i in range(200)]  # one vector very often
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [math.nan] * 5), (903, [1.0, 2.0, math.inf, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (906, [1e30, 0, 0, 0, 0])]
    compare(whitening.whiten(table(spark, vectors + bad)), vectors, 32)
    none = whitening.whiten(table(spark, [*vectors, (None, vectors[3][1])])).where("vec_id IS NULL").collect()
    assert len(none) == 5


def test_fewer_vectors_than_dimensions_and_no_variance(spark):
    rnd = np.random.default_rng(6)
    vectors = [(i, v) for i, v in enumerate(rnd.standard_normal((4, 12)))]
    compare(whitening.whiten(table(spark, vectors), 8, 2), vectors, 8)
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == whitening.whiten(table(spark, vectors)).columns


def test_deviation_beyond_a_long_is_null(spark):
    vectors = [(i, [float(2**50 * (i % 2)), float(i)]) for i in range(4)]
    assert {r.deviation for r in whitening.whiten(table(spark, vectors)).collect()} == {None}


def test_no_guard_is_an_error():
    with pytest.raises(ValueError):
        whitening.subspace(lambda q: q, 9, 3, 0)


@pytest.mark.parametrize("degree", [4, 10, 31])
def test_filter_finds_close_eigenvalues(degree):
    rnd = np.random.default_rng(degree)
    basis = np.linalg.qr(rnd.standard_normal((90, 90)))[0]
    values = np.sort(np.concatenate([[9.0, 5.0], rnd.uniform(1, 1.2, 88)]))[::-1]
    fit = whitening.subspace(lambda q: basis @ (values[:, None] * (basis.T @ q)), 90, 12, 8, degree)
    assert fit.passes > fit.rounds > 0
    assert np.abs(fit.values - values[:12]).max() < 1e-10
    assert np.abs(np.abs((fit.vectors * basis[:, :12]).sum(axis=0)) - 1).max() < 1e-10
