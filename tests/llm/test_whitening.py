"""Whitening against an eigendecomposition of the covariance, and against whole-number arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsdesk.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, deviation string, n string, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "d", "n", "c") for i, v in vectors], SCHEMA).repartition(3)


def on_grid(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def usable(v, dim):
    return v is not None and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) < 2**53 for c in v)


def brute(vectors, dim):
    """Whole-number means and deviations of the distinct grid vectors, and a dense eigendecomposition."""
    kept = [(i, tuple(on_grid(v))) for i, v in vectors if usable(v, dim)]
    fitted = sorted({x for _, x in kept})
    n = len(fitted)
    sums = [sum(x[k] for x in fitted) for k in range(dim)]
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in fitted}
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fitted])
    values, vectors_ = np.linalg.eigh(y.T @ y / n)
    return kept, n, sums, deviation, values[::-1], vectors_[:, ::-1]


def check(rows, vectors, dim, wanted):
    kept, n, sums, deviation, values, components = brute(vectors, dim)
    got = [r.asDict() for r in rows.collect()]
    assert len(got) == len(kept) * wanted
    assert {r["n"] for r in got} == {n}
    order = lambda v: (v is None, v)
    for k in range(wanted):
        mine = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1), key=lambda r: tuple(map(order, r)))
        true = []
        for i, x in kept:
            y = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
            true.append((i, deviation[x], float(y @ components[:, k] / math.sqrt(values[k]))))
        sign = np.sign(sum(t[2] * m[2] for t, m in zip(sorted(true, key=lambda r: order(r[0])), mine, strict=True))) if len({i for i, _ in kept}) == len(kept) else 0
        sides = [sorted(((i, d, s * w) for i, d, w in true), key=lambda r: tuple(map(order, r))) for s in ([sign] if sign else [1, -1])]
        assert any(
            all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(mine, side, strict=True)) for side in sides
        ), k
    for r in got:
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
        assert 0 <= r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in rows.select("vec_id", "embedding").collect()]
    check(queries.op11_whitening(spark, sf), vectors, 64, 16)


def awkward(dim=5):
    rng = np.random.default_rng(3)
    spread = np.array([9.0, 5.0, 3.0, 1.0, 0.5])[:dim]
    vectors = [(k, (rng.standard_normal(dim) * spread).tolist()) for k in range(60)]
    vectors += [(None, vectors[3][1]), (3, vectors[3][1]), (100, vectors[4][1]), (101, [-0.0] * dim), (102, [0.0] * dim)]
    return vectors, [(103, None), (104, []), (105, [1.0] * (dim - 1)), (106, [1.0, None, 2.0, 3.0, 4.0]), (107, [float("nan")] * dim), (108, [float("inf")] * dim), (109, [1e300] * dim)]


def test_awkward_rows(spark):
    good, bad = awkward()
    check(whitening.whiten(table(spark, good + bad)), good, 5, 5)
    check(whitening.whiten(table(spark, good + bad), components=2), good, 5, 2)


def test_deviations_are_exact_beyond_doubles_and_null_beyond_longs(spark):
    vectors = [(0, [1e6, 3e5]), (1, [2e6, -1e6]), (2, [4e6, 5.0]), (3, [4e6 + 1, 0.25])]
    check(whitening.whiten(table(spark, vectors)), vectors, 2, 2)
    far = whitening.whiten(table(spark, [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 7.0])])).collect()
    assert far and {r["deviation"] for r in far if r["vec_id"] != 2} == {None}


def test_nothing_to_fit(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(table(spark, vectors))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_vectors_that_span_less(spark):
    rng = np.random.default_rng(5)
    plane = np.array([[1.0, 2.0, 3.0, 4.0], [2.0, -1.0, 0.0, 1.0]])
    vectors = [(k, (rng.integers(-9, 9, 2) @ plane).tolist()) for k in range(40)]
    check(whitening.whiten(table(spark, vectors)), vectors, 4, 2)


@pytest.mark.parametrize("dim,wanted", [(40, 3), (7, 16), (30, 30)])
def test_lanczos_finds_the_largest(dim, wanted):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    true = np.sort(np.concatenate([[50.0, 50.0, 20.0], rng.random(dim - 3)]))[::-1]
    a = (q * true) @ q.T
    values, vectors, passes = whitening.lanczos(lambda b: a @ b, dim, wanted)
    k = min(dim, wanted)
    assert np.allclose(values, true[:k], rtol=0, atol=1e-11)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11
    assert passes <= -(-dim // k)


def test_lanczos_restarts_where_a_block_loses_rank():
    a = np.diag([4.0, 4.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    values, vectors, _ = whitening.lanczos(lambda b: a @ b, 8, 5)
    assert np.allclose(values, [4, 4, 4, 0, 0]) and np.allclose(vectors.T @ vectors, np.eye(5))
    rng = np.random.default_rng(0)
    block, lost = whitening.orthogonal(np.ones((8, 3)), np.zeros((8, 0)), lambda: rng.standard_normal(8))
    assert lost >= 1 and np.allclose(block.T @ block, np.eye(block.shape[1]))


def test_sums_reach_the_driver_as_one_matrix(spark):
    from newsdesk.llm.vectors import matrix, summed

    rows = spark.range(0, 5000, 1, 16).select(F.array(F.col("id"), (F.col("id") * 2)).alias("x"))
    got = summed(rows, lambda b: matrix(b.column("x")).sum(axis=0)[:, None], 1, whole=True)
    assert got == {0: [4999 * 2500], 1: [4999 * 5000]}
