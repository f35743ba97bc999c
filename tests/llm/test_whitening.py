"""Digit products against Python's integers, whitening against the definition."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from sparkveil.llm import whitening
from sparkveil.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<double>, component string, x int, `a.b` string"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def table(spark, rows):
    return spark.createDataFrame([(k, v, "c", 1, "d") for k, v in rows], SCHEMA)


def held_against(rows, found, scale=256, components=4):
    """Check whitened rows against integers and exact covariances of the definition."""
    width = max(len(v) for _, v in rows)
    whole = [(k, [math.floor(scale * c) for c in v] + [0] * (width - len(v))) for k, v in rows]
    fit = sorted({tuple(x) for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], object)
    cov = np.array([[Fraction(int(c), n**3) for c in row] for row in y.T @ y], object)
    trace = sum(cov.diagonal())
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["deviation"], r["component"]), []).append(r)
    assert len(found) == len(rows) * components
    axes = {}
    for k, x in whole:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for c in range(1, components + 1):
            r = by[k, deviation, c][0]
            assert r["n"] == n and r["identity_error"] <= 1e-4
            axes.setdefault(c, {})[tuple(x)] = r["whitened"]
    centred = np.array([[float(Fraction(int(c), n)) for c in row] for row in y])
    for c in range(1, components + 1):
        w = np.array([axes[c][x] for x in fit])
        value = by[whole[0][0], sum((n * a - s) ** 2 for a, s in zip(whole[0][1], sums, strict=True)), c][0]["explained"]
        # w = centred @ v / sqrt(e): v is found back by least squares, and must be a unit eigenvector for e
        e = value * float(trace)
        v, *_ = np.linalg.lstsq(centred, w * math.sqrt(e), rcond=None)
        exact = [sum(a * Fraction(float(b)) for a, b in zip(row, v, strict=True)) for row in cov]
        rayleigh = sum(a * Fraction(float(b)) for a, b in zip(exact, v, strict=True)) / sum(Fraction(float(b)) ** 2 for b in v)
        assert float(rayleigh) == pytest.approx(e, rel=1e-6)
        for d in range(1, c + 1):
            other = np.array([axes[d][x] for x in fit])
            assert np.mean((w - w.mean()) * (other - other.mean())) == pytest.approx(float(c == d), abs=1e-4)
    return [by[k][0]["explained"] for k in list(by)[:components]]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for high in (5, 1 << 21, 1 << 40, (1 << 61) - 1):
        a, b = rng.integers(-high, high, (7, 9)), rng.integers(-high, high, (9, 5))
        want = a.astype(object) @ b.astype(object)
        assert (whitening.product(a, b) == want).all() and (whitening.product(a.astype(object), b.astype(object)) == want).all()
        total = whitening.Total()
        whitening.add_gram(total, a)
        assert (total.value() == a.T.astype(object) @ a.astype(object)).all()
        assert whitening.squares(a) == [sum(int(c) ** 2 for c in row) for row in a]


def test_full_blocks_of_extreme_digits_stay_exact():
    y = np.full((whitening.BLOCK_ROWS, 2), (1 << 39) - (1 << 19), np.int64)
    y[:, 1] = -y[:, 0]
    total = whitening.Total()
    for _ in range(3):
        whitening.add_gram(total, y)
    one = 3 * whitening.BLOCK_ROWS * int(y[0, 0]) ** 2
    assert total.value().tolist() == [[one, -one], [-one, one]]


def test_transport_of_big_integers(spark):
    values = {(0, 0): 1 << 150, (1, 0): -(3**90), (2, 1): 5, (3, 3): -1, (4, 0): 0}
    rows = [r for b in whitening._sums((i, j, v) for (i, j), v in values.items()) for r in b.to_pylist()]
    parts = spark.createDataFrame(rows * 3, whitening.SUMS)
    assert dict(whitening._gathered(parts)) == {k: 3 * v for k, v in values.items() if v}


def test_whitening_holds_the_definition(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [4, 2, 1, 1, 0.5, 0.1]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(None, [1.0] * 6), (7000, [1.0, 2.0]), (7001, []), (7002, [-0.0] * 6)]
    bad = [(1, None), (2, [None] * 6), (3, [1.0, math.nan] + [0.0] * 4), (4, [math.inf] + [0.0] * 5)]
    df = whitening.whiten(table(spark, rows + bad).repartition(5))
    assert df.columns == NAMES
    held_against(rows, df.collect())


def test_eigenvalues_far_apart_keep_their_digits(spark):
    rng = np.random.default_rng(6)
    mix = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    rows = [(i, ((rng.normal(size=5) * [3e7, 1, 1, 1, 1]) @ mix).tolist()) for i in range(200)]
    df = whitening.whiten(table(spark, rows))
    held_against(rows, df.collect())


def test_large_integers(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) * 1e14).tolist()) for i in range(50)]
    found = whitening.whiten(table(spark, rows)).collect()
    held_against(rows, found, components=3)
    found = whitening.whiten(table(spark, [(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [1e15, 1.0])])).collect()
    assert {r["vec_id"] for r in found} == {1, 2, 3} and all(r["identity_error"] <= 1e-4 for r in found)


def test_flat_and_empty(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 5 and all(r["explained"] == 1.0 for r in line)
    with pytest.raises(ValueError, match="max_width"):
        whitening.whiten(table(spark, [(1, [0.0] * 9)]), whitening.Params(max_width=8))


def test_query_holds_the_definition(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = op12_whitening(spark, sf_dir)
    assert dict(df.dtypes)["deviation"] == "bigint"
    explained = held_against(rows, df.collect())
    x = np.array(sorted({tuple(np.floor(256 * np.array(v, float))) for _, v in rows}))
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert explained == pytest.approx((e / e.sum())[:4], rel=1e-4)
