"""Blocked moments and exact quantiles against numpy, with small blocks and ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest

from careshed.operators import features as ft
from careshed.operators import moments as mo


def pairwise(rows, p):
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(-1, p)
    out = {}
    for i in range(p):
        for j in range(i + 1, p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            out[i, j] = None if not both.any() or a.min() == a.max() or b.min() == b.max() else float(np.corrcoef(a, b)[0, 1])
    return out


def check(got, want):
    assert set(got) == set(want)
    for key, r in want.items():
        assert (got[key] is None) == (r is None), key
        assert r is None or got[key] == pytest.approx(r, abs=1e-9)


@pytest.mark.parametrize("block", [2, 128])
def test_correlations_with_nulls_and_constants(spark, monkeypatch, block):
    monkeypatch.setattr(mo, "BLOCK", block)
    monkeypatch.setattr(mo, "BLOCKS", 3)
    rng = random.Random(1)
    rows = []
    for k in range(200):
        a = rng.gauss(1e6, 1)
        rows.append((a, a * 2 if k % 3 else None, 7.0, rng.random() if k % 5 else None, None, float(k % 3 == 0), -a + rng.gauss(0, 0.1), 1.0 if k % 5 else float(k)))
    df = spark.createDataFrame(rows, "a double, `b.x` double, c double, d double, e double, f double, g double, h double")
    got = {(r.i, r.j): r.r for r in mo.correlations(df, df.columns).collect()}
    check(got, pairwise(rows, 8))
    named = ft.correlation_matrix(df.withColumnRenamed("b.x", "b"), ["a", "b", "c"]).collect()
    assert sorted((r["left"], r["right"]) for r in named) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_correlations_of_empty_tables_and_many_columns(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [(r.i, r.j, r.r) for r in mo.correlations(empty, ["a", "b"]).collect()] == [(0, 1, None)]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 400))
    x[:, 7] = x[:, 3] * -2
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(400)))
    got = {(r.i, r.j): r.r for r in mo.correlations(df, df.columns).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 400 * 399 // 2 and max(abs(r - want[k]) for k, r in got.items()) < 1e-9


@pytest.mark.parametrize(("ranges", "finish"), [(4, 3), (1024, 100_000)])
def test_exact_quantiles(spark, monkeypatch, ranges, finish):
    monkeypatch.setattr(mo, "RANGES", ranges)
    monkeypatch.setattr(mo, "FINISH", finish)
    rng = random.Random(3)
    values = [rng.choice((rng.gauss(0, 1), rng.expovariate(1e-6), 5.0, 5.0, 5.0, None, float("nan"))) for _ in range(400)] + [1e-300, -1e300]
    rows = [(i % 3 if i % 7 else None, v, float(i), 2.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v double, w double, flat double")
    shares = [0.0, 0.2, 0.5, 0.95, 1.0]
    got = {(r.column, r.share): r.value for r in mo.exact_quantiles(df, ["v", "w", "flat"], shares).collect()}
    real = [v for v in values if v is not None and v == v]
    for q in shares:
        assert got["v", q] == pytest.approx(np.quantile(real, q), rel=1e-12)
        assert got["w", q] == pytest.approx(np.quantile([r[2] for r in rows], q)) and got["flat", q] == 2.0
    own = {(r.g, r.share): r.value for r in mo.exact_quantiles(df.where("g IS NOT NULL"), ["v"], [0.5], "g").collect()}
    for g in range(3):
        assert own[g, 0.5] == pytest.approx(np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]], 0.5))
    assert mo.exact_quantiles(df.limit(0), ["v"], [0.5]).count() == 0


def test_sketched_quantiles_keep_their_error(spark):
    df = spark.range(100_001).selectExpr("cast(id as double) AS v")
    for r in mo.sketched_quantiles(df, ["v"], [0.1, 0.5, 0.9], 1e-3).collect():
        assert abs(r.value / 100_001 - r.share) <= 1e-3 + 1 / 100_001
