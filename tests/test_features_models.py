from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from careshed.operators import features as ft
from careshed.operators import models as m
from careshed.plans.modelling import compare_models, modelling_table
from careshed.queries import models as qm


def test_prune_counts_dropped_features_as_earlier(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=300)
    b = a + rng.normal(scale=0.2, size=300)
    c = b + rng.normal(scale=0.2, size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    features = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feature string, ord int")
    r = np.corrcoef([a, b, c])
    limit = (abs(r[0, 2]) + min(abs(r[0, 1]), abs(r[1, 2]))) / 2  # a-b and b-c are beyond it, a-c is not
    got = ft.prune_collinear(ft.correlation_matrix(df, ["a", "b", "c"]), features, float(limit))
    assert [x.feature for x in got.collect()] == ["a"]


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 3.0, 4.0), (1.0, 5.0, 6.0)], "flat double, y double, z double")
    got = {r.feature: r.r for r in ft.target_correlation(df, "y", ["flat", "z"]).collect()}
    assert got["flat"] is None
    assert got["z"] == pytest.approx(1.0)
    assert [r.feature for r in ft.top_features(ft.target_correlation(df, "y", ["flat", "z"]), 5).collect()] == ["z"]


def test_equal_correlations_keep_the_order_of_the_list(spark):
    """Their last digits come from the order in which rows were added up."""
    rows = [("dry", 3, 0.010898746891966828), ("rain", 1, 0.93), ("wet", 2, -0.010898746891960874), ("flat", 0, None), ("less", 4, 0.0108987)]
    r = spark.createDataFrame(rows, "feature string, ord int, r double")
    assert [x.feature for x in ft.top_features(r, 2).collect()] == ["rain", "wet"]
    assert [x.feature for x in ft.top_features(r, 9).collect()] == ["rain", "wet", "dry", "less"]


def test_a_feature_and_its_complement_leave_the_first(spark):
    """dry_heat is 1 - wetday_frac where every week is hot, so one of the two goes: the later one, whichever |r| is larger."""
    for seed in range(2):
        rng = np.random.default_rng(seed)
        weeks = [(k % 3, f"2024-{1 + k // 84:02d}-{1 + k // 3 % 28:02d}", int(rng.integers(1, 9)), float(rng.integers(1, 99)) / 100) for k in range(300)]
        df = spark.createDataFrame(weeks, "area int, week string, cases int, wetday_frac double").withColumn("week", F.to_date("week"))
        df = df.withColumn("t_max", F.lit(40.0)).coalesce(1)
        table = modelling_table([df.select("area", "week", "wetday_frac", "t_max")], df.select("area", "week", "cases"), "area", "week", "cases")
        assert "wetday_frac" in table.columns and "dry_heat" not in table.columns


def test_the_best_five_are_five_where_columns_are_constant(spark):
    rows = [(k, k % 7, float(k % 5), float(k % 3), 40.0, float(k % 4), float(k % 6), 50.0, 1.0) for k in range(60)]
    panel = spark.createDataFrame(rows, "hsa_id int, cases int, p_total double, p_mean double, t_max double, t_mean double, wetday_frac double, p_max double, flat double")
    got = {r.feature_set: r.n for r in qm.m2(SimpleNamespace(panel=panel, spark=spark)).collect()}
    assert got == {"AR_only": 2, "AR_temporal": 5, "AR_top5": 7, "AR_top10": 6, "AR_temporal_top5": 10}  # as the SQL has it
    assert m.feature_sets([], ["a"], ["l"], ["b", "c", "d", "e", "f"])["AR_top5"] == ["l", "a", "b", "c", "d", "e"]
    assert m.feature_sets([], ["a"], ["l"], ["b"])["AR_top10"] == ["l", "a"]


def test_models_are_fitted_with_constant_features_and_without_empty_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(a, w, int(rng.integers(0, 30)), ("train", "val", "test")[w // 20], "Fall", w, w // 5, w * 7, 40.0, None, float(rng.normal())) for a in range(3) for w in range(60)]
    panel = spark.createDataFrame(rows, "area int, week int, cases int, split string, season string, week_of_year int, month int, days_since_start int, hot double, none double, x double")
    board = compare_models(panel, ["hot", "none", "x"], "area", "week", "cases", {"ridge": m.ridge})
    assert {r.feature_set: r.n_features for r in board.collect()} == {"AR_only": 2, "AR_temporal": 5, "AR_top5": 4, "AR_top10": 3, "AR_temporal_top5": 7}
    assert all(r.rmse > 0 and r.test_rmse > 0 for r in board.collect())


def test_lags_stay_inside_their_split(spark):
    df = spark.createDataFrame([("train", 1, w, w * 10) for w in (1, 2)] + [("val", 1, 3, 30)], "split string, area int, week int, y int")
    got = {r.week: r.y_lag1 for r in ft.lagged(df, "y", "area", "week", "split").collect()}
    assert got == {1: None, 2: 10, 3: None}


def test_merge_keeps_the_first_familys_column(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, x int")
    b = spark.createDataFrame([(2, 99, 5), (3, 98, 6)], "k int, x int, y int")
    assert sorted(tuple(r) for r in ft.merge_families([a, b], ["k"]).collect()) == [(1, 10, None), (2, 20, 5), (3, None, 6)]


def test_splits_partition_the_weeks(spark):
    got = ft.temporal_split(spark.range(1, 31).withColumnRenamed("id", "week_number")).groupBy("split").count()
    assert {r.split: r["count"] for r in got.collect()} == {"train": 18, "val": 4, "test": 8}


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([2.0, -1.0, 0.5]) + rng.normal(scale=0.3, size=200) + 4
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    z = ft.standardise(df, df, ["a", "b", "c"])
    return x, y, m.assembled(z, ["a", "b", "c"], "y").cache()


def test_ridge_is_the_closed_form(regression):
    x, y, rows = regression
    z = (x - x.mean(0)) / x.std(0)
    for alpha in (0.01, 10.0):
        fit = m.ridge(rows, rows, (alpha,))
        expected = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
        assert np.allclose(fit.model.coefficients.toArray(), expected, atol=1e-8)


def test_lasso_meets_its_conditions(regression):
    x, y, rows = regression
    z = (x - x.mean(0)) / x.std(0)
    w = m.lasso(rows, rows, (0.1,)).model.coefficients.toArray()
    grad = z.T @ (y - y.mean() - z @ w) / len(y)
    assert np.allclose(grad[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-4)


def test_trees_repeat_and_beat_the_mean(regression):
    _, _, rows = regression
    one, two = m.forest(rows, rows, 5), m.forest(rows, rows, 5)
    assert one.metrics == two.metrics
    assert one.metrics["r2"] > 0.5
    assert m.boosted(rows, rows, 5).metrics["r2"] > 0.2
    assert m.boosted_sampled(rows, rows, 5).metrics["r2"] > 0.2


def test_errors_ignore_missing_and_constant_targets(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 3.0)], "y double, p double")
    r = m.errors(df, F.col("y"), F.col("p")).first()
    assert (r.n, r.mae, r.r2) == (2, 0.5, None)


def test_kmeans_takes_the_cheapest_restart(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([([float(i % 3) * 10 + (i % 5) / 10, float(i % 3)],) for i in range(60)], "v array<double>").select(array_to_vector("v").alias("features"))
    _, best = m.kmeans(rows, k=3, restarts=4)
    _, first = m.kmeans(rows, k=3, restarts=1)
    assert best <= first
    assert m.principal_components(rows).explainedVariance.toArray()[0] > 0.9
