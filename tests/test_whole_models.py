"""The registered model queries run the operators' whole job."""

from types import SimpleNamespace

import numpy as np
from pyspark.ml.functions import vector_to_array

from careshed.queries import models as qm
from careshed.queries import registry
from careshed.queries import spatial as qs


def test_trees_and_ablation_run_whole(monkeypatch):
    calls = {}
    monkeypatch.setattr(qm, "_fit", lambda v, fit: fit)
    assert (qm.m5(None), qm.m6(None), qm.m7(None)) == (qm.m.forest, qm.m.boosted, qm.m.boosted_sampled)
    monkeypatch.setattr(qs.cv, "climate_ablation", lambda facility, cell, mode, config=qs.cv.CoverageConfig(): calls.update(areas=config.max_areas))
    qs.o14(SimpleNamespace(stored_facility=None, cell=None))
    assert calls["areas"] == 22


def test_kmeans_restarts_on_standardised_vectors(spark, monkeypatch):
    seen = {}

    def kmeans(rows, features="features", k=8, restarts=20, seed=42):
        x = np.array([r.x for r in rows.select(vector_to_array(features).alias("x")).collect()])
        seen.update(x=x, restarts=restarts, k=k)
        return SimpleNamespace(transform=lambda rows: rows.selectExpr("*", "0 AS prediction")), 0.0

    monkeypatch.setattr(qm.m, "kmeans", kmeans)
    base = spark.createDataFrame([(i, [float(i), 100.0 * (i % 3), float(i * i)]) for i in range(30)], "vec_id long, embedding array<double>")
    assert qm.m11(SimpleNamespace(base=lambda name: base)).count() == 30
    assert (seen["restarts"], seen["k"]) == (20, 8)
    assert np.allclose(seen["x"].mean(axis=0), 0) and np.allclose(seen["x"].std(axis=0, ddof=1), 1)


def test_board_best_models_and_ablation_run_unmocked(spark):
    """The registered queries themselves, with all fits, rounds and areas."""
    sf = "/root/testdata/sf0.001"
    queries = registry.queries()
    board = queries["m9_leaderboard"](spark, sf).collect()
    assert len({(r.feature_set, r.model) for r in board}) == len(board) == 25
    assert all(r.rmse > 0 and r.test_rmse > 0 for r in board)
    order = [r.r2 for r in board]
    assert order == sorted(order, reverse=True)
    best = queries["t4_best_models"](spark, sf).collect()
    assert [(r.feature_set, r.model) for r in best] == [(r.feature_set, r.model) for r in board[:10]]
    assert {r.climate_on for r in queries["o14_climate_ablation"](spark, sf).collect()} == {True, False}


def test_fits_side_by_side_equal_fits_in_turn(spark):
    rows = [(float(i % 7), float(i % 11), float(3 * (i % 7) - (i % 11) + i % 3), ("train", "val", "test")[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double, split string")
    few = {"ridge": qm.m.ridge, "boost": lambda train, val: qm.m.boosted(train, val, 5)}
    got = {(r.feature_set, r.model): r.rmse for r in qm.m.compare(df, {"a": ["a"], "ab": ["a", "b"]}, "y", few).collect()}
    for name, features in (("a", ["a"]), ("ab", ["a", "b"])):
        parts = [qm.m.assembled(qm.ft.standardise(df.where("split = 'train'"), df.where(f"split = '{s}'"), features), features, "y").select("features", "label").coalesce(1) for s in ("train", "val")]
        for model, fit in few.items():
            assert np.isclose(got[name, model], fit(*parts).metrics["rmse"])
