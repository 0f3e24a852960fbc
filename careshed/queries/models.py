"""Queries that fit and score models on the weekly panel, and on the embeddings."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from careshed.operators import features as ft
from careshed.operators import models as m
from careshed.plans.modelling import compare_models
from careshed.queries import features as q
from careshed.queries.registry import query

H = q.H
NAMES = ["p_total", "p_mean", "t_max", "t_mean", "wetday_frac", "p_max"]


def _panel(v):
    return q.split(v)


def _fit(v, fit):
    rows = ft.lagged(_panel(v), "cases", "hsa_id", "week_start", "split").dropna(subset=["cases_lag1", "cases_lag2"])
    columns = ["cases_lag1", "cases_lag2", *NAMES]
    train = rows.where("split = 'train'")
    train, val = (m.fitted_parts(m.assembled(ft.standardise(train, rows.where(f"split = '{s}'"), columns), columns, "cases").select("features", "label")) for s in ("train", "val"))
    f = fit(train, val)
    for x in (train, val):
        x.unpersist()
    return v.spark.createDataFrame([(f.name, f.alpha, f.metrics["rmse"], f.metrics["mae"], f.metrics["r2"])], "model string, alpha double, rmse double, mae double, r2 double")


@query("m2_feature_sets", "SELECT 'AR_only' AS feature_set, 2 AS n UNION ALL SELECT 'AR_temporal', 5 UNION ALL SELECT 'AR_top5', 7 UNION ALL SELECT 'AR_top10', CAST(2 + (SELECT count(*) FROM cr WHERE r IS NOT NULL) AS INT) UNION ALL SELECT 'AR_temporal_top5', 10", H)
def m2(v):
    top, rest = ft.ranked_features(ft.target_correlation(v.panel, "cases", q.FEATURES))
    sets = m.feature_sets(["week_of_year", "month", "days_since_start"], top, ["cases_lag1", "cases_lag2"], rest)
    return v.spark.createDataFrame([(k, len(f)) for k, f in sets.items()], "feature_set string, n int")


@query("m3_ridge")
def m3(v):
    return _fit(v, m.ridge)


@query("m4_lasso")
def m4(v):
    return _fit(v, m.lasso)


@query("m5_random_forest")
def m5(v):
    return _fit(v, m.forest)


@query("m6_gradient_boosting")
def m6(v):
    return _fit(v, m.boosted)


@query("m7_boosting_sampled")
def m7(v):
    return _fit(v, m.boosted_sampled)


@query("m8_metrics", "SELECT split, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT split, CAST(cases AS DOUBLE) AS y, cases - lag(cases) OVER (PARTITION BY hsa_id ORDER BY week_start) AS e FROM sp) z WHERE e IS NOT NULL GROUP BY split", H)
def m8(v):
    rows = ft.lagged(_panel(v), "cases", "hsa_id", "week_start", lags=(1,))
    return m.errors(rows, F.col("cases"), F.col("cases_lag1"), "split")


_BOARDS: dict[tuple[str, str], tuple] = {}


def _board(v):
    """The board of all models on all feature sets: its 25 rows are fitted once for an application and a folder of tables."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _BOARDS:
        board = compare_models(_panel(v), q.FEATURES, "hsa_id", "week_start", "cases")
        _BOARDS[key] = (board.collect(), board.schema)
    return v.spark.createDataFrame(*_BOARDS[key])


@query("m9_leaderboard")
def m9(v):
    return _board(v)


@query("m10_baselines", "SELECT model, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM (SELECT 'mean' AS model, CAST(cases AS DOUBLE) AS y, (SELECT avg(cases) FROM sp WHERE split = 'train') AS p FROM sp WHERE split = 'val' UNION ALL SELECT 'seasonal', CAST(s.cases AS DOUBLE), coalesce(w.p, (SELECT avg(cases) FROM sp WHERE split = 'train')) FROM sp s LEFT JOIN (SELECT week_of_year, avg(cases) AS p FROM sp WHERE split = 'train' GROUP BY week_of_year) w ON w.week_of_year = s.week_of_year WHERE s.split = 'val' UNION ALL SELECT 'last_week', CAST(cases AS DOUBLE), p FROM (SELECT *, lag(cases) OVER (PARTITION BY hsa_id ORDER BY week_start) AS p FROM sp) l WHERE split = 'val') z WHERE p IS NOT NULL GROUP BY model", H)
def m10(v):
    return m.baselines(_panel(v), "cases", "hsa_id", "week_start")


@query("t4_best_models")
def t4(v):
    return m.leaderboard(_board(v), 10)


def _vectors(v):
    return v.base("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def _standardised(v):
    rows = _vectors(v)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows)
    return scaler.transform(rows).select("vec_id", F.col("scaled").alias("features"))


@query("m11_kmeans")
def m11(v):
    rows = _standardised(v)
    model, _ = m.kmeans(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query("m12_pca", places=4)
def m12(v):
    """Each vector on the two components, whose signs are free, with the share of variance that each explains."""
    rows = _standardised(v)
    model = m.principal_components(rows)
    first, second = model.explainedVariance.toArray().tolist()
    at = vector_to_array("components")
    return model.transform(rows).select("vec_id", at[0].alias("pc1"), at[1].alias("pc2"), F.lit(float(first)).alias("share1"), F.lit(float(second)).alias("share2"))
