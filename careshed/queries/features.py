"""Queries over the weekly panel: modelling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from careshed.operators import features as ft
from careshed.plans.modelling import modelling_table
from careshed.queries.registry import query
from careshed.sources.files import drop_bookkeeping

FEATURES = ["p_total", "p_mean", "t_max", "t_mean", "wetday_frac", "p_max", "flat"]
SEASON = "CASE WHEN month(week_start) IN (12, 1, 2) THEN 'Winter' WHEN month(week_start) IN (3, 4, 5) THEN 'Spring' WHEN month(week_start) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"
CORR = "CASE WHEN min({a}) < max({a}) THEN corr({a}, CAST({b} AS DOUBLE)) END"
H = {
    "tp": f"SELECT *, weekofyear(week_start) AS week_of_year, month(week_start) AS month, quarter(week_start) AS quarter, {SEASON} AS season, datediff('day', (SELECT min(week_start) FROM v_panel), week_start) AS days_since_start, row_number() OVER (PARTITION BY hsa_id ORDER BY week_start) AS week_number FROM v_panel",
    "sp": "SELECT *, CASE WHEN week_number <= 200 THEN 'train' WHEN week_number <= 260 THEN 'val' ELSE 'test' END AS split FROM tp",
    "cr": " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ord, {CORR.format(a=c, b='cases')} AS r FROM v_panel" for i, c in enumerate(FEATURES)),
    "mx": " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS \"left\", '{b}' AS \"right\", CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END AS r FROM v_panel" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j),
}


def temporal(v):
    return ft.temporal(v.panel, "hsa_id", "week_start")


def split(v):
    return ft.temporal_split(temporal(v), train_to=200, val_to=260)


@query("s6_drop_columns", "SELECT hsa_id, week_start, cases FROM v_panel", H)
def s6(v):
    return drop_bookkeeping(v.panel.select("hsa_id", "week_start", "cases", F.lit("x").alias("system:index"), F.lit("y").alias(".geo")))


@query("j2_totals", "SELECT f.facility_id, f.climate_k, coalesce(c.n, 0) AS total FROM v_facility f LEFT JOIN (SELECT facility_id, count(*) AS n FROM v_visit WHERE value > 90.0E0 GROUP BY facility_id) c ON c.facility_id = f.facility_id", H)
def j2(v):
    totals = v.visit.where("value > 90.0").groupBy("facility_id").agg(F.count("*").alias("total"))
    return ft.with_counts(v.facility.select("facility_id", "climate_k"), totals, ["facility_id"], "total")


@query("j3_merge_families", "SELECT hsa_id, week_start, max(p_total) AS p_total, round(max(t_max), 6) AS t_max, round(max(wetday_frac), 6) AS wetday_frac FROM (SELECT hsa_id, week_start, round(p_total, 6) AS p_total, NULL AS t_max, NULL AS wetday_frac FROM v_panel WHERE hsa_id % 3 <> 0 UNION ALL SELECT hsa_id, week_start, NULL, t_max, NULL FROM v_panel WHERE hsa_id % 3 <> 1 UNION ALL SELECT hsa_id, week_start, NULL, NULL, wetday_frac FROM v_panel WHERE hsa_id % 3 <> 2) q GROUP BY hsa_id, week_start", H)
def j3(v):
    keys = ["hsa_id", "week_start"]
    p = v.panel
    return ft.merge_families([p.where("hsa_id % 3 <> 0").select(*keys, "p_total"), p.where("hsa_id % 3 <> 1").select(*keys, "t_max"), p.where("hsa_id % 3 <> 2").select(*keys, "wetday_frac")], keys)


@query("j4_with_counts", "SELECT hsa_id, week_start, round(p_total, 6) AS p_total, CASE WHEN cases > 20 THEN cases ELSE 0 END AS cases FROM v_panel", H)
def j4(v):
    return ft.with_counts(v.panel.select("hsa_id", "week_start", "p_total"), v.panel.where("cases > 20"), ["hsa_id", "week_start"], "cases")


@query("u1_union_areas", "SELECT hsa_id, week_start, round(p_total, 6) AS p_total, NULL::DOUBLE AS t_max FROM v_panel WHERE hsa_id < 9 UNION ALL SELECT hsa_id, week_start, NULL, round(t_max, 6) FROM v_panel WHERE hsa_id >= 9", H)
def u1(v):
    return ft.union_areas([v.panel.where("hsa_id < 9").select("hsa_id", "week_start", "p_total"), v.panel.where("hsa_id >= 9").select("hsa_id", "week_start", "t_max")])


@query("p7_temporal", "SELECT hsa_id, week_start, CAST(week_of_year AS INT) AS week_of_year, CAST(month AS INT) AS month, CAST(quarter AS INT) AS quarter, season FROM tp", H)
def p7(v):
    return temporal(v).select("hsa_id", "week_start", "week_of_year", "month", "quarter", "season")


@query("p8_days_since_start", "SELECT hsa_id, week_start, CAST(days_since_start AS INT) AS days_since_start FROM tp", H)
def p8(v):
    return temporal(v).select("hsa_id", "week_start", "days_since_start")


@query("w2_week_number", "SELECT hsa_id, week_start, CAST(week_number AS INT) AS week_number FROM tp", H)
def w2(v):
    return temporal(v).select("hsa_id", "week_start", "week_number")


@query("p9_interactions", "SELECT hsa_id, week_start, round(t_mean * p_total, 6) AS temp_x_rain, CAST(t_max > 35 AS INT) AS extreme_heat, CAST(p_total > 10 AS INT) AS heavy_rain, round(CASE WHEN t_max > 35 THEN 1 - wetday_frac ELSE 0 END, 6) AS dry_heat FROM v_panel", H)
def p9(v):
    return ft.interactions(v.panel, "hsa_id", "week_start").select("hsa_id", "week_start", "temp_x_rain", "extreme_heat", "heavy_rain", "dry_heat")


@query("w9_rain_4w", "SELECT hsa_id, week_start, round(CASE WHEN count(p_total) OVER w = 4 THEN sum(p_total) OVER w END, 6) AS rain_4w FROM v_panel WINDOW w AS (PARTITION BY hsa_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", H)
def w9(v):
    return ft.interactions(v.panel, "hsa_id", "week_start").select("hsa_id", "week_start", "rain_4w")


@query("p14_one_hot", "SELECT hsa_id, week_start, CAST(season = 'Spring' AS INT) AS season_Spring, CAST(season = 'Summer' AS INT) AS season_Summer, CAST(season = 'Winter' AS INT) AS season_Winter FROM tp", H)
def p14(v):
    return ft.one_hot(temporal(v).select("hsa_id", "week_start", "season"), "season", ["Winter", "Spring", "Summer", "Fall"]).drop("season")


@query("p15_impute", "SELECT hsa_id, week_start, round(coalesce(CASE WHEN hsa_id % 4 <> 0 THEN p_total END, (SELECT median(p_total) FROM v_panel WHERE hsa_id % 4 <> 0)), 6) AS p_total FROM v_panel", H)
def p15(v):
    return ft.impute_median(v.panel.select("hsa_id", "week_start", F.when(F.col("hsa_id") % 4 != 0, F.col("p_total")).alias("p_total")), ["p_total"])


@query("p16_standardise", "SELECT hsa_id, week_start, round((t_mean - (SELECT avg(t_mean) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(t_mean) FROM sp WHERE split = 'train'), 5) AS t_mean, round((p_mean - (SELECT avg(p_mean) FROM sp WHERE split = 'train')) / (SELECT stddev_pop(p_mean) FROM sp WHERE split = 'train'), 5) AS p_mean FROM sp", H, 5)
def p16(v):
    s = split(v)
    return ft.standardise(s.where("split = 'train'"), s.select("hsa_id", "week_start", "t_mean", "p_mean"), ["t_mean", "p_mean"])


@query("p18_missing", "SELECT 'p_total' AS feature, count(*) FILTER (hsa_id % 5 = 0) AS n_missing FROM v_panel UNION ALL SELECT 't_max', count(*) FILTER (hsa_id % 7 = 0) FROM v_panel", H)
def p18(v):
    holes = v.panel.select(F.when(F.col("hsa_id") % 5 != 0, F.col("p_total")).alias("p_total"), F.when(F.col("hsa_id") % 7 != 0, F.col("t_max")).alias("t_max"))
    return ft.missing_report(holes, ["p_total", "t_max"])


@query("p18_complete_rows", "SELECT hsa_id, count(*) AS n FROM v_panel WHERE hsa_id % 5 <> 0 AND hsa_id % 7 <> 0 GROUP BY hsa_id", H)
def p18_rows(v):
    holes = v.panel.select("hsa_id", F.when(F.col("hsa_id") % 5 != 0, F.col("p_total")).alias("p_total"), F.when(F.col("hsa_id") % 7 != 0, F.col("t_max")).alias("t_max"))
    return ft.complete_rows(holes, ["p_total", "t_max"]).groupBy("hsa_id").agg(F.count("*").alias("n"))


@query("p22_numeric_columns", "SELECT hsa_id, round(cases + p_total + p_mean + t_max + t_mean + wetday_frac + p_max + flat, 6) AS total FROM v_panel", H)
def p22(v):
    return v.panel.select("hsa_id", sum((F.col(c) for c in ft.numeric_columns(v.panel, {"hsa_id"})), F.lit(0)).alias("total"))


@query("a9_profile", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(coalesce(stddev_samp({c}), 0), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(median({c}), 6) AS median, count(*) FILTER ({c} = 0) AS zeros, round(100.0E0 * count(*) FILTER ({c} = 0) / count(*), 6) AS zero_pct, count(*) FILTER ({c} IS NULL) AS missing, round(100.0E0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_pct FROM v_panel" for c in ("cases", "p_total", "p_max")), H)
def a9(v):
    return ft.profile(v.panel, ["cases", "p_total", "p_max"])


@query("a11_target_correlation", "SELECT feature, ord, round(r, 6) AS r FROM cr", H)
def a11(v):
    return ft.target_correlation(v.panel, "cases", FEATURES)


@query("a12_correlation_matrix", 'SELECT i, j, "left", "right", round(r, 6) AS r FROM mx', H)
def a12(v):
    return ft.correlation_matrix(v.panel, FEATURES)


@query("a13_prune", " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ord WHERE '{c}' NOT IN (SELECT \"right\" FROM mx WHERE abs(r) > 0.8)" for i, c in enumerate(FEATURES)), H)
def a13(v):
    features = v.spark.createDataFrame([(c, i) for i, c in enumerate(FEATURES)], "feature string, ord int")
    return ft.prune_collinear(ft.correlation_matrix(v.panel, FEATURES), features, 0.8)


@query("t3_top_features", "SELECT feature, ord, round(r, 6) AS r FROM cr WHERE r IS NOT NULL ORDER BY abs(r) DESC, ord LIMIT 3", H)
def t3(v):
    return ft.top_features(ft.target_correlation(v.panel, "cases", FEATURES), 3)


@query("m1_split", "SELECT split, count(*) AS n, CAST(sum(cases) AS BIGINT) AS cases FROM sp GROUP BY split", H)
def m1(v):
    return split(v).groupBy("split").agg(F.count("*").alias("n"), F.sum("cases").alias("cases"))


@query("w3_target_lags", "SELECT hsa_id, week_start, split, lag(cases, 1) OVER w AS cases_lag1, lag(cases, 2) OVER w AS cases_lag2 FROM sp WINDOW w AS (PARTITION BY split, hsa_id ORDER BY week_start)", H)
def w3(v):
    return ft.lagged(split(v), "cases", "hsa_id", "week_start", "split").select("hsa_id", "week_start", "split", "cases_lag1", "cases_lag2")


@query("s15_metadata", "SELECT count(*) AS n_rows, 'cases' AS target, 2 AS n_features FROM v_panel", H)
def s15(v):
    doc = ft.metadata_json(v.panel, ["p_total", "t_max"], "cases").select(F.from_json("value", "n_rows LONG, target STRING, n_features INT").alias("d"))
    return doc.select("d.*")


#: The candidate features of the modelling table, in its order of columns.
CANDIDATES = ["p_total", "p_mean", "wetday_frac", "t_max", "t_mean", "p_max", "flat", "temp_x_rain", "extreme_heat", "heavy_rain", "rain_4w", "dry_heat"]
LONG = H | {
    "mt_wide": "SELECT *, t_mean * p_total AS temp_x_rain, CAST(t_max > 35 AS INT) AS extreme_heat, CAST(p_total > 10 AS INT) AS heavy_rain, CASE WHEN count(p_total) OVER w = 4 THEN sum(p_total) OVER w END AS rain_4w, CASE WHEN t_max > 35 THEN 1 - wetday_frac ELSE 0 END AS dry_heat FROM sp WINDOW w AS (PARTITION BY hsa_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "mt_long": "SELECT hsa_id, week_start, cases, split, f.feature AS feature, f.ord AS ord, f.value AS value FROM (SELECT hsa_id, week_start, cases, split, unnest([" + ", ".join(f"struct_pack(feature := '{c}', ord := {i}, value := CAST({c} AS DOUBLE))" for i, c in enumerate(CANDIDATES)) + "]) AS f FROM mt_wide) q",
    "mt_rank": "SELECT feature, row_number() OVER (ORDER BY abs(r) DESC, ord) AS place FROM (SELECT feature, any_value(ord) AS ord, CASE WHEN min(value) < max(value) AND min(cases) < max(cases) THEN corr(value, CAST(cases AS DOUBLE)) END AS r FROM mt_long WHERE value IS NOT NULL GROUP BY feature) q WHERE r IS NOT NULL",
    "mt_near": "SELECT DISTINCT b FROM (SELECT ka.feature AS a, kb.feature AS b, CASE WHEN min(la.value) < max(la.value) AND min(lb.value) < max(lb.value) THEN corr(la.value, lb.value) END AS r FROM mt_rank ka JOIN mt_rank kb ON ka.place < kb.place JOIN mt_long la ON la.feature = ka.feature JOIN mt_long lb ON lb.feature = kb.feature AND lb.hsa_id = la.hsa_id AND lb.week_start = la.week_start WHERE la.value IS NOT NULL AND lb.value IS NOT NULL GROUP BY ka.feature, kb.feature) q WHERE abs(r) > 0.95",
}


def _modelling(v):
    counts = v.panel.select("hsa_id", "week_start", "cases")
    families = [v.panel.select("hsa_id", "week_start", *cols) for cols in (("p_total", "p_mean", "wetday_frac"), ("t_max", "t_mean"), ("p_max", "flat"))]
    return modelling_table(families, counts, "hsa_id", "week_start", "cases", train_to=200, val_to=260)


@query("m13_modelling_table")
def m13(v):
    """Its feature columns are chosen by the data, which SQL cannot name: see m13_selected_values."""
    return _modelling(v)


@query("m13_selected_values", "SELECT m.hsa_id, m.week_start, m.cases, m.split, m.feature, round(m.value, 6) AS value FROM mt_long m JOIN mt_rank r ON r.feature = m.feature WHERE m.feature NOT IN (SELECT b FROM mt_near)", LONG)
def m13_values(v):
    """The modelling table with a row for each week and selected feature."""
    rows = _modelling(v)
    names = [c for c in CANDIDATES if c in rows.columns]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])).alias("f")
    return rows.select("hsa_id", "week_start", "cases", "split", values).select("hsa_id", "week_start", "cases", "split", "f.feature", "f.value")
