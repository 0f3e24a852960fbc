"""Queries over hourly and daily climate."""

from __future__ import annotations

from pyspark.sql import functions as F

from careshed.functions import scalars as sc
from careshed.operators import climate as cl
from careshed.operators import spatial as sp
from careshed.operators.coverage import highest_volume
from careshed.queries.registry import query

H = {
    "hd": "SELECT hsa_id, CAST(ts AS DATE) AS obs_day, avg(t_k - 273.15E0) AS t_mean, min(t_k - 273.15E0) AS t_min, max(t_k - 273.15E0) AS t_max, max(t_k - 273.15E0) - min(t_k - 273.15E0) AS dtr, CAST(sum(CASE WHEN t_k - 273.15E0 > 30 THEN 1 ELSE 0 END) AS BIGINT) AS hours_above_30, CAST(sum(CASE WHEN t_k - 273.15E0 > 35 THEN 1 ELSE 0 END) AS BIGINT) AS hours_above_35, avg(td_k - 273.15E0) AS td_mean, avg(t_k - 273.15E0) + 0.4E0 * (avg(td_k - 273.15E0) - avg(t_k - 273.15E0)) AS heat_index, sqrt(avg(u10) * avg(u10) + avg(v10) * avg(v10)) AS wind, avg(lhf) * 86400.0E0 / 2.45e6 AS evap_mm FROM v_hourly GROUP BY ALL",
    "wk": "SELECT hsa_id, CAST(date_trunc('week', obs_day) AS DATE) AS week_start, avg(precip_mm) AS p_mean, sum(precip_mm) AS p_total, max(precip_mm) AS p_max_day, avg(CASE WHEN precip_mm > 1 THEN 1.0E0 ELSE 0.0E0 END) AS wetday_frac, CAST(sum(CASE WHEN precip_mm > 10 THEN 1 ELSE 0 END) AS BIGINT) AS heavy_days, quantile_cont(precip_mm, 0.95) AS p95 FROM v_daily GROUP BY ALL",
}


def r(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


@query("p11_units", "SELECT hsa_id, ts, round(t_k - 273.15E0, 6) AS t_c, round(sqrt(u10 * u10 + v10 * v10), 6) AS wind, round(lhf * 86400.0E0 / 2.45e6, 6) AS evap_mm, round((t_k - 273.15E0) + 0.4E0 * ((td_k - 273.15E0) - (t_k - 273.15E0)), 6) AS heat_index FROM v_hourly", H)
def p11(v):
    t, td = sc.celsius(F.col("t_k")), sc.celsius(F.col("td_k"))
    return v.hourly.select("hsa_id", "ts", t.alias("t_c"), sc.wind_speed(F.col("u10"), F.col("v10")).alias("wind"), sc.evaporation_mm(F.col("lhf")).alias("evap_mm"), sc.heat_index(t, td).alias("heat_index"))


@query("s11_time_range", "SELECT hsa_id, count(*) AS n, round(sum(t_k), 4) AS t FROM v_hourly WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY hsa_id", H, 4)
def s11(v):
    return cl.time_range(v.hourly, "ts", "2024-01-08", "2024-01-15", ["hsa_id", "t_k"]).groupBy("hsa_id").agg(F.count("*").alias("n"), F.sum("t_k").alias("t"))


@query("a17_hourly_to_daily", f"SELECT hsa_id, obs_day, hours_above_30, hours_above_35, {r('t_mean t_min t_max dtr td_mean heat_index wind evap_mm')} FROM hd", H)
def a17(v):
    return cl.hourly_to_daily(v.hourly)


@query("a18_daily_to_weekly", f"SELECT hsa_id, week_start, heavy_days, {r('p_mean p_total p_max_day wetday_frac p95')} FROM wk", H)
def a18(v):
    return cl.daily_to_weekly(v.daily)


@query("a14_p95", "SELECT hsa_id, round(quantile_cont(precip_mm, 0.95), 6) AS p95 FROM v_daily GROUP BY hsa_id", H)
def a14(v):
    return cl.own_quantile(v.daily, "hsa_id", "precip_mm")


@query("a15_threshold_days", "SELECT d.hsa_id, round(avg(CASE WHEN precip_mm > 1 THEN 1.0E0 ELSE 0.0E0 END), 6) AS wetday_frac, round(sum(CASE WHEN precip_mm > 10 THEN 1 ELSE 0 END) / 7.0E0, 6) AS heavy10_per_year, round(sum(CASE WHEN precip_mm > 20 THEN 1 ELSE 0 END) / 7.0E0, 6) AS heavy20_per_year, round(sum(CASE WHEN precip_mm >= q.p95 THEN 1 ELSE 0 END) / 7.0E0, 6) AS p95_days_per_year, round(sum(CASE WHEN t_max_c > 35 THEN 1 ELSE 0 END) / 7.0E0, 6) AS hot_days_per_year, round(any_value(q.p95), 6) AS p95_mm FROM v_daily d JOIN (SELECT hsa_id, quantile_cont(precip_mm, 0.95) AS p95 FROM v_daily GROUP BY hsa_id) q ON q.hsa_id = d.hsa_id GROUP BY d.hsa_id", H)
def a15(v):
    return cl.threshold_days(v.daily, years=7.0)


@query("a16_climatology", "SELECT q.hsa_id, round(p_mean_mm, 6) AS p_mean_mm, round(p_total_mm, 6) AS p_total_mm, round(t_max_mean, 6) AS t_max_mean, round(t_min_mean, 6) AS t_min_mean, round(t_max_mean - t_min_mean, 6) AS dtr_mean, round(h.t_mean, 6) AS t_mean, round(h.dewpoint, 6) AS dewpoint, round(h.wind, 6) AS wind, round(h.evap_mm, 6) AS evap_mm, round(p_total_mm - h.evap_mm, 6) AS balance_mm FROM (SELECT hsa_id, avg(precip_mm) AS p_mean_mm, sum(precip_mm) AS p_total_mm, avg(t_max_c) AS t_max_mean, avg(t_min_c) AS t_min_mean FROM v_daily GROUP BY hsa_id) q LEFT JOIN (SELECT hsa_id, avg(t_mean) AS t_mean, avg(td_mean) AS dewpoint, avg(wind) AS wind, sum(evap_mm) AS evap_mm FROM hd GROUP BY hsa_id) h ON h.hsa_id = q.hsa_id", H)
def a16(v):
    return cl.climatology(v.daily, cl.hourly_to_daily(v.hourly))


@query("a19_water_deficit", "SELECT w.hsa_id, w.week_start, round(e.evap_total - w.p_total, 6) AS water_deficit FROM (SELECT hsa_id, week_start, p_total FROM wk) w JOIN (SELECT hsa_id, CAST(date_trunc('week', obs_day) AS DATE) AS week_start, sum(t_max_c / 10.0E0) AS evap_total FROM v_daily GROUP BY ALL) e ON e.hsa_id = w.hsa_id AND e.week_start = w.week_start", H)
def a19(v):
    evap = v.daily.groupBy("hsa_id", sc.monday(F.col("obs_day")).alias("week_start")).agg(F.sum(F.col("t_max_c") / 10.0).alias("evap_total"))
    return cl.water_deficit(cl.daily_to_weekly(v.daily), evap)


@query("j15_day_lags", "SELECT w.hsa_id, w.week_start, " + ", ".join(f"round((SELECT avg(d.precip_mm) FROM v_daily d WHERE d.hsa_id = w.hsa_id AND d.obs_day = w.week_start - {k}), 6) AS p_d_{k}" for k in sc.LAG_DAYS) + " FROM (SELECT DISTINCT hsa_id, CAST(date_trunc('week', obs_day) AS DATE) AS week_start FROM v_daily) w", H)
def j15(v):
    return cl.day_lags(v.daily, "precip_mm", prefix="p_d")


@query("w6_week_lags", "SELECT w.hsa_id, w.week_start, " + ", ".join(f"round(l{k}.s, 6) AS p_sum_w{k}, round(l{k}.m, 6) AS p_mean_w{k}, l{k}.h AS p_heavy_w{k}" for k in (1, 2, 3)) + " FROM b w " + " ".join(f"LEFT JOIN b l{k} ON l{k}.hsa_id = w.hsa_id AND l{k}.week_start = w.week_start - {7 * k}" for k in (1, 2, 3)), {**H, "b": "SELECT hsa_id, CAST(date_trunc('week', obs_day) AS DATE) AS week_start, sum(precip_mm) AS s, avg(precip_mm) AS m, CAST(sum(CASE WHEN precip_mm > 10 THEN 1 ELSE 0 END) AS BIGINT) AS h FROM v_daily GROUP BY ALL"})
def w6(v):
    return cl.week_lags(v.daily)


@query("j11_zonal_mean", "SELECT m.anchor_id, d.obs_day, round(avg(d.precip_mm), 6) AS precip_mm FROM (SELECT f.facility_id AS anchor_id, g.facility_id % 18 AS hsa_id FROM v_facility f JOIN v_facility g ON 2 * 6371.0E0 * asin(sqrt(power(sin(radians(g.lat - f.lat) / 2), 2) + cos(radians(f.lat)) * cos(radians(g.lat)) * power(sin(radians(g.lon - f.lon) / 2), 2))) <= 30.0E0 WHERE f.facility_id IN (SELECT arg_min(facility_id, (-volume, facility_id)) FROM v_facility GROUP BY governorate_id)) m JOIN v_daily d ON d.hsa_id = m.hsa_id GROUP BY ALL", H)
def j11(v):
    anchors = highest_volume(v.stored_facility, "governorate_id").withColumn("service_radius_km", F.lit(30.0))
    members = sp.facilities_in_areas(anchors, v.stored_facility).select("anchor_id", (F.col("facility_id") % 18).alias("cell_id"))
    return cl.zonal_mean(v.daily.withColumnRenamed("hsa_id", "cell_id"), members, "anchor_id", "obs_day", ["precip_mm"])
