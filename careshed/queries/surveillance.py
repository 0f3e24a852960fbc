"""Queries over visits and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from careshed.functions.scalars import facility_level, has_keyword, monday, normal_name
from careshed.operators import surveillance as s
from careshed.operators.coverage import highest_volume
from careshed.operators.features import stamp
from careshed.queries.registry import query

KEPT = {
    "w1": """SELECT *, lag(visit_time) OVER w AS prev_t, lag(facility_level) OVER w AS prev_l FROM v_visit WINDOW w AS (PARTITION BY patientid, diagnosis_group ORDER BY visit_time, facility_level DESC, event_id)""",
    "flagged": """SELECT *, coalesce(CAST(floor(epoch(visit_time - prev_t) / 86400) AS INT) <= 3 AND facility_level <= prev_l, false) AS is_repeat FROM w1""",
    "kept": """SELECT * FROM flagged WHERE NOT is_repeat""",
}
PANEL = {
    "cases_r": "SELECT hsa_id, week_start, facility_id, diagnosis FROM v_case WHERE flag = 'R'",
    "bounds": "SELECT min(week_start) AS a, max(week_start) AS b FROM cases_r",
    "grid": "SELECT h.hsa_id, CAST(w.week_start AS DATE) AS week_start FROM (SELECT DISTINCT hsa_id FROM cases_r) h CROSS JOIN (SELECT unnest(generate_series(a, b, INTERVAL 7 DAY)) AS week_start FROM bounds) w",
    "panel": "SELECT g.hsa_id, g.week_start, coalesce(c.cases, 0) AS cases FROM grid g LEFT JOIN (SELECT hsa_id, week_start, count(*) AS cases FROM cases_r GROUP BY hsa_id, week_start) c ON c.hsa_id = g.hsa_id AND c.week_start = g.week_start",
}


def _kept(v):
    return s.deduplicate_visits(v.visit)


def _cases(v):
    return v.case.where("flag = 'R'")


def _panel(v):
    cases = _cases(v)
    first, last = cases.agg(F.min("week_start"), F.max("week_start")).first()
    return s.weekly_panel(cases, "hsa_id", "week_start", F.lit(first), F.lit(last))


@query("w1_dedup", "SELECT event_id, is_repeat FROM flagged", KEPT)
def w1(v):
    return s.flag_repeats(v.visit).select("event_id", "is_repeat")


@query("a1_count_per_facility", "SELECT k.facility_id, f.healthfacility, f.healthfacilitytype, count(*) AS n_visits FROM kept k LEFT JOIN v_facility f ON f.facility_id = k.facility_id GROUP BY ALL", KEPT)
def a1(v):
    counts = s.count_by(_kept(v), "facility_id")
    return s.with_facility(counts, v.facility.select("facility_id", "healthfacility", "healthfacilitytype")).orderBy(F.desc("n_visits"), "facility_id")


@query("a2_count_facility_group", "SELECT facility_id, diagnosis_group, count(*) AS n_visits FROM kept GROUP BY ALL", KEPT)
def a2(v):
    return s.count_by(_kept(v), "facility_id", "diagnosis_group")


@query("a3_pivot", "SELECT facility_id, " + ", ".join(f"count(*) FILTER (diagnosis_group = '{g}') AS \"{g}\"" for g in ("click", "error", "purchase", "signup", "view")) + ", count(*) AS total FROM kept GROUP BY facility_id", KEPT)
def a3(v):
    return s.pivot_counts(_kept(v), "facility_id", "diagnosis_group")


@query("p1_group_assignment", "SELECT event_id, coalesce(CASE WHEN diagnosis_group IN ('click', 'view') THEN 'browse' END, diagnosis_group) AS diagnosis_group FROM v_visit")
def p1(v):
    lookup = v.visit.where("diagnosis_group IN ('click', 'view')").select(F.col("diagnosis_group").alias("diagnosis"), F.lit("browse").alias("group")).distinct()
    visits = v.visit.select("event_id", F.col("diagnosis_group").alias("diagnosis"), F.col("diagnosis_group").alias("general_category"))
    return s.assign_groups(visits, lookup).select("event_id", "diagnosis_group")


@query("p2_facility_level", "SELECT facility_id, CASE healthfacilitytype WHEN 'Comprehensive Center' THEN 2 WHEN 'Specialized Medical Center' THEN 3 WHEN 'Hospital' THEN 4 ELSE 1 END AS level FROM v_facility")
def p2(v):
    return v.facility.select("facility_id", facility_level(F.col("healthfacilitytype")).alias("level"))


@query("p3_keyword", "SELECT diagnosis, regexp_matches(lower(diagnosis), 'standard|promo|e\\. coli') AS hit, count(*) AS n FROM v_case GROUP BY ALL")
def p3(v):
    return v.case.groupBy("diagnosis", has_keyword(F.col("diagnosis"), ("standard", "promo", "e. coli")).alias("hit")).agg(F.count("*").alias("n"))


@query("p4_monday", "SELECT CAST(date_trunc('week', visit_time) AS DATE) AS week_start, count(*) AS n FROM v_visit GROUP BY ALL")
def p4(v):
    return v.visit.groupBy(monday(F.col("visit_time")).alias("week_start")).agg(F.count("*").alias("n"))


@query("p5_week_range", "SELECT week_start, count(*) AS n FROM v_case WHERE week_start BETWEEN DATE '1996-01-01' AND DATE '1997-12-29' GROUP BY ALL")
def p5(v):
    return v.case.where(F.col("week_start").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-29").cast("date"))).groupBy("week_start").agg(F.count("*").alias("n"))


@query("p6_normal_name", "SELECT facility_id, replace(regexp_replace('  ' || healthfacility || '   x ' || chr(160), '^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$', '', 'g'), '  ', ' ') AS name FROM v_facility")
def p6(v):
    return v.facility.select("facility_id", normal_name(F.concat(F.lit("  "), "healthfacility", F.lit("   x  "))).alias("name"))


@query("p10_numeric", "SELECT facility_id, TRY_CAST(CASE WHEN facility_id % 5 = 0 THEN 'n/a' ELSE CAST(volume AS VARCHAR) END AS DOUBLE) AS volume FROM v_facility WHERE TRY_CAST(CASE WHEN facility_id % 5 = 0 THEN 'n/a' ELSE CAST(volume AS VARCHAR) END AS DOUBLE) > 0")
def p10(v):
    raw = F.when(F.col("facility_id") % 5 == 0, "n/a").otherwise(F.col("volume").cast("string"))
    return v.facility.select("facility_id", raw.try_cast("double").alias("volume")).where("volume > 0")


@query("p17_stamp", "SELECT facility_id, 'INF' AS network_type, 'fewest' AS optimization_mode FROM v_facility")
def p17(v):
    return stamp(v.facility.select("facility_id"), network_type="INF", optimization_mode="fewest")


@query("p19_zero_fill", "SELECT hsa_id, week_start, CAST(cases AS INT) AS cases FROM panel", PANEL)
def p19(v):
    return _panel(v).withColumn("cases", F.coalesce("cases", F.lit(0)).cast("int"))


@query("j1_attributes", "SELECT c.facility_id, c.n_visits, f.governorate_id, f.lon, f.lat FROM (SELECT facility_id, count(*) AS n_visits FROM v_visit GROUP BY ALL) c LEFT JOIN v_facility f ON f.facility_id = c.facility_id")
def j1(v):
    return s.with_facility(s.count_by(v.visit, "facility_id"), v.facility.select("facility_id", "governorate_id", "lon", "lat"))


@query("j5_anchor_visits", "SELECT facility_id, count(*) AS n FROM v_visit WHERE facility_id IN (SELECT arg_min(facility_id, (-volume, facility_id)) FROM v_facility GROUP BY governorate_id) GROUP BY ALL")
def j5(v):
    return v.visit.join(highest_volume(v.facility, "governorate_id").select("facility_id"), "facility_id", "left_semi").groupBy("facility_id").agg(F.count("*").alias("n"))


@query("j12_gap_grid", "SELECT hsa_id, week_start FROM grid", PANEL)
def j12(v):
    first, last = _cases(v).agg(F.min("week_start"), F.max("week_start")).first()
    return s.gap_grid(_cases(v).select("hsa_id"), F.lit(first), F.lit(last))


@query("a4_weekly_counts", "SELECT hsa_id, week_start, count(*) AS cases FROM cases_r GROUP BY ALL", PANEL)
def a4(v):
    return s.weekly_counts(_cases(v), "hsa_id", "seen")


@query("a5_weekly_panel", "SELECT * FROM panel", PANEL)
def a5(v):
    return _panel(v)


@query("a6_panel_summary", "SELECT count(*) AS n_rows, count(*) FILTER (cases > 0) AS n_positive, CAST(sum(cases) AS BIGINT) AS total, round(avg(cases), 6) AS mean, round(median(cases), 6) AS median, max(cases) AS max FROM panel", PANEL)
def a6(v):
    return s.panel_summary(_panel(v), "cases")


@query("a10_value_counts", "SELECT diagnosis_group, count(*) AS n, round(100.0E0 * count(*) / (SELECT count(*) FROM v_visit), 6) AS pct FROM v_visit GROUP BY diagnosis_group")
def a10(v):
    return s.value_counts(v.visit, "diagnosis_group")


@query("a10_distinct", "SELECT count(DISTINCT patientid) AS patients, count(DISTINCT facility_id) AS facilities, count(DISTINCT diagnosis_group) AS groups FROM v_visit")
def a10_distinct(v):
    return v.visit.agg(F.countDistinct("patientid").alias("patients"), F.countDistinct("facility_id").alias("facilities"), F.countDistinct("diagnosis_group").alias("groups"))


@query("t1_order", "SELECT facility_id, diagnosis_group, count(*) AS n_visits FROM kept GROUP BY ALL", KEPT)
def t1(v):
    return s.count_by(_kept(v), "facility_id", "diagnosis_group").orderBy("facility_id", F.desc("n_visits"), "diagnosis_group")


@query("t2_top_areas", "SELECT hsa_id, CAST(sum(cases) AS BIGINT) AS total FROM panel GROUP BY hsa_id ORDER BY total DESC, hsa_id LIMIT 5", PANEL)
def t2(v):
    return s.top_areas(_panel(v), "hsa_id", "cases")


@query("t5_pilot", "SELECT hsa_id, week_start, cases FROM (SELECT *, row_number() OVER (PARTITION BY hsa_id ORDER BY week_start) AS rn FROM panel WHERE hsa_id IN (SELECT DISTINCT hsa_id FROM panel ORDER BY hsa_id LIMIT 3)) q WHERE rn <= 8", PANEL)
def t5(v):
    return s.pilot(_panel(v), "hsa_id", "week_start", 3, 8)


@query("u3_completeness", "SELECT g.hsa_id, g.week_start FROM grid g WHERE NOT EXISTS (SELECT 1 FROM cases_r c WHERE c.hsa_id = g.hsa_id AND c.week_start = g.week_start)", PANEL)
def u3(v):
    first, last = _cases(v).agg(F.min("week_start"), F.max("week_start")).first()
    return s.completeness(s.gap_grid(_cases(v).select("hsa_id"), F.lit(first), F.lit(last)), _cases(v), ["hsa_id", "week_start"])
