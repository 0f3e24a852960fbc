from __future__ import annotations

from pyspark.sql import functions as F

from careshed.functions.scalars import elapsed_days, has_keyword, monday, normal_name, season
from careshed.operators import surveillance as s

VISITS = "event_id long, patientid long, diagnosis_group string, visit_time timestamp_ntz, facility_level int"


def visits(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, p, g, datetime.fromisoformat(t) if t else None, lv) for i, (p, g, t, lv) in enumerate(rows)], VISITS)


def kept(spark, rows):
    return sorted(r.event_id for r in s.deduplicate_visits(visits(spark, rows)).collect())


def test_a_repeat_is_compared_with_the_previous_raw_row(spark):
    rows = [(1, "a", "2024-01-01 00:00:00", 1), (1, "a", "2024-01-03 00:00:00", 1), (1, "a", "2024-01-06 12:00:00", 1)]
    assert kept(spark, rows) == [0]  # the third is within 3 whole days of the second, which is itself a repeat


def test_days_elapse_they_are_not_calendar_days(spark):
    assert kept(spark, [(1, "a", "2024-01-01 23:00:00", 1), (1, "a", "2024-01-05 22:00:00", 1)]) == [0]
    assert kept(spark, [(1, "a", "2024-01-01 23:00:00", 1), (1, "a", "2024-01-05 23:00:00", 1)]) == [0, 1]


def test_a_higher_level_is_no_repeat(spark):
    assert kept(spark, [(1, "a", "2024-01-01 00:00:00", 1), (1, "a", "2024-01-02 00:00:00", 2)]) == [0, 1]


def test_nulls_are_never_repeats(spark):
    rows = [(None, "a", "2024-01-01 00:00:00", 1), (None, "a", "2024-01-01 01:00:00", 1), (1, None, "2024-01-01 00:00:00", 1), (1, None, "2024-01-01 01:00:00", 1), (2, "a", None, 1), (2, "a", None, 1)]
    assert kept(spark, rows) == [0, 1, 2, 3, 4, 5]


def test_weeks_begin_on_mondays(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-01-07 10:00:00' AS sunday, timestamp_ntz'2024-01-08 00:00:00' AS monday").select(monday(F.col("sunday")).cast("string"), monday(F.col("monday")).cast("string")).first()
    assert tuple(r) == ("2024-01-01", "2024-01-08")


def test_names_lose_outer_blanks_and_double_blanks_once(spark):
    names = ["  Marikh  Primary Center  ", "a   b", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(normal_name(F.col("n"))).collect()]
    assert got == ["Marikh Primary Center", "a  b", None]


def test_keywords_and_seasons(spark):
    r = spark.sql("SELECT 'Acute CHOLERA' AS a, cast(null AS string) AS b, 'e xcoli' AS c, date'2024-12-02' AS d").select(has_keyword(F.col("a")), has_keyword(F.col("b")), has_keyword(F.col("c")), season(F.col("d"))).first()
    assert tuple(r) == (True, False, False, "Winter")


def test_elapsed_days_floor(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00:00' AS a, timestamp_ntz'2024-01-04 22:00:00' AS b").select(elapsed_days(F.col("a"), F.col("b"))).first()
    assert r[0] == 2


def test_panel_has_every_area_and_week(spark):
    cases = spark.sql("SELECT 1 AS area, date'2024-01-01' AS week UNION ALL SELECT 1, date'2024-01-15' UNION ALL SELECT 2, date'2024-01-08'")
    panel = s.weekly_panel(cases, "area", "week", F.lit("2024-01-01").cast("date"), F.lit("2024-01-15").cast("date"))
    assert sorted((r.area, str(r.week), r.cases) for r in panel.collect()) == [(1, "2024-01-01", 1), (1, "2024-01-08", 0), (1, "2024-01-15", 1), (2, "2024-01-01", 0), (2, "2024-01-08", 1), (2, "2024-01-15", 0)]


def test_pivot_without_a_group_and_empty_input(spark):
    rows = spark.sql("SELECT 1 AS f, 'b' AS g UNION ALL SELECT 1, 'a' UNION ALL SELECT 2, cast(null AS string)")
    assert [tuple(r) for r in s.pivot_counts(rows, "f", "g").collect()] == [(1, 1, 1, 2)]
    assert s.pivot_counts(rows.where("false"), "f", "g", ["a"]).count() == 0
