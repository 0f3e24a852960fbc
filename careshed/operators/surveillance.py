"""Visits to counts: diagnosis groups, visit deduplication, tables by facility, weekly panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careshed.core.work import broadcast_if_small
from careshed.functions.scalars import elapsed_days, monday


def assign_groups(visits: DataFrame, groups: DataFrame, diagnosis: str = "diagnosis", group: str = "group", own: str = "general_category") -> DataFrame:
    """The lookup's group of each diagnosis, else the record's own category, as ``diagnosis_group``."""
    lookup = groups.select(F.col(diagnosis).alias("__d"), F.col(group).alias("__g")).dropDuplicates(["__d"])
    joined = visits.join(broadcast_if_small(lookup), F.col(diagnosis) == F.col("__d"), "left")
    return joined.withColumn("diagnosis_group", F.coalesce("__g", own)).drop("__d", "__g")


def flag_repeats(visits: DataFrame, days: int = 3, patient: str = "patientid", group: str = "diagnosis_group", time: str = "visit_time", level: str = "facility_level", tie: str = "event_id") -> DataFrame:
    """``is_repeat``: the patient's previous visit for the group, itself a repeat or not, is at most ``days`` whole
    days back and at a level as high or higher. Visits without a patient, group or time are never repeats."""
    w = Window.partitionBy(patient, group).orderBy(F.col(time).asc_nulls_last(), F.col(level).desc(), F.col(tie))
    near = (elapsed_days(F.lag(time).over(w), F.col(time)) <= days) & (F.col(level) <= F.lag(level).over(w))
    return visits.withColumn("is_repeat", F.coalesce(near, F.lit(False)) & F.col(group).isNotNull() & F.col(patient).isNotNull())


def deduplicate_visits(visits: DataFrame, **columns) -> DataFrame:
    return flag_repeats(visits, **columns).where(~F.col("is_repeat")).drop("is_repeat")


def with_facility(counts: DataFrame, facilities: DataFrame, key: str = "facility_id") -> DataFrame:
    """Counts with their facility's attributes; a count without a facility keeps its row."""
    return counts.join(broadcast_if_small(facilities), key, "left")


def count_by(visits: DataFrame, *keys: str, name: str = "n_visits") -> DataFrame:
    """Visits by keys; rows with a null in any key but the first are left out."""
    for k in keys[1:]:
        visits = visits.where(F.col(k).isNotNull())
    return visits.groupBy(*keys).agg(F.count("*").alias(name))


def pivot_counts(visits: DataFrame, key: str, group: str, groups: list[str] | None = None) -> DataFrame:
    """A column for each group in order of name, zero filled, and their ``total``."""
    groups = sorted(groups if groups is not None else [r[0] for r in visits.select(group).where(F.col(group).isNotNull()).distinct().collect()])  # diagnosis groups: a short list
    wide = visits.where(F.col(group).isNotNull()).groupBy(key).pivot(group, groups).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{g}`") for g in groups), F.lit(0)).cast("long"))


def weekly_counts(cases: DataFrame, area: str, time: str, name: str = "cases") -> DataFrame:
    return cases.groupBy(area, monday(F.col(time)).alias("week_start")).agg(F.count("*").alias(name))


def gap_grid(areas: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every area with every Monday from ``first`` to ``last``: a row for each area, exploded into its weeks."""
    return areas.distinct().withColumn("week_start", F.explode(F.sequence(first, last, F.expr("INTERVAL 7 DAYS"))))


def weekly_panel(cases: DataFrame, area: str, week: str, first: Column, last: Column, name: str = "cases") -> DataFrame:
    """A row for every area and week of the range, zero where nothing was counted."""
    counts = cases.where(F.col(week).between(first, last)).groupBy(area, week).agg(F.count("*").alias(name))
    grid = gap_grid(cases.select(area), first, last).withColumnRenamed("week_start", week)
    return grid.join(counts, [area, week], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def panel_summary(panel: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return panel.agg(F.count("*").alias("n_rows"), F.count(F.when(v > 0, 1)).alias("n_positive"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("max"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of every value; the total is one number of the whole, joined back."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).withColumn("pct", F.try_divide(100.0 * F.col("n"), F.col("__total"))).drop("__total")  # one row


def top_areas(panel: DataFrame, area: str, value: str, k: int = 5) -> DataFrame:
    return panel.groupBy(area).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), area).limit(k)


def pilot(panel: DataFrame, area: str, week: str, areas: int, weeks: int) -> DataFrame:
    """The first areas by name and each one's first weeks."""
    some = panel.select(area).distinct().orderBy(area).limit(areas)
    w = Window.partitionBy(area).orderBy(week)
    return panel.join(F.broadcast(some), area, "left_semi").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= weeks).drop("__n")


def completeness(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were not found."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")
