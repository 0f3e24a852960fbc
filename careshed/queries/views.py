"""Visits, facilities, population cells, cases and climate as views of the given tables.

One text serves both engines: integer arithmetic and double literals only.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from careshed.core.work import table

VIEWS = {
    "v_facility": """SELECT s.s_suppkey AS facility_id, s.s_name AS healthfacility, CASE s.s_suppkey % 4 WHEN 0 THEN 'Primary Center' WHEN 1 THEN 'Comprehensive Center' WHEN 2 THEN 'Specialized Medical Center' ELSE 'Hospital' END AS healthfacilitytype, s.s_nationkey % 12 AS governorate_id, 35.0E0 + CAST((s.s_suppkey * 7919) % 1500 AS DOUBLE) / 1000.0E0 AS lon, 29.5E0 + CAST((s.s_suppkey * 104729) % 3200 AS DOUBLE) / 1000.0E0 AS lat, coalesce(v.n, 0) AS volume, CAST(s.s_suppkey % 8 AS INT) AS climate_k
FROM {supplier} s LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey) v ON v.l_suppkey = s.s_suppkey""",
    "v_cell": """SELECT cell_id, grid_row, grid_col, 35.0E0 + CAST(grid_col AS DOUBLE) * 0.0375E0 AS lon, 29.5E0 + CAST(grid_row % 80 AS DOUBLE) * 0.04E0 AS lat, pop
FROM (SELECT c_custkey AS cell_id, CAST((c_custkey - c_custkey % 40) / 40 AS INT) AS grid_row, CAST(c_custkey % 40 AS INT) AS grid_col, CAST(floor(greatest(c_acctbal, 0.0E0)) AS BIGINT) AS pop FROM {customer}) t""",
    "v_visit": """SELECT event_id, user_id AS patientid, event_type AS diagnosis_group, ts AS visit_time, event_id % (SELECT count(*) FROM {supplier}) AS facility_id, CAST(1 + event_id % 4 AS INT) AS facility_level, value FROM {events}""",
    "v_case": """SELECT s.s_nationkey % 18 AS hsa_id, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS week_start, l.l_shipdate AS seen, p.p_type AS diagnosis, l.l_returnflag AS flag, s.s_suppkey AS facility_id
FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "v_daily": """SELECT s.s_nationkey % 18 AS hsa_id, CAST(l.l_shipdate AS DATE) AS obs_day, sum(l.l_quantity) / 4.0E0 AS precip_mm, max(l.l_discount) * 400.0E0 AS t_max_c, min(l.l_tax) * 200.0E0 AS t_min_c
FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY s.s_nationkey % 18, CAST(l.l_shipdate AS DATE)""",
    "v_hourly": """SELECT user_id % 18 AS hsa_id, ts, 273.15E0 + value / 12.0E0 AS t_k, 273.15E0 + value / 12.0E0 - CAST(event_id % 15 AS DOUBLE) AS td_k, CAST(event_id % 7 - 3 AS DOUBLE) AS u10, CAST(event_id % 5 - 2 AS DOUBLE) AS v10, CAST(event_id % 200 AS DOUBLE) AS lhf FROM {events}""",
    "v_panel": """SELECT w.hsa_id, w.week_start, coalesce(c.cases, 0) AS cases, w.p_total, w.p_mean, w.t_max, w.t_mean, w.wetday_frac, w.p_max, w.flat
FROM (SELECT s.s_nationkey % 18 AS hsa_id, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS week_start, sum(l.l_quantity) / 40.0E0 AS p_total, avg(l.l_quantity) AS p_mean, max(l.l_discount) * 400.0E0 AS t_max, avg(l.l_discount) * 400.0E0 AS t_mean, avg(CASE WHEN l.l_quantity > 20.0E0 THEN 1.0E0 ELSE 0.0E0 END) AS wetday_frac, max(l.l_quantity) AS p_max, 1.0E0 AS flat FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey GROUP BY s.s_nationkey % 18, CAST(date_trunc('week', l.l_shipdate) AS DATE)) w
LEFT JOIN (SELECT s.s_nationkey % 18 AS hsa_id, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS week_start, count(*) AS cases FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey WHERE l.l_returnflag = 'R' GROUP BY s.s_nationkey % 18, CAST(date_trunc('week', l.l_shipdate) AS DATE)) c ON c.hsa_id = w.hsa_id AND c.week_start = w.week_start""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


class Views:
    """The views of a folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        return self.spark.sql(text, **{t: self.base(t) for t in BASE if "{" + t + "}" in text})

    facility = cached_property(lambda self: self.view("v_facility"))
    #: Written once, for queries that read facilities several times: the view sums all line items.
    stored_facility = cached_property(lambda self: table(self.facility, "facilities"))
    cell = cached_property(lambda self: self.view("v_cell"))
    visit = cached_property(lambda self: self.view("v_visit"))
    case = cached_property(lambda self: self.view("v_case"))
    daily = cached_property(lambda self: self.view("v_daily"))
    hourly = cached_property(lambda self: self.view("v_hourly"))
    panel = cached_property(lambda self: self.view("v_panel"))


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """The SQL with the views and helpers it names before it."""
    known = {k: v.format(**{t: t for t in BASE}) for k, v in VIEWS.items()} | (extra or {})
    need: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(known[name])
                need.append(name)

    add(sql)
    return (f"WITH {', '.join(f'{n} AS ({known[n]})' for n in need)}\n" if need else "") + sql
