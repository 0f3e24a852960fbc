from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from careshed.operators import surveillance as s
from careshed.sources import files
from careshed.streaming import jobs

DATA = "/root/testdata/sf0.01"


def test_facility_and_group_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\ufeffhealthfacility,healthfacilitytype,governorate,Latitude,Longitude\n\"A, north\",Hospital,X,31.5,35.9\nB,Primary Center,Y,soon,36.1\nC,Hospital,,30.25,35.0\n", encoding="utf-8")
    facilities = files.read_facilities(spark, str(tmp_path / "f.csv"))
    assert {(r.healthfacility, r.lat, r.lon) for r in facilities.collect()} == {("A, north", 31.5, 35.9), ("B", None, 36.1), ("C", 30.25, 35.0)}
    (tmp_path / "g.csv").write_text("Diagnosis,count,first_year,last_year,General_Diagnosis\n\"flu, type A\",3,2019,2020,Respiratory\ncholera,1,2019,2019,Gastro\n")
    assert {tuple(r) for r in files.read_groups(spark, str(tmp_path / "g.csv")).collect()} == {("flu, type A", "Respiratory"), ("cholera", "Gastro")}
    (tmp_path / "bad.csv").write_text("name,kind\nx,y\n")
    with pytest.raises(ValueError, match="lookup"):
        files.read_groups(spark, str(tmp_path / "bad.csv"))


def test_family_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("North", 1, 2.5), ("South_2", 2, 3.5), ("North", 3, 4.5), ("50% 'up'=x", 4, 1.0)], "name string, week int, p double")
    assert files.write_family(df, str(tmp_path), "rain", "name") == ["HSA_50% 'up'=x_rain.csv", "HSA_North_rain.csv", "HSA_South_2_rain.csv"]
    got = files.read_family(spark, str(tmp_path), "rain")
    assert sorted((r.hsa_name, int(r.week), float(r.p)) for r in got.collect()) == sorted(map(tuple, df.collect()))


def test_aliases_and_ids(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "HealthFacility string, Latitude double, LNG double")
    got = files.with_id(files.resolve(df, {k: files.ALIASES[k] for k in ("lat", "lon", "name")}), ["lat", "lon"])
    assert set(got.columns) == {"name", "lat", "lon", "id"}
    with pytest.raises(ValueError, match="no column for region"):
        files.resolve(df, {"region": files.ALIASES["region"]}, ("region",))


def test_visits_with_bad_times(spark, tmp_path):
    (tmp_path / "v.csv").write_text("patientid,gender,ageatdiagnosis,governorate,diagnosisid,diagnosis,general_category,datetimediagnosisentered,healthfacility,healthfacilitytype\n1,F,3,A,9,flu,G,2024-01-01 10:00:00,X,Hospital\n2,M,4,A,9,flu,G,soon,X,Hospital\n")
    assert [str(r.visit_time) for r in files.read_visits(spark, str(tmp_path / "v.csv")).orderBy("patientid").collect()] == ["2024-01-01 10:00:00", "None"]


def test_families_take_the_name_from_the_file(spark, tmp_path):
    for name in ("North", "South_2"):
        (tmp_path / f"HSA_{name}_rain.csv").write_text("system:index,FacilityName,week_start,p,.geo\n0,F,2024-01-01,1.5,g\n")
    got = files.read_family(spark, str(tmp_path), "rain")
    assert "system:index" not in got.columns and ".geo" not in got.columns
    assert sorted(r.hsa_name for r in got.collect()) == ["North", "South_2"]


def test_exports_come_back(spark, tmp_path):
    areas = spark.createDataFrame([("a", 35.0, 31.0, 12.5, "x"), ("b", 36.0, 32.0, 20.0, "y")], "name string, lon double, lat double, service_radius_km double, kind string")
    files.write_csv(areas, f"{tmp_path}/csv", ["name"])
    assert files.read_csv(spark, f"{tmp_path}/csv").count() == 2
    files.write_split(areas, f"{tmp_path}/split", "kind")
    assert files.read_csv(spark, f"{tmp_path}/split/kind=x").count() == 1
    files.write_text(files.features_geojson(areas), f"{tmp_path}/geo")
    assert files.verify_areas(spark, f"{tmp_path}/geo", ("name", "service_radius_km")) == {"areas": 2}
    with pytest.raises(ValueError, match="radius"):
        files.verify_areas(spark, f"{tmp_path}/geo", ("name",), 15.0)
    with pytest.raises(ValueError, match="missing"):
        files.verify_areas(spark, f"{tmp_path}/geo", ("score",))


def test_polygons_and_dissolve(spark, tmp_path):
    from careshed.operators.spatial import within_regions

    square = lambda x: [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"shapeName": "A"}, "geometry": {"type": "Polygon", "coordinates": [square(0), [[0.1, 0.1], [0.3, 0.1], [0.3, 0.3], [0.1, 0.3], [0.1, 0.1]]]}},
        {"properties": {"shapeName": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(2)], [square(4)]]}},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    regions = files.read_polygons(spark, str(tmp_path / "p.json"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 4.5, 0.5), (3, 1.5, 0.5), (4, 0.2, 0.2)], "id int, lon double, lat double")
    assert {r.id: r.region for r in within_regions(points, regions, "id").collect()} == {1: "A", 2: "B", 3: None, 4: None}
    assert {r.id: r.region for r in within_regions(points, files.dissolved(regions, "all"), "id").collect()} == {1: "all", 2: "all", 3: None, 4: None}


def replay(spark, tmp_path, df, order, parts, job, name):
    """Write ``df`` as files in order, stream them one at a time through ``job``, and give what comes out."""
    n = df.count()
    for i in range(parts):
        from pyspark.sql import Window

        numbered = df.withColumn("__n", F.row_number().over(Window.orderBy(order)))
        numbered.where((F.col("__n") > i * n // parts) & (F.col("__n") <= (i + 1) * n // parts)).drop("__n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_weeks_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").select((F.col("user_id") % 5).alias("area"), "ts")
    got = {(r.area, r.week_start): r.cases for r in replay(spark, tmp_path, e, "ts", 4, lambda d: jobs.weekly_counts(d, "area", "ts", "0 seconds"), "weeks").collect()}
    batch = {(r.area, r.week_start): r.cases for r in s.weekly_counts(e, "area", "ts").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert len(got) >= len(batch) - 5 * 2  # the last weeks wait for the watermark


def test_streamed_deduplication_equals_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet").where("event_id % 5 = 0")
    v = e.select("event_id", F.col("user_id").alias("patientid"), F.col("event_type").alias("diagnosis_group"), F.col("ts").alias("visit_time"), (1 + F.col("event_id") % 4).cast("int").alias("facility_level"))
    jobs.with_rocksdb(spark)
    got = replay(spark, tmp_path, v, "visit_time", 3, jobs.deduplicate_visits, "kept")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in s.deduplicate_visits(v).collect())


def test_streamed_rows_out_of_order(spark, tmp_path):
    day = lambda d, i: (i, 1, "flu", f"2024-03-{d:02d} 00:00:00", 1)
    rows = [[day(20, 1)], [day(5, 2)], [day(18, 3)], [day(22, 4)]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "event_id long, patientid long, diagnosis_group string, t string, facility_level int").withColumn("visit_time", F.col("t").cast("timestamp_ntz")).drop("t")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = jobs.deduplicate_visits(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in spark.table("late").collect()) == [1, 2]  # 15 days before is a visit of its own; 2 days before and after repeat


def test_drift_alerts(spark, tmp_path):
    alerts = []
    spark.createDataFrame([(0.0, 20.0), (0.0, 20.0)], "y double, prediction double").write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema("y double, prediction double").parquet(f"{tmp_path}/p")
    q = jobs.drift_monitor(stream, lambda rmse, batch: alerts.append(rmse)).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert alerts == [20.0]


def dedup_by_rows(rows, days=3):
    """(kept ids, last) of one patient's visits, batch by batch, one row at a time."""
    last, kept = None, []
    for batch in rows:
        for us, level, event in sorted(batch, key=lambda r: (r[0], -r[1], r[2])):
            if last is None or not (abs(us - last[0]) // 86_400_000_000 <= days and level <= last[1]):
                kept.append(event)
            if last is None or us >= last[0]:
                last = (us, level)
    return kept


def test_vectorised_steps_equal_rows():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        batches, event = [], 0
        for _ in range(rng.randrange(1, 5)):
            batch = []
            for _ in range(rng.randrange(1, 8)):
                batch.append((rng.randrange(30) * 43_200_000_000, rng.randrange(1, 4), event))
                event += 1
            batches.append(batch)
        last, kept = (None, None), []
        for batch in batches:
            batch.sort(key=lambda r: (r[0], -r[1], r[2]))
            us, level = (np.array([r[i] for r in batch], "int64") for i in (0, 1))
            keep, last = jobs.first_visits(us, level, *last, 3)
            kept += [r[2] for r, k in zip(batch, keep, strict=True) if k]
        assert kept == dedup_by_rows(batches)


def test_state_survives_a_restart_and_expires(spark, tmp_path):
    jobs.with_rocksdb(spark)
    day = lambda d, i, who=1: (i, who, "flu", f"2024-{1 + (d - 1) // 28:02d}-{1 + (d - 1) % 28:02d} 00:00:00", 1)
    stream = lambda: spark.readStream.schema("event_id long, patientid long, diagnosis_group string, facility_level int, visit_time timestamp_ntz").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    kept = []
    for i, part in enumerate([[day(1, 1)], [day(3, 2)], [day(80, 3, 2)], [day(81, 4, 2)], [day(82, 5)]]):
        df = spark.createDataFrame(part, "event_id long, patientid long, diagnosis_group string, t string, facility_level int").withColumn("visit_time", F.col("t").cast("timestamp_ntz")).drop("t")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        q = jobs.deduplicate_visits(stream()).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()  # each part is a run of its own, which takes up the state
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]])
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 3, 5]
    assert max(kept[1]) >= 1 and kept[-1][-1] <= max(map(max, kept))


def test_observed_drift_equals_the_monitor(spark, tmp_path):
    rows = [[(0.0, 20.0), (0.0, 20.0)], [(0.0, 1.0)], [(0.0, 30.0), (None, 1.0)], [(5.0, 5.0)]]
    read = lambda: spark.readStream.schema("y double, prediction double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p")
    alerts, listener = [], jobs.DriftListener(lambda rmse, batch: observed.append((round(rmse, 9), batch)))
    observed: list = []
    spark.streams.addListener(listener)
    try:
        for run in (rows[:2], rows[2:]):  # the second run goes on where the first ended
            for part in run:
                spark.createDataFrame(part, "y double, prediction double").coalesce(1).write.parquet(f"{tmp_path}/p/{rows.index(part):03d}")
            for name, job in (("a", lambda d: jobs.drift_monitor(d, lambda rmse, batch: alerts.append((round(rmse, 9), batch)))), ("b", lambda d: jobs.observed_errors(d).writeStream.format("noop"))):
                q = job(read()).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
                q.awaitTermination()
        for _ in range(100):
            if len(observed) >= len(alerts):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(observed) == sorted(alerts) and len(alerts) == 2


def test_many_groups_need_no_call_for_each_state(spark, tmp_path):
    v = spark.range(6000).selectExpr("id AS event_id", "id % 3000 AS patientid", "'flu' AS diagnosis_group", "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(cast(id div 3000 AS int) * 2) AS visit_time", "1 AS facility_level")
    plan = jobs.deduplicate_visits(spark.readStream.schema(v.schema).parquet(f"{tmp_path}"))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "MapGroupsInPandasWithState" in plan  # the former asks the JVM several times for each group
    got = replay(spark, tmp_path, v, "visit_time", 2, jobs.deduplicate_visits, "manygroups")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in s.deduplicate_visits(v).collect()) == list(range(3000))
