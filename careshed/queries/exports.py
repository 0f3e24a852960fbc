"""Queries that send the views through files and streams and read back what arrived."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from careshed.core.work import shared_dir
from careshed.operators.spatial import within_regions
from careshed.queries.registry import query
from careshed.queries.spatial import BOXES, REGION_SQL
from careshed.queries.surveillance import KEPT
from careshed.sources import files
from careshed.streaming import jobs


def _path(v, name):
    return f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_facility_file", "SELECT healthfacility, healthfacilitytype, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_facility")
def s1(v):
    path = _path(v, "facilities")
    files.write_csv(v.facility.select("healthfacility", "healthfacilitytype", F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude")), path)
    return files.read_facilities(v.spark, path).select("healthfacility", "healthfacilitytype", "lat", "lon")


@query("s2_group_lookup", "SELECT c.grp AS \"group\", count(*) AS cases FROM (SELECT split_part(diagnosis, ' ', 1) AS grp FROM v_case) c GROUP BY c.grp")
def s2(v):
    path = _path(v, "groups")
    kinds = v.case.select(F.col("diagnosis").alias("Diagnosis"), F.split_part("diagnosis", F.lit(" "), F.lit(1)).alias("General_Diagnosis")).distinct()
    files.write_csv(kinds, path)
    groups = files.read_groups(v.spark, path)
    return v.case.join(groups, "diagnosis").groupBy("group").agg(F.count("*").alias("cases"))


@query("s3_visit_file", "SELECT event_id, CASE WHEN value < 10.0E0 THEN NULL ELSE CAST(visit_time AS DATE) END AS day, CASE WHEN value < 10.0E0 THEN NULL ELSE CAST(hour(visit_time) AS INT) END AS hour FROM v_visit")
def s3(v):
    path = _path(v, "visits")
    time = F.when(F.col("value") < 10.0, "not known").otherwise(F.date_format("visit_time", "yyyy-MM-dd HH:mm:ss"))
    files.write_csv(v.visit.select("patientid", F.lit("").alias("gender"), F.lit("").alias("ageatdiagnosis"), F.lit("").alias("governorate"), F.col("event_id").alias("diagnosisid"), F.col("diagnosis_group").alias("diagnosis"), F.lit("").alias("general_category"), time.alias("datetimediagnosisentered"), F.lit("").alias("healthfacility"), F.lit("").alias("healthfacilitytype")), path)
    got = files.read_visits(v.spark, path)
    return got.select(F.col("diagnosisid").cast("long").alias("event_id"), F.to_date("visit_time").alias("day"), F.hour("visit_time").alias("hour"))


@query("s4_aliases", "SELECT healthfacility AS name, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(1 AS BIGINT) AS same_id FROM v_facility")
def s4(v):
    path = _path(v, "aliases")
    files.write_csv(v.facility.select(F.col("healthfacility").alias("FacilityName"), F.col("lat").alias("y"), F.col("lon").alias("LNG")), path)
    got = files.with_id(files.resolve(files.read_csv(v.spark, path), {k: files.ALIASES[k] for k in ("lat", "lon", "name")}, ("lat", "lon")), ["name", "lat", "lon"])
    same = got.groupBy("id").agg(F.count("*").alias("same_id"))
    return got.join(same, "id").select("name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "same_id")


@query("s5_family_files", "SELECT CAST(hsa_id AS VARCHAR) AS hsa_name, week_start, round(p_total, 6) AS p_total, cases FROM v_panel")
def s5(v):
    folder = _path(v, "families")
    files.write_family(v.panel.select("hsa_id", "week_start", "p_total", "cases", F.lit("0").alias("system:index"), F.lit("g").alias(".geo")), folder, "rain", "hsa_id")
    got = files.read_family(v.spark, folder, "rain")
    return got.select("hsa_name", F.to_date("week_start").alias("week_start"), F.col("p_total").cast("double").alias("p_total"), F.col("cases").cast("long").alias("cases"))


#: A hole in the box G04: no governorate there, and no country.
HOLE = (35.6, 30.5, 35.9, 30.9)


@query("s10_polygons", f"SELECT f.facility_id, CASE WHEN h.inside THEN NULL ELSE r.region END AS governorate, CASE WHEN r.region IS NULL OR h.inside THEN NULL ELSE 'country' END AS country FROM v_facility f LEFT JOIN ({REGION_SQL}) r ON r.facility_id = f.facility_id JOIN (SELECT facility_id, lon >= {HOLE[0]}E0 AND lon < {HOLE[2]}E0 AND lat >= {HOLE[1]}E0 AND lat < {HOLE[3]}E0 AS inside FROM v_facility) h ON h.facility_id = f.facility_id")
def s10(v):
    def ring(w, s, e, n):
        return [[w, s], [e, s], [e, n], [w, n], [w, s]]

    features = [{"type": "Feature", "properties": {"shapeName": name}, "geometry": {"type": "Polygon", "coordinates": [ring(w, s, e, n)] + ([ring(*HOLE)] if name == "G04" else [])}} for name, w, s, e, n in BOXES]
    path = _path(v, "polygons")
    files.write_text(v.spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": features}),)], "value string"), path)
    regions = files.read_polygons(v.spark, path)
    named = within_regions(v.facility, regions, "facility_id", "governorate")
    return within_regions(named, files.dissolved(regions, "country"), "facility_id", "country").select("facility_id", "governorate", "country")


@query("s12_csv_round_trip", "SELECT facility_id, healthfacility, governorate_id, volume FROM v_facility")
def s12(v):
    path = _path(v, "export-csv")
    files.write_csv(v.facility.select("facility_id", "healthfacility", "governorate_id", "volume"), path, ["facility_id"])
    return files.read_csv(v.spark, path, "facility_id LONG, healthfacility STRING, governorate_id INT, volume LONG")


@query("s13_geojson_round_trip", "SELECT facility_id, round(lon, 6) AS lon, round(lat, 6) AS lat, volume FROM v_facility")
def s13(v):
    path = _path(v, "export-geojson")
    files.write_text(files.features_geojson(v.facility.select("facility_id", "lon", "lat", "volume")), path)
    schema = "geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<facility_id: LONG, volume: LONG>"
    back = v.spark.read.schema(schema).json(path)
    return back.select("properties.facility_id", F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"), "properties.volume")


@query("s14_split_export", "SELECT healthfacilitytype, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM v_facility GROUP BY healthfacilitytype")
def s14(v):
    path = _path(v, "export-split")
    files.write_split(v.facility.select("facility_id", "healthfacilitytype", "volume"), path, "healthfacilitytype")
    back = v.spark.read.option("header", True).schema("facility_id LONG, volume LONG, healthfacilitytype STRING").csv(path)
    return back.groupBy("healthfacilitytype").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("s16_verify_export", "SELECT count(*) AS areas FROM v_facility")
def s16(v):
    path = _path(v, "export-verify")
    files.write_text(files.features_geojson(v.facility.withColumn("service_radius_km", F.lit(20.0))), path)
    n = files.verify_areas(v.spark, path, ("facility_id", "service_radius_km"))["areas"]
    return v.spark.createDataFrame([(n,)], "areas long")


def _events(v):
    return v.spark.readStream.schema(v.base("events").schema).parquet(f"{v.sf_dir}/event[s].parquet")


def _drained(v, df, name):
    """Run a stream over what there is, into a folder, and read that."""
    path = _path(v, name)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(df.schema).parquet(path)


@query("x1_stream_weekly_counts", "SELECT hsa_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS cases FROM (SELECT user_id % 18 AS hsa_id, ts FROM events) e WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL")
def x1(v):
    return _drained(v, jobs.weekly_counts(_events(v).select((F.col("user_id") % 18).alias("hsa_id"), "ts"), "hsa_id", "ts", "0 seconds"), "stream-weeks")


@query("x2_stream_dedup", "SELECT event_id FROM kept", KEPT)
def x2(v):
    visits = _events(v).select(F.col("user_id").alias("patientid"), F.col("event_type").alias("diagnosis_group"), "event_id", F.col("ts").alias("visit_time"), (1 + F.col("event_id") % 4).cast("int").alias("facility_level"))
    jobs.with_rocksdb(v.spark)
    return _drained(v, jobs.deduplicate_visits(visits), "stream-dedup").select("event_id")


@query("x3_stream_drift", "SELECT count(*) AS n, round(sqrt(avg((value - 50.0E0) * (value - 50.0E0))), 6) AS rmse, sqrt(avg((value - 50.0E0) * (value - 50.0E0))) > 15 AS alert FROM events")
def x3(v):
    path = _path(v, "stream-drift")

    alerts = []
    rows = _events(v).select(F.col("value").alias("y"), F.lit(50.0).alias("prediction"))
    q = jobs.drift_monitor(rows, lambda rmse, batch: alerts.append(rmse), scores=path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    n, squares = F.sum("n"), F.sum(F.col("n") * F.col("rmse") * F.col("rmse"))
    return v.spark.read.schema("n long, rmse double").parquet(path).agg(n.alias("n"), F.sqrt(squares / n).alias("rmse")).withColumn("alert", F.lit(bool(alerts)))
