"""Readers and writers: facility, lookup and visit files, feature families, polygons, ordered and split exports."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names by which columns go in the files.
ALIASES = {
    "lat": ("lat", "latitude", "y"),
    "lon": ("lon", "lng", "longitude", "x"),
    "name": ("healthfacility", "id", "name", "facilityname", "facility"),
    "group": ("general_diagnosis", "group", "diagnosis_group", "general_category"),
    "region": ("shapename", "governorate", "gov", "adm1_en"),
}
BOOKKEEPING = ("system:index", ".geo")
FACILITIES = "healthfacility STRING, healthfacilitytype STRING, governorate STRING, Latitude DOUBLE, Longitude DOUBLE"
VISITS = "patientid STRING, gender STRING, ageatdiagnosis STRING, governorate STRING, diagnosisid STRING, diagnosis STRING, general_category STRING, datetimediagnosisentered STRING, healthfacility STRING, healthfacilitytype STRING"


def resolve(df: DataFrame, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """Rename the first column that matches an alias, whatever its case; fail if a required one is missing."""
    have = {c.lower(): c for c in df.columns}
    for name, aliases in wanted.items():
        found = next((have[a] for a in aliases if a in have), None)
        if found and found != name:
            df = df.drop(name) if name in df.columns else df
            df = df.withColumnRenamed(found, name)
        if not found and name in required:
            raise ValueError(f"no column for {name}: one of {', '.join(aliases)}")
    return df


def with_id(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """A stable id from the key columns, where the file has none."""
    return df if name in df.columns else df.withColumn(name, F.xxhash64(*keys))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """``multi_line`` reads line feeds inside quotes, for which one task reads a whole file; without it files are split."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    df = resolve(read_csv(spark, path), {k: ALIASES[k] for k in ("lat", "lon")}, ("lat", "lon"))
    return df.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")})


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    have = {c.lower(): c for c in df.columns}
    group = next((have[a] for a in ALIASES["group"] if a in have), None)
    if "diagnosis" not in have or group is None:
        raise ValueError("a lookup needs a diagnosis and a group column")
    return df.select(F.col(have["diagnosis"]).alias("diagnosis"), F.col(f"`{group}`").alias("group"))


def read_visits(spark: SparkSession, path: str, time: str = "datetimediagnosisentered", multi_line: bool = False) -> DataFrame:
    """Visits with ``visit_time``; a time that cannot be read is null. Visits are one to a line, so large files are split."""
    return read_csv(spark, path, VISITS, multi_line).withColumn("visit_time", F.try_to_timestamp(F.col(time)).cast("timestamp_ntz"))


def drop_bookkeeping(df: DataFrame, names: tuple[str, ...] = BOOKKEEPING) -> DataFrame:
    return df.drop(*names)


def read_family(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """All files HSA_<name>_<family>.csv of a folder, with the name from the file as ``hsa_name``."""
    df = read_csv(spark, f"{folder}/HSA_*_{family}.csv")
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # Spark tells it as part of an address
    return drop_bookkeeping(df.withColumn("hsa_name", F.regexp_extract(F.replace(file, F.lit("%2F"), F.lit("/")), f"^HSA_(.*)_{family}\\.csv$", 1)))


def read_polygons(spark: SparkSession, path: str, name: str = "shapeName") -> DataFrame:
    """(name, part, ring, holes) of the polygons and multi-polygons of a GeoJSON feature collection."""
    schema = f"features ARRAY<STRUCT<properties: STRUCT<`{name}`: STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    one, many = "ARRAY<ARRAY<ARRAY<DOUBLE>>>", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
    text = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(text, one))).otherwise(F.from_json(text, many))
    rings = f.select(F.col(f"f.properties.{name}").alias("name"), F.posexplode(parts).alias("part", "rings"))
    rings = rings.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))
    return rings.select("name", "part", F.get("rings", F.lit(0)).alias("ring"), F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))).alias("holes"))


def dissolved(polygons: DataFrame, name: str) -> DataFrame:
    """All parts under one name: a point lies in the union if it lies in any part."""
    return polygons.withColumn("name", F.lit(name))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def write_family(df: DataFrame, folder: str, family: str, name: str) -> list[str]:
    """One CSV file HSA_<name>_<family>.csv for each value of the column ``name``, a few dozen areas; their file names."""
    spark, staged = df.sparkSession, f"{folder}/_{family}"
    df.repartition(name).write.mode("overwrite").partitionBy(name).option("header", True).option("maxRecordsPerFile", 0).csv(staged)  # one file for a value
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for part in fs.globStatus(path(f"{staged}/{name}=*/part-*")):
        value = unquote(part.getPath().getParent().getName().partition("=")[2]).replace("/", "%2F")  # a folder's name is escaped
        fs.rename(part.getPath(), path(f"{folder}/HSA_{value}_{family}.csv"))
        found.append(f"HSA_{value}_{family}.csv")
    fs.delete(path(staged), True)
    return sorted(found)


def features_geojson(areas: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON point feature for each row, as text (``value``)."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    own = F.struct(*[c for c in areas.columns if c not in (lon, lat)])
    return areas.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), own.alias("properties"))).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def verify_areas(spark: SparkSession, path: str, required: tuple[str, ...], max_radius: float = 30.0) -> dict[str, int]:
    """Read a GeoJSON export back; fail on missing columns or a radius beyond the bound. The number of areas."""
    df = spark.read.json(path)
    missing = [c for c in required if c not in df.select("properties.*").columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    n, wide = df.agg(F.count("*"), F.count(F.when(F.col("properties.service_radius_km") > max_radius, 1))).first()
    if wide:
        raise ValueError(f"{wide} areas have a radius over {max_radius} km")
    return {"areas": n}
