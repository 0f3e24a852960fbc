"""Session defaults, work tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 2_000
_own_dirs: dict[str, str] = {}  # by application
_written: dict[str, list[str]] = {}  # by application


def session(app: str = "careshed", **config: str) -> SparkSession:
    """A session with the library's defaults: UTC, adaptive execution with skew joins."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=defaults | config).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or with a local master alone a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs[app] = _own_dirs.get(app) or tempfile.mkdtemp(prefix="spark-careshed-")
    return base.rstrip("/")


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay, as a DataFrame may be read at any time, until ``clear`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the work tables that this application has written; DataFrames over them cannot be read any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in map(hadoop, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each row, in ascending order of the columns ``order``.

    Rows are dealt to ranges of the order; only one total for each range meets in a single task.
    """
    ranges = table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("__range").agg(F.sum(value).alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.select("__range", before.alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.join(F.broadcast(before), "__range").withColumn(name, inside + F.col("__before")).drop("__range", "__before")  # a row for each range


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``limit`` rows; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def send_package(spark: SparkSession) -> None:
    """Send this package to executors that do not have it yet."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(context, "_careshed_sent", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-careshed-"), "careshed.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in (root / "careshed").rglob("*.py"):
                z.write(file, file.relative_to(root))
        context.addPyFile(archive)
        context._careshed_sent = True


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow``, with this package sent to executors that do not have it yet."""
    send_package(df.sparkSession)
    return df.mapInArrow(function, schema)
