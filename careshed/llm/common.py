"""Shared pieces of the training-data operators: joins of checked sizes, row ids, texts and folds, Arrow functions."""

from __future__ import annotations

import os
import random
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from careshed.core.work import table

#: ASCII white space, as a Java character class: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = "[\\x20\\x09-\\x0D]"

__all__ = ["ASCII_SPACE", "checked_broadcast", "free_name", "in_arrow", "in_fold", "join_hot", "table", "text_of", "with_row_ids", "without"]

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A key is hot if it holds more than one in so many of the rows, so there are at most so many hot keys.
HOT = 256
#: The greatest long.
LAST = (1 << 63) - 1


def checked_broadcast(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint if ``small`` has at most ``limit`` rows; otherwise Spark shuffles both sides."""
    return F.broadcast(small) if rows <= limit else small


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, times: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner, left or left_semi) of ``rows`` with ``keyed``, which has one row for each key and, in ``times``, how
    many of the ``total`` rows have it. The hot keys, at most HOT, are broadcast, so their rows stay where they are; the
    rest is shuffled."""
    hot = F.broadcast(keyed.where(F.col(times) * HOT > total))  # at most HOT rows by their definition
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(F.col(times) * HOT <= total), key, how)
    return rows.join(hot, key, "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", limit: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose ``key`` is among the doc_ids of ``dropped``; rows with a null key stay.

    Up to ``limit`` ids are broadcast (at most 32 MB); beyond that both sides are shuffled.
    """
    ids = table(dropped.select(F.col("doc_id").alias(key)).distinct(), "dropped")
    return docs.join(checked_broadcast(ids, ids.count(), limit), key, "left_anti").select(docs.columns)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of whole numbers that differ on all rows, and its name.

    It is the doc_id wherever that is a whole number of one row alone. Rows without an id, and those after the first
    with an id, get numbers above all ids, or where ids reach up to the end of long, numbers from a range that holds no
    id. Such rows are written once, so that their numbers stay; usually there are none.
    """
    name, odd_id, own_id, first_row = (free_name(n, docs.columns) for n in ("__row", "__odd", "__own", "__first"))
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return table(docs.withColumn(name, F.monotonically_increasing_id()), "row-ids"), name
    key = docs["doc_id"].cast("long")
    odd = table(docs.groupBy(key.alias(odd_id)).agg(F.count("*").alias("n")).where(f"n > 1 OR {odd_id} IS NULL").select(odd_id), "row-ids-odd")
    n = odd.count()
    if not n:
        return docs.withColumn(name, key), name
    odd = checked_broadcast(odd, n, 1_000_000)
    rows = table(docs.join(odd, key.eqNullSafe(odd[odd_id]), "left_semi").withColumn(name, F.monotonically_increasing_id()), "row-ids")
    first = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias(own_id)).agg(F.min(name).alias(first_row))
    rows = rows.join(first, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.col(name) == F.col(first_row)), "left")
    base = _free_range(docs.select(key.alias("id")), rows.agg(F.max(name)).first()[0] + 1)
    rows = rows.withColumn(name, F.coalesce(own_id, F.col(name) + F.lit(base))).drop(own_id, first_row)
    return docs.join(odd, key.eqNullSafe(odd[odd_id]), "left_anti").withColumn(name, key).unionByName(rows), name


def _free_range(ids: DataFrame, length: int) -> int:
    """The start of so many longs in a row that are no ids: above all ids, or at some place where there is room."""
    top = ids.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    if top < LAST - length:
        return top + 1
    draw = random.Random(length)
    while True:  # ids fill a small share of all longs, so the first draws find room
        base = draw.randrange(-LAST, LAST - length)
        if ids.where(F.col("id").between(base, base + length - 1)).isEmpty():
            return base


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, by its remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def in_arrow(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors where they do not have it yet.

    Where the session has Spark's default of 10,000 rows in a batch it is set to 1,000: whole texts in so many rows are
    too much for two tasks' memory.
    """
    context, root = df.sparkSession.sparkContext, Path(__file__).resolve().parents[2]
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and not getattr(context, "_careshed_sent", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-careshed-"), "careshed.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for file in (root / "careshed").rglob("*.py"):
                z.write(file, file.relative_to(root))
        context.addPyFile(archive)
        context._careshed_sent = True
    conf = df.sparkSession.conf
    if conf.get(ROWS, "10000") == "10000":
        conf.set(ROWS, "1000")
    return df.mapInArrow(function, schema)
