"""Packing by concatenate and cut: documents' tokens in one long stream, cut into sequences of fixed length.

The first pass tokenises every document once and writes its ids, with a running total inside its part. The
parts' totals are summed up to give each part, and so each document, its place in the whole stream; a second
pass cuts the documents where sequences end. Nothing but one total for each part leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careshed.llm.common import in_arrow, table
from careshed.llm.tokens import encoder

LENGTH, END = 2048, 1


def tokenised(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """(doc_id, part, place, tokens, ids): ids are little-endian 32-bit, end id included; place is where the document
    starts among the ids of its part, in the order of the part's rows."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, place = encoder(path, added=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [np.array([*encode(t or ""), end], "<u4").tobytes() for t in batch.column(1).to_pylist()]
            tokens = np.array([len(x) // 4 for x in ids], np.int64)
            places = place + np.cumsum(tokens) - tokens
            place += int(tokens.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(places), pa.array(tokens), pa.array(ids, pa.binary())], names=["doc_id", "part", "place", "tokens", "ids"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encoded, "doc_id long, part long, place long, tokens long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, end: int = END) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    * Every sequence but the last holds exactly ``length`` ids, so only the last can have padding.
    * Ids are the vocabulary's, a token that it adds (as <|endoftext|>) being one id also inside a text.
    * Each document's ids end with ``end``; a null or empty text is that id alone. Each id lies in one piece.
    * A text of any length is one document; runs of a million blanks or letters are encoded like any other text.
    * doc_id is cast to long: an id that is no whole number fails. Rows are taken as they come: repeated rows and null ids are packed like any other. Documents stand in the
      order of their rows in the table. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = table(tokenised(docs, path, end), "packing-ids")
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each part
    begins = table(totals.select("part", before.alias("begin")), "packing-begins")
    at = rows.join(begins, "part").withColumn("at", F.col("begin") + F.col("place"))
    first, last = F.floor(F.col("at") / length).cast("long"), F.floor((F.col("at") + F.col("tokens") - 1) / length).cast("long")
    pieces = at.select("doc_id", "at", "tokens", "ids", F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at"))
    stop = F.least(F.col("tokens"), (F.col("sequence_id") + 1) * length - F.col("at"))
    pieces = pieces.withColumn("start", start).withColumn("length", stop - F.col("start"))
    ids = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select("doc_id", "start", "length", ids.alias("ids"), F.col("tokens").alias("doc_tokens"), "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"))


def pieces(docs: DataFrame) -> DataFrame:
    """``pack`` with the ids' crc32 in their place."""
    return pack(docs).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
