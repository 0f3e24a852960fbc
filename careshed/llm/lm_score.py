"""Stupid-backoff language-model scores, computed as joins of n-gram count tables with the documents' n-grams.

Bigrams of public BPE tokens. The token table has one row for each id of the vocabulary, a proven bound, and is
broadcast. The bigram table is cut into buckets by hash. A first pass counts: every task adds up its bigrams and
sends one packed row to each bucket it has met. A second pass explodes the documents into their distinct bigrams,
again packed by bucket, meets them with the bucket's counts, and sends one packed row of partial sums back for each run
of documents, where they are added up.

Packed rows hold sorted arrays, so a bucket's rows are joined by binary search. A bucket with many n-grams (a
very frequent bigram stands in all documents) is dealt to several tasks, each with a copy of its counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import in_arrow, table
from careshed.llm.tokens import encoder

#: Id that stands before a document's first token, and the number of ids with it.
START, IDS = 50_256, 50_257
#: Stands for a null document id inside packed rows.
NO_ID = np.iinfo(np.int64).min
#: Back-off factor.
BACKOFF = 0.4
#: Characters of text whose n-grams are packed together.
CHUNK = 1 << 21


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _packs(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """Runs of rows: (row numbers, ids, row of each bigram, bigram); a bigram is left id * 2**16 + right id."""
    encode, seen = encoder(path), 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = 0
        while a < len(texts):
            b, size, parts = a, 0, []
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= CHUNK):
                size += len(texts[b] or "")
                parts.append(np.array([START, *encode(texts[b] or "")], np.uint64))
                b += 1
            row = np.repeat(np.arange(b - a), [len(p) - 1 for p in parts])
            key = np.concatenate([(p[:-1] << np.uint64(16)) | p[1:] for p in parts])
            yield np.arange(seen, seen + b - a), ids[a:b], row, key
            seen += b - a
            a = b


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b > a:
            yield int(bucket[a]), a, b


def bigram_counts(docs: DataFrame, buckets: int, path: str | None = None) -> DataFrame:
    """(bucket, keys, counts) of all bigrams of all rows, one packed row for each bucket, sorted by key."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

        def send(keys, counts):
            bucket = _bucket(keys, buckets)
            order = np.lexsort((keys, bucket))
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            for k, a, b in _cuts(bucket):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([keys[a:b].astype("<u4").tobytes()], pa.binary()), pa.array([counts[a:b].astype("<i8").tobytes()], pa.binary())], names=["bucket", "keys", "counts"])

        for _, _, _, key in _packs(batches, path):
            held.append(np.unique(key, return_counts=True))
            if len(held) >= 8:
                held = [merged()]
                if len(held[0][0]) > 4_000_000:
                    yield from send(*held.pop())
        if held:
            yield from send(*merged())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def out():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(at, np.concatenate(counts), len(k)).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([k.astype("<u4").tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["bucket", "keys", "counts"])

        for batch in batches:
            for b, k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != now and now is not None:
                    yield out()
                    keys, counts = [], []
                now = b
                keys.append(np.frombuffer(k, "<u4"))
                counts.append(np.frombuffer(c, "<i8"))
                if len(keys) > 64:
                    k, at = np.unique(np.concatenate(keys), return_inverse=True)
                    keys, counts = [k], [np.bincount(at, np.concatenate(counts), len(k)).astype("<i8")]
        if now is not None:
            yield out()

    schema = "bucket int, keys binary, counts binary"
    sent = in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), counted, schema)
    return in_arrow(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), summed, schema)


def _token_counts(counts: DataFrame) -> np.ndarray:
    """How often each id stands on the left and on the right: 2 rows of IDS numbers."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, IDS), np.int64)
        for batch in batches:
            for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k, c = np.frombuffer(k, "<u4"), np.frombuffer(c, "<i8")
                total[0] += np.bincount(k >> 16, c, IDS).astype(np.int64)
                total[1] += np.bincount(k & 0xFFFF, c, IDS).astype(np.int64)
        side, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()), pa.array(at, pa.int64()), pa.array(total[side, at])], names=["side", "id", "count"])

    out = np.zeros((2, IDS), np.int64)
    for r in in_arrow(counts, ends, "side long, id long, count long").groupBy("side", "id").agg(F.sum("count").alias("count")).collect():  # at most 2 * IDS rows
        out[r.side, r.id] = r["count"]
    return out


def lm_scores(docs: DataFrame, backoff: float = BACKOFF, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, log_score, mean_log_score for each row of ``docs``; scores are rounded to 6 places.

    The score of a token w after v is others(v w) / count(v), where others is how often the bigram stands in all other
    rows, if it stands in any; otherwise backoff * count(w) / (number of tokens). Before the first token stands a start
    mark. count is of all rows, the scored one included; bigrams are never dropped, however rare.

    * Texts of any length are scored whole. doc_id is cast to long: an id that is no whole number fails.
    * A null or empty text has no tokens, log_score 0 and mean_log_score null.
    * Repeated rows are counted and scored each. A null id is scored too. An empty table gives an empty result;
      columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = table(bigram_counts(docs, buckets, path), "lm-counts")
    left, right = _token_counts(counts)
    log_left, log_right = np.log(np.maximum(left, 1)), np.log(np.maximum(right, 1)) + np.log(backoff) - np.log(max(right.sum(), 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [int(np.frombuffer(c, "<i8").sum()) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=["bucket", "total"])

    load = {r.bucket: r.total for r in in_arrow(counts.select("bucket", "counts"), weigh, "bucket int, total long").collect()}  # a row for each bucket
    usual = 2 * sum(load.values()) / buckets + 1
    parts = {b: 1 + int(n // usual) for b, n in load.items()}

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mark, turn = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId()
        for rows, ids, row, key in _packs(batches, path):
            turn += 1
            both, times = np.unique((row.astype(np.uint64) << np.uint64(32)) | key, return_counts=True)
            row, key = (both >> np.uint64(32)).astype("<u4"), both & np.uint64(0xFFFFFFFF)
            bucket = _bucket(key, buckets)
            order = np.lexsort((key, bucket))  # equal keys stand together, so their differences compress to nothing
            row, key, times, bucket = row[order], key[order].astype("<u4"), times[order].astype("<u4"), bucket[order]
            sent = [(k, turn % parts.get(k, 1), np.diff(key[a:b], prepend=np.uint32(0)).tobytes(), row[a:b].astype("<u2" if len(ids) < 65_536 else "<u4").tobytes(), times[a:b].astype("u1").tobytes() if times[a:b].max() < 256 else times[a:b].tobytes()) for k, a, b in _cuts(bucket)]
            first, name = mark + int(rows[0]), np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()
            sent.append((-1, turn, name, np.bincount(row, times, len(ids)).astype("<u4").tobytes(), b""))  # the rows themselves
            k, part, keys, at, n = (list(x) for x in zip(*sent, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(part, pa.int32()), pa.array([first] * len(k), pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "part", "first", "keys", "rows", "times"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for bucket, first, keys, rows, times in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if bucket < 0:
                    out.append((first, keys, rows, None, None))
                elif first < 0:  # the bucket's counts come before its n-grams
                    known, number = np.frombuffer(keys, "<u4"), np.frombuffer(rows, "<i8")
                else:
                    keys = np.cumsum(np.frombuffer(keys, "<u4"), dtype=np.uint32)
                    rows = np.frombuffer(rows, "<u2" if len(rows) == 2 * len(keys) else "<u4").astype(np.int64)
                    times = np.frombuffer(times, "u1" if len(times) == len(keys) else "<u4")
                    others = number[np.searchsorted(known, keys)] - times
                    value = np.where(others > 0, np.log(np.maximum(others, 1)) - log_left[keys >> 16], log_right[keys & 0xFFFF]) * times
                    sums, met = np.bincount(rows, value), np.flatnonzero(np.bincount(rows))
                    out.append((first, None, None, met.astype("<u4").tobytes(), sums[met].tobytes()))
            first, ids, tokens, rows, sums = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), *(pa.array(x, pa.binary()) for x in (ids, tokens, rows, sums))], names=["first", "ids", "tokens", "rows", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def done():
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(tokens), pa.array(score)], names=["doc_id", "n_tokens", "score"])

        for batch in batches:
            for name, count, rows, sums in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if name is not None:  # the rows of a run come before their sums
                    yield done()
                    ids, tokens = np.frombuffer(name, "<i8"), np.frombuffer(count, "<u4").astype(np.int64)
                    score = np.zeros(len(ids))
                else:
                    score[np.frombuffer(rows, "<u4")] += np.frombuffer(sums, "<f8")
        yield done()

    schema = "bucket int, part int, first long, keys binary, rows binary, times binary"
    ngrams = in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), exploded, schema)
    part = F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for b, n in parts.items() if n > 1 for x in (b, n)]), F.col("bucket")), F.lit(1)) - 1)) if max(parts.values(), default=1) > 1 else F.lit(0)
    copies = counts.select("bucket", part.alias("part"), F.lit(-1).cast("long").alias("first"), "keys", F.col("counts").alias("rows"), F.lit(b"").alias("times"))
    met = ngrams.unionByName(copies).repartition(buckets, "bucket", "part").sortWithinPartitions("bucket", "part", "first")
    partial = in_arrow(met, scored, "first long, ids binary, tokens binary, rows binary, sums binary")
    partial = partial.repartition(buckets, "first").sortWithinPartitions("first", F.col("ids").isNull())
    sums = in_arrow(partial, summed, "doc_id long, n_tokens long, score double")
    score = F.round("score", 6) + F.lit(0.0)
    return sums.select("doc_id", "n_tokens", score.alias("log_score"), F.round(F.try_divide("score", "n_tokens"), 6).alias("mean_log_score"))
