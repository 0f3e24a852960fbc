"""Document quality by supervised subword embeddings.

Words, character n-grams and word pairs are hashed into buckets, each bucket has a learned vector, a document is
the mean of its features' vectors, and a softmax layer gives the class. Training is stochastic gradient descent
in numpy, in one task over a bounded sample of labelled documents; scoring runs over all documents in parallel.
The softmax of two classes needs only the difference of their rows, so for scoring the vectors are folded with
it once into one number for each bucket; the sum is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import in_arrow, in_fold
from careshed.llm.words import _BYTE, _power, mix64, text_chunks, word_hashes, words_of

BUCKETS, WIDTH = 1 << 17, 16
#: Bytes of the character n-grams; white space may stand at an n-gram's ends only, so words' edges are seen.
GRAMS = (3, 4)
EPOCHS, RATE = 6, 2.0
#: At most so many labelled documents are learned from: those with the least hash of their id.
SAMPLE = 4096
THRESHOLD = 0.3
_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[[9, 10, 11, 12, 13]] = 32


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        return self.vectors @ (self.weights[1] - self.weights[0]), float(self.bias[1] - self.bias[0])


def features(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the features of a run of rows, kind by kind: words, word pairs, character n-grams.

    A word that repeats the one before it makes the same pair whatever the word is.
    """
    mask = np.uint64(BUCKETS - 1)
    starts, ends, first = words_of(off, data)
    words = word_hashes(data, starts, ends, lower=False)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    yield row, (words & mask).astype(np.int64)
    if len(words) > 1:
        pair = np.where(words[1:] == words[:-1], np.uint64(0x77), mix64(words[:-1] * np.uint64(3) + words[1:]))
        same = row[1:] == row[:-1]
        yield row[1:][same], (mix64(pair[same]) & mask).astype(np.int64)
    if len(data):
        flat = _FLAT[data]
        up, down = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[flat] * up[:-1], out=total[1:])
        space = np.concatenate(([0], np.cumsum(flat == 32)))
        place = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n in GRAMS:
            at = np.arange(len(data) - n + 1)
            at = at[(place[: len(at)] == place[n - 1 :]) & (space[n - 1 : n - 1 + len(at)] == space[1 : 1 + len(at)])]
            yield place[at], (mix64((total[at + n] - total[at]) * down[at] + np.uint64(n)) & mask).astype(np.int64)


def _bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) for each row."""
    for _, off, data in text_chunks(column):
        rows, buckets = (np.concatenate(x) for x in zip(*features(off, data), strict=True))
        key, count = np.unique(rows * BUCKETS + buckets, return_counts=True)
        edge = np.searchsorted(key, np.arange(len(off)) * BUCKETS)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield key[a:b] % BUCKETS, count[a:b] / max(count[a:b].sum(), 1)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Train on documents (distinct buckets, their shares) and 0/1 labels; without any label the model is indifferent."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32), rng.uniform(-1 / WIDTH, 1 / WIDTH, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32))
    if not bags:
        return model
    model.bias[:] = np.log(np.bincount(labels, minlength=2) + 1.0)
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            eta, (buckets, share) = np.float32(rate * (1 - step / steps)), bags[i]
            step += 1
            mean = share @ model.vectors[buckets]
            z = model.weights @ mean + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ model.weights
            model.weights -= eta * np.outer(p, mean)
            model.bias -= eta * np.float32(0.05) * p
            if len(buckets):  # scaled by the largest share, or the features of long documents would hardly move
                model.vectors[buckets] -= (eta * share / share.max())[:, None] * back
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from the rows of ``labels`` for which ``learn`` holds, at most ``sample`` of them."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").cast("int").alias("label"))  # of a repeated id the last text

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(b.astype("<i4").tobytes(), s.astype("<f4").tobytes()) for b, s in _bags(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([h[i] for h in held], pa.binary()) for i in (0, 1))], names=["doc_id", "label", "buckets", "shares"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        m = fit([(np.frombuffer(b, "<i4"), np.frombuffer(s, "<f4")) for _, _, b, s in got], np.array([r[1] for r in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (m.vectors, m.weights, m.bias)], names=["vectors", "weights", "bias"])

    bags = in_arrow(rows.select(F.col("doc_id").cast("long"), "text", "label"), bagged, "doc_id long, label int, buckets binary, shares binary")
    got = in_arrow(bags.repartition(1), learned, "vectors binary, weights binary, bias binary").first()  # at most ``sample`` documents of at most 8 * BUCKETS bytes
    if got is None:  # no labelled document, and so no task
        return fit([], np.zeros(0, np.int64))
    return Model(*(np.frombuffer(bytes(x), np.float32).reshape(shape) for x, shape in zip(got, ((BUCKETS, WIDTH), (2, WIDTH), (2,)), strict=True)))


def _judge(model: Model) -> Callable[[pa.Array], np.ndarray]:
    table, bias = model.folded()
    table = table.astype(np.float32)

    def judge(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, off, data in text_chunks(texts):
            rows = len(off) - 1
            total, number = np.zeros(rows), np.zeros(rows)
            for row, bucket in features(off, data):
                total += np.bincount(row, table[bucket], rows)
                number += np.bincount(row, minlength=rows)
            out[a : a + rows] = 1 / (1 + np.exp(-np.clip(total / np.maximum(number, 1) + bias, -60, 60)))
        return out

    return judge


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with score, the probability of class 1; the mean over the whole text."""
    judge = _judge(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge(batch.column(1)))], names=["doc_id", "score"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scored, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return in_fold(doc_id, 5, 0)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    * Labels are learned only from rows whose id is not held out (crc32 of the id as text, modulo 5, is 0) and
      whose label is 0 or 1; of an id with two labels the larger counts. At most ``sample`` of them are used.
    * Texts of any length are scored whole; a document that is learned from is sent on as at most BUCKETS features.
      doc_id is cast to long: an id that is no whole number fails. Of a repeated id the greatest text is learned.
    * Null and empty texts have no features and get the score of the class sizes alone; a null id is scored too.
    * Without any label all scores are 0.5 or near it. Repeated rows are scored each. An empty table gives an
      empty result; columns other than doc_id, text and quality are not looked at.
    """
    model = train(docs, labels, ~held_out(F.col("doc_id")), sample=sample)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; the model is learned as for ``quality``."""
    judge, at = _judge(train(docs, labels, ~held_out(F.col("doc_id")), sample=sample)), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at)) >= threshold))

    return in_arrow(docs, kept, docs.schema)
