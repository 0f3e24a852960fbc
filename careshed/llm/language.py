"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram is bound by multiplying its letters' vectors,
each rotated once more the earlier it stands; a text bundles (sums) its n-grams' vectors. The prototype of a
language is the bundle of all its learning texts, and a document takes the language of the nearest prototype
by cosine. Bundles are sums, so tasks add up n-gram counts and vectors in any order with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import in_arrow, in_fold, table

WIDTH, GRAM, SEED = 512, 3, 20_011
#: Code points taken together; a longer text is taken alone.
CHUNK = 1 << 19
#: Languages compared at a time; more are taken in further passes over the texts.
BLOCK = 4096
#: Distinct n-grams whose vectors are made together, and cells of a table of counts.
GRAMS, CELLS = 8192, 1 << 22


class Letters:
    """The letters' vectors, made as they are met; the same in every task."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram, self.known = width, gram, {}
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[:0x10000] = [chr(i).isalpha() for i in range(0x10000)]
        self.is_letter[0x10000:0x34000] = [chr(i).isalpha() for i in range(0x10000, 0x34000)]

    def vector(self, point: int) -> np.ndarray:
        if point not in self.known:
            self.known[point] = np.random.default_rng([SEED, point]).integers(0, 2, self.width, np.int8) * np.int8(2) - np.int8(1)
        return self.known[point]

    def bundles(self, texts: list[str | None], groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the n-grams' vectors for each group of texts, and how many n-grams it has; 0 stands between words."""
        parts = [np.frombuffer((" " + (t or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        row, point = np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate(parts)
        letter = self.is_letter[point]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of what stands between words only the first character
        keep[np.flatnonzero(np.diff(row, prepend=-1))] = True
        row, point = row[keep], np.where(letter, point, 0)[keep]
        symbols, code = np.unique(point, return_inverse=True)
        n, u = len(code) - self.gram + 1, len(symbols)
        out, found = np.zeros((n_groups, self.width)), np.zeros(n_groups, np.int64)
        if n < 1:
            return out, found
        key, middle = np.zeros(n, np.int64), np.zeros(n, bool)
        for j in range(self.gram):
            key = key * u + code[j : n + j]
            middle |= point[j : n + j] != 0
        good = (row[:n] == row[self.gram - 1 :]) & middle
        group, key = groups[row[:n][good]], key[good]
        found = np.bincount(group, minlength=n_groups)
        own = np.stack([self.vector(int(p)) for p in symbols])
        if u**self.gram <= 1 << 22:  # the numbers of the distinct n-grams by a table
            distinct = np.flatnonzero(np.bincount(key, minlength=1))
            at = np.zeros(u**self.gram, np.int64)
            at[distinct] = np.arange(len(distinct))
            number = at[key]
        else:
            distinct, number = np.unique(key, return_inverse=True)
        if len(distinct) > GRAMS:
            order = np.argsort(number, kind="stable")
            group, number = group[order], number[order]
        for a in range(0, len(distinct), GRAMS):
            some = distinct[a : a + GRAMS]
            vectors = np.ones((len(some), self.width), np.int8)
            for j in range(self.gram):
                vectors *= np.roll(own, self.gram - 1 - j, axis=1)[some // u ** (self.gram - 1 - j) % u]
            vectors = vectors.astype(np.float32)
            lo, hi = (0, len(number)) if len(distinct) <= GRAMS else np.searchsorted(number, (a, a + GRAMS))
            step = max(1, CELLS // len(some))
            for g in range(0, n_groups, step):
                mine = slice(lo, hi) if step >= n_groups else lo + np.flatnonzero((group[lo:hi] >= g) & (group[lo:hi] < g + step))
                rows = min(step, n_groups - g)
                count = np.bincount((group[mine] - g) * len(some) + number[mine] - a, minlength=rows * len(some)).reshape(rows, -1)
                out[g : g + rows] += count.astype(np.float32 if len(key) < 1 << 24 else np.float64) @ vectors  # whole numbers, so exact
        return out, found


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if texts:
        yield a, len(texts)


def prototypes(docs: DataFrame, learn: Column, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(lang, bundle) for every language, from all rows of ``docs`` for which ``learn`` holds."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(width, gram), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for a, b in _runs(texts):
                names, lang = np.unique(langs[a:b].astype(str), return_inverse=True)
                totals, _ = letters.bundles(texts[a:b], lang, len(names))
                for name, total in zip(names.tolist(), totals, strict=True):
                    sums[name] = sums.get(name, 0) + np.rint(total).astype(np.int64)
            if len(sums) > BLOCK:
                yield sent(sums)
                sums = {}
        yield sent(sums)

    def sent(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "bundle"])

    rows = docs.where(learn & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = in_arrow(rows, bundled, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("at", "value"))
    parts = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    return table(parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("bundle")), "language-prototypes")


def _blocks(prototypes: DataFrame, size: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The prototypes in order of language, ``size`` at a time."""
    last = None
    while True:
        rest = prototypes if last is None else prototypes.where(F.col("lang") > last)
        got = rest.orderBy("lang").limit(size).toArrow()
        if not got.num_rows:
            return
        names = got.column("lang").to_pylist()
        yield names, got.column("bundle").combine_chunks().flatten().to_numpy().reshape(len(names), -1).astype(np.float64)
        if len(names) < size:
            return
        last = names[-1]


def identify(docs: DataFrame, prototypes: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, lang_pred, score: the nearest prototype's language and the cosine with it, 0 if negative.

    Up to ``block`` prototypes are in memory at a time; each further block is one more pass that keeps the better of both.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast("string").alias("lang_pred"), F.lit(-2.0).alias("score"))
    for names, sums in _blocks(prototypes, block):
        unit = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        rows = in_arrow(rows, _nearer(names, unit, width, gram), "doc_id long, text string, lang_pred string, score double")
    lang = F.coalesce("lang_pred", F.lit("und"))
    return rows.select("doc_id", lang.alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(F.round(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), 6)).alias("score"))


def _nearer(names: list[str], unit: np.ndarray, width: int, gram: int):
    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(width, gram)
        for batch in batches:
            texts, lang, score = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for a, b in _runs(texts):
                docs, found = letters.bundles(texts[a:b], np.arange(b - a), b - a)
                cosine = (docs.astype(np.float32) @ unit.T) / np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-12)
                for i, k in enumerate(cosine.argmax(axis=1).tolist()):
                    if found[i] and cosine[i, k] > score[a + i]:
                        lang[a + i], score[a + i] = names[k], float(cosine[i, k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "text", "lang_pred", "score"])

    return nearer


def held_out(doc_id: Column) -> Column:
    return in_fold(doc_id, 4, 2)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    * Prototypes are learned from text and non-null lang of all documents whose id is not held out (crc32 of the
      id as text, modulo 4, is 2); lang, source and doc_id have no part in a prediction.
    * A null text, or one without a letter, gets ``und`` and score 0; so does everything if nothing is learned.
    * Every language with a learning document has a prototype, however many there are. A text of any length is
      bundled whole, in tables of bounded size. doc_id is cast to long: an id that is no whole number fails.
    * Equal cosines go to the first language by name. Repeated rows are judged each. A null id is judged too.
      An empty table gives an empty result; columns other than doc_id, text and lang are not looked at.
    """
    found = identify(docs, prototypes(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
