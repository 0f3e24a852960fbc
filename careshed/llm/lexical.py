"""Ranked lexical search by a K2-treap over the grid of query terms (rows) and documents (columns).

A task reads its documents in chunks. A chunk's grid is cut into quadrants again and again; only cells that hold a
posting are kept, each as the number of its first child, a mask of the four children and the greatest impact inside.
An item follows the paths of all its terms' rows down at once: a range of documents is one cell for each row, and its
bound is the sum of the cells' maxima by weight. Ranges with the best bounds are taken first, in batches, until no range
left can reach the item's list, so a range is never entered for documents that cannot matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careshed.llm.common import in_arrow, table
from careshed.llm.words import text_chunks, word_hashes, words_of

#: What is no part of a term, in a Java or RE2 character class, and the letters that are lower-cased.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_DOWN = np.arange(256, dtype=np.uint8)
_DOWN[65:91] += 32
#: Documents and postings of one grid, ranges that an item enters at a time, (item, term) rows that the driver and each
#: task hold at a time (more items are searched in blocks), and parts in which an item's lists are cut before the last.
DOCUMENTS, POSTINGS, WIDTH, QUERY_ROWS, PARTS = 1 << 15, 1 << 20, 256, 1 << 20, 64
_CHILDREN = np.array([bin(x).count("1") for x in range(16)], np.int64)


class Vocabulary:
    """The terms of a block of items; finds them among a text's words by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(sizes)
        hashes = word_hashes(data, ends - sizes, ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[self.order], data
        self.starts, self.sizes = (ends - sizes)[self.order], sizes[self.order]
        self.most = int(np.unique(hashes, return_counts=True)[1].max()) if len(raw) else 0  # terms with one hash

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word the number of its term, or -1."""
        out, words = np.full(len(starts), -1, np.int64), word_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, words)
        for _ in range(self.most):
            hit = np.flatnonzero((out < 0) & (at < len(self.hashes)))
            hit = hit[(self.hashes[at[hit]] == words[hit]) & (self.sizes[at[hit]] == ends[hit] - starts[hit])]
            if len(hit):
                size = self.sizes[at[hit]]
                first = np.cumsum(size) - size
                inside = np.arange(int(size.sum())) - np.repeat(first, size)
                same = _DOWN[data[np.repeat(starts[hit], size) + inside]] == self.data[np.repeat(self.starts[at[hit]], size) + inside]
                hit = hit[np.logical_and.reduceat(same, first)]
                out[hit] = self.order[at[hit]]
            at = at + 1
        return out


def _postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have a term at all; the arrays hold the items' terms only."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # of at most QUERY_ROWS (item, term) rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(sent.value)
        for batch in batches:
            n, found, times = [], [], []
            for _, off, data in text_chunks(batch.column(1)):
                starts, ends, first = words_of(off, data, BETWEEN)
                at = known.find(data, starts, ends)
                n += (first[1:] - first[:-1]).tolist()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    ids, counts = np.unique(at[a:b][at[a:b] >= 0], return_counts=True)
                    found.append(ids.astype(np.int32).tobytes()), times.append(counts.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, "doc_id long, n long, terms binary, tfs binary").where("n > 0")


def _frequencies(postings: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term: one number for each term of the block of items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(terms, np.int64)
        for batch in batches:
            own += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=terms)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in in_arrow(postings.select("terms"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


class Grid:
    """A K2-treap of points (row, column, impact): levels of cells from the whole grid to single points."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.height = max(1, int(max(rows.max(), columns.max())).bit_length())
        code = np.zeros(len(rows), np.int64)
        for bit in range(self.height):
            code |= (rows >> bit & 1) << (2 * bit + 1) | (columns >> bit & 1) << (2 * bit)
        order = np.argsort(code, kind="stable")
        code, top = code[order], impacts[order]
        self.top, self.first, self.mask = [np.append(top, 0)], [], []  # the last cell of each level is no cell
        for _ in range(self.height):
            parent = code >> 2
            new = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            self.mask.append(np.append(np.bitwise_or.reduceat(1 << (code & 3), new), 0))
            self.first.append(np.append(new, 0))
            code, top = parent[new], np.maximum.reduceat(top, new)
            self.top.append(np.append(top, 0))
        for x in (self.top, self.first, self.mask):
            x.reverse()

    def children(self, level: int, cells: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The cells below ``cells`` (ranges x rows, -1 for none) in the rows' halves, of the left ranges and the right ones."""
        mask, first, out = self.mask[level][cells], self.first[level][cells], []
        for right in (0, 1):
            q = 2 * bits + right
            out.append(np.where(mask >> q & 1, first + _CHILDREN[mask & (1 << q) - 1], -1))
        return np.concatenate(out)


class Best:
    """The k best (score, document) so far, equal scores by ascending document, none last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = 1  # a score below this cannot enter

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = np.concatenate((self.score, score)), np.concatenate((self.doc, doc)), np.concatenate((self.none, none))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]
        self.least = int(self.score[-1]) if len(order) == self.k else 1


def descend(grid: Grid, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray, none: np.ndarray, best: Best) -> int:
    """Add to ``best`` what the grid's documents (numbers ``docs``) have for an item; returns how many ranges were entered."""
    bound = int((grid.top[0][0] * weights).sum())
    queue = [(-bound, 0, 0, np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64), np.array([bound]))]
    entered = pushed = 0
    while queue and -queue[0][0] >= best.least:
        _, _, level, ranges, cells, bounds = heapq.heappop(queue)
        parts = [(ranges, cells, bounds)]
        if len(ranges) > WIDTH:
            keep = np.flatnonzero(bounds >= best.least)
            keep = keep[np.argsort(-bounds[keep], kind="stable")]
            parts = [tuple(x[at] for x in (ranges, cells, bounds)) for at in (keep[:WIDTH], keep[WIDTH:]) if len(at)]
        if len(parts) > 1:
            pushed += 1
            heapq.heappush(queue, (-int(parts[1][2][0]), pushed, level, *parts[1]))
        ranges, cells, _ = parts[0]
        entered += len(ranges)
        below = grid.children(level, cells, rows >> (grid.height - level - 1) & 1)
        bounds = grid.top[level + 1][below] @ weights
        ranges = np.concatenate((2 * ranges, 2 * ranges + 1))
        keep = np.flatnonzero(bounds >= best.least)
        if level + 1 == grid.height:
            best.add(bounds[keep], docs[ranges[keep]], none[ranges[keep]])
        elif len(keep):
            pushed += 1
            heapq.heappush(queue, (-int(bounds[keep].max()), pushed, level + 1, ranges[keep], below[keep], bounds[keep]))
    return entered


def _search(postings: DataFrame, items: list[list[int]], row: np.ndarray, weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item."""
    sent = postings.sparkSession.sparkContext.broadcast((items, row, weight))  # of at most QUERY_ROWS (item, term) rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, row, weight = sent.value
        queries = [(i, row[x], weight[x]) for i, x in ((i, np.array(terms)) for i, terms in enumerate(items)) if len(x)]
        best = {i: Best(k) for i, _, _ in queries}
        held: list[tuple] = []
        size = 0

        def flush() -> None:
            columns = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            terms, tf = (np.concatenate([h[x] for h in held]).astype(np.int64) for x in (2, 3))
            m = np.array([50 + 50 * h[1] * total // length for h in held], np.int64)
            if len(terms):
                grid = Grid(row[terms], columns, 1_000_000_000 * tf // (1000 * tf + 20 * m[columns]))
                docs, none = np.array([h[0] or 0 for h in held], np.int64), np.array([h[0] is None for h in held])
                docs, none = (np.concatenate((x, np.zeros((1 << grid.height) - len(x), x.dtype))) for x in (docs, none))
                for i, rows, weights in queries:
                    descend(grid, rows, weights, docs, none, best[i])
            held.clear()

        for batch in batches:
            for doc, n, terms, tfs in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                terms, tfs = np.frombuffer(terms, np.int32), np.frombuffer(tfs, np.int32)
                if held and (len(held) == DOCUMENTS or size + len(terms) > POSTINGS):
                    flush()
                    size = 0
                held.append((doc, n, terms, tfs))
                size += len(terms)
        if held:
            flush()
        for i, b in best.items():
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), i, np.int32)), pa.array(b.doc, mask=b.none), pa.array(b.score)], names=["item", "doc_id", "score"])

    return in_arrow(postings.select("doc_id", "n", "terms", "tfs"), search, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score, only scores above 0.

    Terms are maximal runs of digits, letters and characters beyond ASCII, with A-Z in lower case. A term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), N documents having terms; a document adds the weight times
    10^9 tf div (1000 tf + 20 m) with m = 50 + 50 n N div L, in 64-bit integers, for each of the item's distinct terms.

    * Whole texts of every length are read. A null or empty text, or one without terms, is in no result and not in N.
    * Equal scores are in order of doc_id, null last. Rows that share a doc_id are documents of their own.
    * Items without terms have no rows. Rows that share an item_id (null too) are one item with the terms of all.
    * An empty table of documents or items gives an empty result; other columns are not looked at. doc_id is cast to
      long: an id that is no whole number fails. item_id may have any type.
    * Items are searched in blocks of at most QUERY_ROWS (item, term) rows, so what is broadcast is bounded.
    """
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    pairs = table(items.select("item_id", F.explode(terms).alias("term")).distinct(), "search-items")
    blocks = -(-pairs.count() // QUERY_ROWS)
    schema = pairs.select("item_id").schema.add("rank", "integer").add("doc_id", "long").add("score", "long")
    found: list[DataFrame] = []
    for block in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(F.collect_list("term").alias("terms"))
        rows = rows.orderBy("item_id").collect()  # QUERY_ROWS terms on average; one item's text at least
        words = sorted({t for r in rows for t in r.terms})
        if not words:
            continue
        number = {t: i for i, t in enumerate(words)}
        postings = table(_postings(docs, words), "search-postings")
        total, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            continue
        df = _frequencies(postings, len(words))
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        row = np.argsort(np.argsort(df, kind="stable"), kind="stable")  # terms about as frequent stand together
        asked = [[number[t] for t in r.terms if weight[number[t]] and df[number[t]]] for r in rows]
        best = _search(postings, asked, row, weight, total, length, k)
        order = (F.desc("score"), F.asc_nulls_last("doc_id"))
        parts = table(best.withColumn("part", F.spark_partition_id() % PARTS), "search-best")
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], pairs.select(F.lit(0).alias("item"), "item_id").schema)
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # an item has a term at least
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def sql(k: int = 50) -> str:
    """The same ranking in DuckDB SQL, every document scored."""
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH t AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= {k}
"""
