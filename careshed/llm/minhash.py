"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation of the hash ring scatters the shingles, a second one, applied to circular shifts of the first,
gives every signature coordinate. Five coordinates make a band; documents that agree on a band share a bucket.

1. Documents with the same shingle set collapse into one class before anything is compared.
2. In each bucket every class is linked with the bucket's least id (a star, so rows stay linear in the bucket's
   size), each such link is verified on the full sets, and the links are joined into components.
3. In buckets that still hold several components all pairs are compared on the full sets, inside the tasks:
   large buckets are dealt as pairs of blocks of bounded size, shared shingles are counted by matrix products,
   and only links that join components leave a task, fewer than it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import checked_broadcast, in_arrow, join_hot, table
from careshed.llm.components import components
from careshed.llm.words import row_shingles

ROWS, BANDS, SHINGLE = 5, 40, 5
#: Members of a block of a bucket, and parts to which the members of a star's centre are dealt.
BLOCK, PARTS = 256, 64
#: Shingles that are counted by one matrix product.
COLUMNS = 4096
#: Ids that may be broadcast to pick documents (at most 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _ring(x: np.ndarray) -> np.ndarray:
    """In place, a permutation of the 32-bit ring."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least second permutation of (first permutation + k shifts), over all shingles."""
    first = (shingles >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1)  # shingle hashes are scattered already
    shifts = np.arange(coordinates, dtype=np.uint32) * np.uint32(0x61C88647)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(first), 256):
        np.minimum(least, _ring(first[a : a + 256, None] + shifts).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, rows: int, bands: int, k: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from careshed.llm.words import mix64

        lane = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, keys, sets = [], [], []
            for s in row_shingles(batch.column(1), k):
                n.append(len(s))
                if len(s):
                    sig = signature(s, rows * bands)
                    key = lane.copy()
                    for j in range(rows):
                        key = mix64(key ^ sig[j::rows])
                    sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(key.view(np.int64))
                else:
                    sets.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sign, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids`` (id)."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in row_shingles(batch.column(1), k)], pa.binary())], names=["doc_id", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return in_arrow(wanted, shingle, "doc_id long, shingles binary")


def _picked(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The shingles of the documents in ``ids`` (id), written once."""
    ids = table(ids.distinct(), "minhash-ids")
    return table(_sets(docs, checked_broadcast(ids, ids.count(), BROADCAST_IDS), k), "minhash-sets")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    The members b of a centre a are dealt to PARTS parts, each with one copy of the centre's set, which a task
    holds while the members' sets stream by.
    """
    sets = _picked(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), k)
    members = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int").alias("part"), F.col("b").alias("doc_id"))
    centres = members.select("a", "part").distinct().withColumn("doc_id", F.col("a"))
    sent = members.unionByName(centres).join(sets, "doc_id").withColumn("member", F.col("a") != F.col("doc_id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(n, "a", "part").sortWithinPartitions("a", "part", "member").select("a", "part", "doc_id", "member", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            a, ids, member, sets = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            good = np.zeros(len(a), bool)
            for i, m in enumerate(member.tolist()):
                own = np.frombuffer(sets[i].as_buffer(), np.uint64)
                if not m:
                    centre = own
                    continue
                both = len(own) + len(centre)
                if 100 * min(len(own), len(centre)) >= percent * max(len(own), len(centre)):
                    x = np.sort(np.concatenate((own, centre)))
                    shared = int((x[1:] == x[:-1]).sum())
                    good[i] = 100 * shared >= percent * (both - shared)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(ids[good])], names=["a", "b"])

    return in_arrow(sent, compare, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets (sorted, distinct) share."""
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(times > 1) - 1  # elements of one set only are shared with nobody
    own, column = own[times[column] > 1], often[column[times[column] > 1]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    for a in range(0, int(often[-1]) + 1 if len(often) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[own[lo:hi], column[lo:hi] - a] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def joining_links(ids: list[int], groups: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, enough to join all groups that any links join."""
    size = np.array([len(x) for x in sets])
    both = shared_counts(sets)
    linked = 100 * both >= percent * (size[:, None] + size - both)
    label, found = np.unique(np.array(groups), return_inverse=True)[1], []
    for x in range(len(ids)):
        to = np.flatnonzero(linked[x] & (label != label[x]))
        for other, at in zip(*np.unique(label[to], return_index=True), strict=True):
            y = int(to[at])
            found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
            label[label == other] = label[x]
    return found


def _across(docs: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket; ``placed`` has key, id, component.

    A bucket of more than BLOCK members is dealt as pairs of blocks; a task holds two blocks' sets at a time.
    """
    sizes = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = table(sizes.where("lo < hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "minhash-open")
    member = table(placed.join(sizes, "key"), "minhash-members")
    sets = _picked(docs, member.select("id"), k)
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    dealt = member.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("id").alias("doc_id"), "component").join(sets, "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "doc_id", "component", "shingles")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, groups, sets, out = None, [], [], [], set()
        for batch in batches:
            shingles = batch.column(5)
            for r, at in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if at != now:
                    if len(ids) > 1:
                        out.update(joining_links(ids, groups, sets, percent))
                    now, ids, groups, sets = at, [], [], []
                ids.append(batch.column(3)[r].as_py())
                groups.append(batch.column(4)[r].as_py())
                sets.append(np.frombuffer(shingles[r].as_py(), np.uint64))
        if len(ids) > 1:
            out.update(joining_links(ids, groups, sets, percent))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return in_arrow(dealt, search, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, rows: int = ROWS, bands: int = BANDS, k: int = SHINGLE) -> DataFrame:
    """Components of documents linked by Jaccard similarity of their k-word shingle sets of ``percent`` or more.

    Returns doc_id, n_shingles, component_id, kept, one row for each input row.

    * Words are maximal runs of bytes other than ASCII white space, with A-Z in lower case; a text of fewer than
      k words has one shingle, all of it; a null, empty or blank text has none and is linked with nothing.
    * component_id is the least doc_id reachable; kept says that it is the row's own.
    * Texts of any length are compared on their whole sets. doc_id is cast to long: an id that is no whole number fails.
    * A null doc_id is linked with nothing: component_id null, kept true.
    * Repeated rows are linked by their equal sets and all appear. An empty table gives an empty result; columns
      other than doc_id and text are not looked at.
    """
    signed = table(signatures(docs, rows, bands, k), "minhash-signatures")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = table(linked.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "minhash-classes")
    # by the id as well, so that copies of one text do not meet in a task
    reps = linked.join(classes.select(F.col("rep").alias("doc_id"), "set_id"), ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id", "set_id"])
    keyed = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("centre")).where("size > 1")
    buckets = table(keyed.join(shared.select("key", "centre"), "key"), "minhash-buckets")

    stars = buckets.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = table(_verified(docs, table(stars, "minhash-stars"), k, percent), "minhash-links")
    first = components(links)
    placed = table(buckets.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "minhash-placed")
    more = table(_across(docs, placed, k, percent), "minhash-links")
    joined = first if more.isEmpty() else components(links.unionByName(more))

    classes = classes.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select("set_id", "copies", F.coalesce("component", "rep").alias("component_id"))
    classes = table(classes, "minhash-components")
    held = linked.select("doc_id", "n_shingles", "set_id")
    out = join_hot(held, classes, "set_id", "copies", held.count()).select("doc_id", "n_shingles", "component_id")
    # rows without shingles or id have no class and stay out of the join
    out = out.unionByName(signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id")))
    own: Column = F.col("component_id")
    return out.select("doc_id", "n_shingles", own, F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def sql(percent: int = 75, k: int = SHINGLE) -> str:
    """The components by brute force in DuckDB SQL: all pairs that share a shingle, counted on the full sets."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS m FROM s UNION SELECT p.b AS id, r.m FROM r JOIN p ON p.a = r.id WHERE r.m < p.b),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""
