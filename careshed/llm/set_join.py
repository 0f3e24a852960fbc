"""Exact Jaccard join of word shingle sets by set-relation skipping, reported as components of linked documents.

The join rests on prefix filtering in a global order of the shingles, rarest first by a sketch of fixed size: two
sets that are similar enough share a shingle within their prefixes.

1. Equal sets are one class. Classes that agree on a least hash are compared with the least id among them; a class
   found similar to one that follows nobody becomes its follower, and what the two do not share is kept (its delta).
2. Index lists hold a leader once for all of its followers that have the shingle in their own prefix, and a follower
   only under prefix shingles that its leader's prefix lacks. An entry knows the least and greatest size of what it
   stands for and the most shingles left from its position on.
3. A list is ordered by size, and in a block of one size by what is left, so a probe skips the rest of a block as soon
   as the shingles left cannot make the overlap, and whole blocks of other sizes. Entries of one component are skipped.
4. Candidates are verified on their full sets. Where two leaders are not linked but their followers might be by the
   triangle inequality, the followers' overlaps are derived from the leaders' one and the deltas alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careshed.llm import minhash
from careshed.llm.common import checked_broadcast, in_arrow, join_hot, table
from careshed.llm.components import components
from careshed.llm.words import row_shingles

SHINGLE, PERCENT = 5, 80
#: Cells of the sketch that orders shingles by how often they occur (8 MB), and the parts in which tasks send theirs.
CELLS, SLICES = 1 << 20, 16
#: Least hashes by which a class looks for a leader: the sets' own order and multiples of it.
LANES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Entries of a list that one task holds; a longer list is dealt as pairs of blocks.
LIST = 1 << 16
#: Followers on each side that one task compares, delta shingles of one matrix product, members of a centre that meet one
#: copy of its set, and bytes of sets that are sent at a time.
BLOCK, COLUMNS, MEMBERS, SENT = 256, 4096, 512, 8 << 20
#: Ids that may be broadcast (at most 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rounding of distances that are compared as doubles; bounds are loosened by it.
EPS = 1e-9


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, n_shingles, set_id, keys), and SLICES rows of each task with its part of the sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, names = np.zeros(CELLS, np.int64), ["doc_id", "n_shingles", "set_id", *(f"k{j}" for j in range(len(LANES))), "slice", "counts"]
        lanes = [np.uint64(x) for x in LANES]
        for batch in batches:
            n, digests, keys, cells = [], [], [], []
            for s in row_shingles(batch.column(1), k):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append([int((s * x).min().view(np.int64)) for x in lanes] if len(s) else [None] * len(lanes))
                cells.append(_cell(s))
            if cells:
                sketch += np.bincount(np.concatenate(cells), minlength=CELLS)
            columns = [pa.array([row[j] for row in keys], pa.int64()) for j in range(len(lanes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *columns, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        for i, part in enumerate(sketch.reshape(SLICES, -1)):
            if part.any():
                nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * len(lanes))]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=names)

    keys = ", ".join(f"k{j} long" for j in range(len(LANES)))
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, f"doc_id long, n_shingles long, set_id binary, {keys}, slice int, counts binary")


def _weights(slices: DataFrame) -> np.ndarray:
    """The sketch of all tasks: CELLS counts, whatever the size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    weights = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for row in in_arrow(slices.repartition(SLICES, "slice"), add, "slice int, counts binary").collect():  # SLICES rows of 512 KB
        weights[row.slice] = np.frombuffer(row.counts, np.int64)
    return weights.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n + percent * -n // 100 + 1  # n - ceil(percent of n) + 1


def _prefixes(docs: DataFrame, weights: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, prefix, crowded): the first shingles in the global order, and those of them in cells that more than
    LIST shingles of documents fell into."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # CELLS numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prefixes, crowded = [], [], []
            for s in row_shingles(batch.column(1), k):
                weight = sent.value[_cell(s)]
                first = np.argsort(weight, kind="stable")[: prefix_length(len(s), percent)] if len(s) else np.zeros(0, np.int64)
                n.append(len(s)), prefixes.append(s[first].view(np.int64)), crowded.append(s[first][weight[first] > LIST].view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, crowded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "prefix", "crowded"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, "doc_id long, n long, prefix array<long>, crowded array<long>")


def _dealt(rows: DataFrame, by: str, name: str, most: int) -> DataFrame:
    """``rows`` with a number in ``name`` so that at most some ``most`` rows share ``by`` and the number."""
    crowded = table(rows.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") > most), "join-dealt")
    rows = rows.join(checked_broadcast(crowded, crowded.count(), BROADCAST_IDS), by, "left")
    other = [c for c in rows.columns if c not in (by, "__n")]
    return rows.withColumn(name, F.pmod(F.xxhash64(*other), F.coalesce(F.ceil(F.col("__n") / most), F.lit(1))).cast("int")).drop("__n")


def _overlaps(docs: DataFrame, pairs: DataFrame, k: int, percent: int, delta: bool) -> DataFrame:
    """The pairs (a, b) with n_a, n_b and shared, counted on the full sets.

    With ``delta`` only pairs that are similar enough, with what b adds to a and what it lacks of a. A document's set goes
    once to each centre a that it is held against, and a centre's once to each part of MEMBERS members, which stream by.
    """
    members = _dealt(pairs.select("a", "b"), "a", "part", MEMBERS).select(F.col("b").alias("id"), "a", "part", F.lit(True).alias("member"))
    centres = members.select("a", "part").distinct().select(F.col("a").alias("id"), "a", "part", F.lit(False).alias("member"))
    roles = table(_dealt(members.unionByName(centres), "id", "chunk", MEMBERS), "join-roles")
    n = roles.count()
    roles = roles.groupBy("id", "chunk").agg(F.collect_list(F.struct("a", "part", "member")).alias("roles")).drop("chunk")  # some MEMBERS at most
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(checked_broadcast(roles, n, BROADCAST_IDS), F.col("doc_id") == F.col("id"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("a", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("member", pa.bool_()), ("shingles", pa.binary()))
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, roles, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), row_shingles(batch.column(1), k), strict=True):
                data = s.tobytes()
                for role in roles:
                    out.append((role["a"], role["part"], doc, role["member"], data))
                    size += len(data)
                    if size > SENT:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    sent = in_arrow(wanted.select("doc_id", "text", "roles"), send, "a long, part int, doc_id long, member boolean, shingles binary")
    sent = sent.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "part").sortWithinPartitions("a", "part", "member").select("a", "part", "doc_id", "member", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in range(4)]
            for a, part, b, member, sent_set in zip(*columns, batch.column(4), strict=True):
                own = np.frombuffer(sent_set.as_buffer(), np.uint64)
                if not member:
                    centre = [*centre, own.copy()] if at == (a, part) else [own.copy()]  # rows that share an id are one document
                    at = (a, part)
                    continue
                for c in centre:
                    small, large = sorted((len(own), len(c)))
                    if delta and 100 * small < percent * large:
                        continue
                    there = np.isin(own, c, assume_unique=True, kind="sort")
                    shared = int(there.sum())
                    if not delta:
                        out.append((a, b, len(c), len(own), shared, None, None))
                    elif 100 * shared >= percent * (small + large - shared):
                        out.append((a, b, len(c), len(own), shared, own[~there].tobytes(), c[np.isin(c, own, assume_unique=True, invert=True, kind="sort")].tobytes()))
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["a", "b", "n_a", "n_b", "shared", "added", "removed"])

    return in_arrow(sent, compare, "a long, b long, n_a long, n_b long, shared long, added binary, removed binary")


def _owned(rows: DataFrame) -> DataFrame:
    """(token, rep, component, lo, hi, rest) of followers (id, n, prefix, leader, component, lead): under the leader's
    name where its prefix has the shingle too, one entry for each leader and shingle in a batch."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[np.ndarray] = []
            ids, n, leaders, comps = (batch.column(c).to_numpy() for c in (0, 1, 3, 4))
            for r in range(len(ids)):
                prefix, lead = (batch.column(c)[r].values.to_numpy() for c in (2, 5))
                there = np.isin(prefix, lead)
                parts.append(np.stack([prefix, np.where(there, leaders[r], ids[r]), np.full(len(prefix), comps[r]), np.full(len(prefix), n[r]), n[r] - np.arange(len(prefix))]))
            token, rep, comp, size, rest = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            order = np.lexsort((rep, token))
            token, rep, comp, size, rest = (x[order] for x in (token, rep, comp, size, rest))
            new = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (rep[1:] != rep[:-1])))) if len(token) else np.zeros(0, np.int64)
            made = (token[new], rep[new], comp[new], np.minimum.reduceat(size, new), np.maximum.reduceat(size, new), np.maximum.reduceat(rest, new)) if len(new) else (token,) * 6
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["token", "rep", "component", "lo", "hi", "rest"])

    return in_arrow(rows.select("id", "n", "prefix", "leader", "component", "lead"), own, "token long, rep long, component long, lo long, hi long, rest long")


def list_pairs(rep: np.ndarray, comp: np.ndarray, lo: np.ndarray, hi: np.ndarray, rest: np.ndarray, percent: int) -> set[tuple[int, int]]:
    """Candidates of one list whose entries are in order of lo and, in a block of one lo, of falling rest."""
    starts = np.flatnonzero(np.concatenate(([True], lo[1:] != lo[:-1])))
    block = np.cumsum(np.concatenate(([0], (lo[1:] != lo[:-1]).astype(np.int64))))
    sizes, tallest, wide = lo[starts], np.maximum.reduceat(hi, starts), int(rest.max()) + 2
    place, out = block * wide + wide - 1 - rest, set()  # rises over the whole list
    for p in range(1, len(rep)):
        b = np.arange(block[p] + 1)
        need = -(-percent * (lo[p] + sizes[b]) // (100 + percent))  # the overlap that the smallest sets would need
        b, need = (x[(rest[p] >= need) & (100 * tallest[b] >= percent * lo[p])] for x in (b, need))  # whole blocks are skipped
        ends = np.minimum(np.searchsorted(place, b * wide + wide - 1 - need, "right"), p)  # and the rest of a block
        for s, e in zip(starts[b].tolist(), ends.tolist(), strict=True):
            if s < e:
                q = np.arange(s, e)
                q = q[(comp[s:e] != comp[p]) & (100 * hi[s:e] >= percent * lo[p])]
                out.update((min(x, int(rep[p])), max(x, int(rep[p]))) for x in rep[q].tolist())
    return out


def _candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives that meet in a list (token, i, j)."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["token", "i", "j", "rep", "component", "lo", "hi", "rest"]
    dealt = entries.select(*names).repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "lo", F.desc("rest"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((8, 0), np.int64)

        def closed(rows: np.ndarray) -> set[tuple[int, int]]:
            new = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
            mixed = np.minimum.reduceat(rows[4], new) != np.maximum.reduceat(rows[4], new)  # others hold one component
            out: set[tuple[int, int]] = set()
            for s, e in zip(new[mixed].tolist(), np.append(new[1:], rows.shape[1])[mixed].tolist(), strict=True):
                out |= list_pairs(*rows[3:, s:e], percent)
            return out

        def sent(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate((carry, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(8)])), axis=1)
            last = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0)) if rows.shape[1] else np.zeros(0, np.int64)
            at = int(last[-1]) + 1 if len(last) else 0  # a list may go on in the next batch
            carry = rows[:, at:]
            if at:
                yield sent(closed(rows[:, :at]))
        if carry.shape[1]:
            yield sent(closed(carry))

    return in_arrow(dealt, search, "a long, b long").distinct()


def derived_link(a: np.ndarray, b: np.ndarray, left: list[tuple], right: list[tuple], percent: int) -> bool:
    """Whether a follower on the left (added to and removed from set a) is similar enough to one on the right (of b).

    Outside the deltas' shingles a follower is its leader, so there the overlap is the leaders' one for all pairs.
    """
    columns = np.unique(np.concatenate([x for m in (*left, *right) for x in m]))
    both = np.intersect1d(a, b, assume_unique=True)
    shared = np.full((len(left), len(right)), float((~np.isin(both, columns, assume_unique=True)).sum()))

    def members(leader: np.ndarray, deltas: list[tuple], at: np.ndarray) -> np.ndarray:
        m = np.tile(np.isin(at, leader, assume_unique=True).astype(np.float64), (len(deltas), 1))
        for r, (added, removed) in enumerate(deltas):
            m[r, np.searchsorted(at, added[(added >= at[0]) & (added <= at[-1])])] = 1
            m[r, np.searchsorted(at, removed[(removed >= at[0]) & (removed <= at[-1])])] = 0
        return m

    for s in range(0, len(columns), COLUMNS):
        at = columns[s : s + COLUMNS]
        shared += members(a, left, at) @ members(b, right, at).T
    size = lambda leader, deltas: np.array([len(leader) + len(x) - len(y) for x, y in deltas])
    union = size(a, left)[:, None] + size(b, right)[None, :] - shared
    return bool((100 * shared >= percent * union).any())


def _derived(docs: DataFrame, open_pairs: DataFrame, followers: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``open_pairs`` (a, b, d, r_a, r_b) whose followers (b, leader, d, added, removed) are linked."""
    sets = minhash._picked(docs, open_pairs.select(F.explode(F.array("a", "b")).alias("id")), k)
    near = F.lit(1 - percent / 100 + EPS)
    nothing = F.lit(b"")
    sides = []
    for own, other in (("a", "b"), ("b", "a")):  # a member whose distance from its leader is too small is too far from the other group
        least = F.col("d") - near - F.col(f"r_{other}")
        led = open_pairs.join(followers.select(F.col("leader").alias(own), F.col("b").alias("member"), F.col("d").alias("from"), "added", "removed"), own).where(F.col("from") >= least)
        itself = open_pairs.where(least <= 0).select("a", "b", F.col(own).alias("member"), nothing.alias("added"), nothing.alias("removed"))
        sides.append(led.select("a", "b", "member", "added", "removed").unionByName(itself).withColumn("side", F.lit(own)))
    members = table(sides[0].unionByName(sides[1]), "join-members")
    blocks = members.groupBy("a", "b").agg(*[F.ceil(F.count(F.when(F.col("side") == s, 1)) / BLOCK).cast("int").alias(f"blocks_{s}") for s in ("a", "b")]).where("blocks_a > 0 AND blocks_b > 0")
    blocks = table(blocks, "join-blocks")
    every = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    dealt = members.join(blocks, ["a", "b"])
    mine = lambda s: F.array(F.pmod(F.xxhash64("member", F.lit(s)), F.col(f"blocks_{s}")).cast("int"))
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("side") == "a", mine("a")).otherwise(every("blocks_a")))).withColumn("j", F.explode(F.when(F.col("side") == "b", mine("b")).otherwise(every("blocks_b"))))
    dealt = dealt.select("a", "b", "i", "j", F.lit(1).alias("kind"), "side", "added", "removed")
    heads = blocks.select("a", "b", F.explode(every("blocks_a")).alias("i"), "blocks_b").select("a", "b", "i", F.explode(every("blocks_b")).alias("j"))
    for side in ("a", "b"):
        whole = heads.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias("added")), side)
        dealt = dealt.unionByName(whole.select("a", "b", "i", "j", F.lit(0).alias("kind"), F.lit(side).alias("side"), "added", nothing.alias("removed")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "kind", "side")

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {}, set()

        def close() -> None:
            if now and derived_link(held["a", 0][0][0], held["b", 0][0][0], held.get(("a", 1), []), held.get(("b", 1), []), percent):
                out.add(now[:2])

        for batch in batches:
            for r, at in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if at != now:
                    close()
                    now, held = at, {}
                kind, side = batch.column(4)[r].as_py(), batch.column(5)[r].as_py()
                held.setdefault((side, kind), []).append(tuple(np.frombuffer(batch.column(c)[r].as_py(), np.uint64) for c in (6, 7)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return in_arrow(dealt, derive, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles, component_id, one row for each input row. Every link counts: the result is exact.

    * Words are maximal runs of bytes other than ASCII white space, with A-Z in lower case; a text of fewer than
      k words has one shingle, all of it; a null, empty or blank text has none and is linked with nothing.
    * component_id is the least doc_id reachable, itself included. Texts of any length are compared on whole sets.
    * doc_id is cast to long: an id that is no whole number fails. A null doc_id is linked with nothing and its
      component_id is null. Rows that share an id are one document: what any of them is linked with, all are.
    * Repeated rows have equal sets and all appear. An empty table gives an empty result; columns other than doc_id
      and text are not looked at.
    """
    scanned = table(_scan(docs, k), "join-sets")
    rows, weights = scanned.where("slice IS NULL"), _weights(scanned.where("slice IS NOT NULL").select("slice", "counts"))
    lanes = [f"k{j}" for j in range(len(LANES))]
    classes = table(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), *[F.max(x).alias(x) for x in lanes]), "join-classes")
    keyed = table(classes.select("id", F.explode(F.array(*lanes)).alias("key")), "join-keys")
    shared = table(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("centre")).where("size > 1"), "join-buckets")
    met = join_hot(keyed, shared, "key", "size", keyed.count()).where("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("times"))
    stars = met.groupBy("id").agg(F.max_by("centre", F.struct("times", -F.col("centre"))).alias("a")).select("a", F.col("id").alias("b"))  # the centre most hashes agree on

    links = table(_overlaps(docs, table(stars, "join-stars"), k, percent, True).withColumn("d", 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))), "join-links")
    pairs = links.select("a", "b")
    roots = table(pairs.groupBy("a").agg(F.count("*").alias("n")).join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "join-roots")
    led = join_hot(pairs, roots, "a", "n", links.count(), "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
    led = table(led, "join-led")
    first = components(pairs)

    known = classes.select("id").distinct().join(led.select(F.col("b").alias("id"), "leader"), "id", "left").join(first, "id", "left")
    known = table(known.select("id", "leader", F.coalesce("component", "id").alias("component")), "join-known")
    in_classes = _prefixes(docs, weights, k, percent).where("n > 0").withColumnRenamed("doc_id", "id")
    in_classes = table(in_classes.join(checked_broadcast(known, known.count(), BROADCAST_IDS), "id"), "join-prefixes")
    groups = table(led.groupBy("leader").agg(F.count("*").alias("times")), "join-groups")
    own = in_classes.where("leader IS NULL").select(F.posexplode("prefix").alias("at", "token"), F.col("id").alias("rep"), "component", F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - F.col("at")).alias("rest")).drop("at")
    lead = in_classes.join(groups.select(F.col("leader").alias("id")), "id", "left_semi").select(F.col("id").alias("leader"), F.col("prefix").alias("lead"))
    lead = lead.join(groups, "leader")
    followers = _owned(join_hot(in_classes.where("leader IS NOT NULL"), lead, "leader", "times", led.count()))
    followers = followers.groupBy("token", "rep", "component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"))
    entries = own.unionByName(followers)
    crowded = table(in_classes.select(F.explode("crowded").alias("token")).groupBy("token").count().where(F.col("count") > LIST).select("token", F.ceil(F.col("count") / LIST).cast("int").alias("blocks")), "join-crowded")
    n = crowded.count()
    if n:
        entries = entries.join(checked_broadcast(crowded, n, BROADCAST_IDS), "token", "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
        entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    else:
        entries = entries.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))

    found = table(_candidates(entries, percent), "join-candidates")
    counted = table(_overlaps(docs, found, k, percent, False).drop("added", "removed"), "join-overlaps")
    linked = 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))
    proven = pairs.unionByName(counted.where(linked).select("a", "b"))
    both = components(proven) if not counted.where(linked).isEmpty() else first

    reach = table(led.join(links.select(F.col("a").alias("leader"), "b", "d"), ["leader", "b"]).groupBy("leader").agg(F.max("d").alias("r")), "join-reach")
    open_pairs = counted.where(~linked).withColumn("d", 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b", "d")
    for side in ("a", "b"):
        open_pairs = open_pairs.join(reach.select(F.col("leader").alias(side), F.col("r").alias(f"r_{side}")), side, "left").fillna(0.0, [f"r_{side}"])
        open_pairs = open_pairs.join(both.select(F.col("id").alias(side), F.col("component").alias(f"component_{side}")), side, "left")
    apart = F.coalesce("component_a", "a") != F.coalesce("component_b", "b")
    open_pairs = table(open_pairs.where(apart & (F.col("r_a") + F.col("r_b") > 0) & (F.col("d") - F.col("r_a") - F.col("r_b") <= 1 - percent / 100 + EPS)).select("a", "b", "d", "r_a", "r_b"), "join-open")
    if not open_pairs.isEmpty():
        deltas = led.join(links.withColumnRenamed("a", "leader"), ["leader", "b"]).select("leader", "b", "d", "added", "removed")
        more = table(_derived(docs, open_pairs, deltas, k, percent), "join-derived")
        both = components(proven.unionByName(more)) if not more.isEmpty() else both

    component = F.coalesce("component", "id").alias("component_id")
    named = table(classes.join(both, "id", "left").select("set_id", "copies", component), "join-components")
    alone = "n_shingles = 0 OR doc_id IS NULL"
    joined = join_hot(rows.where(f"NOT ({alone})").select("doc_id", "n_shingles", "set_id"), named, "set_id", "copies", rows.count())
    rest = rows.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", "n_shingles", "component_id").unionByName(rest)


def sql(percent: int = PERCENT, k: int = SHINGLE) -> str:
    """The components by brute force in DuckDB SQL."""
    return f"SELECT doc_id, n_shingles, component_id FROM ({minhash.sql(percent, k)})"
