"""Exact deduplication with a log-structured merge index over text digests (DataFrame operations only).

Every scan task fills memtables: it digests its documents and flushes them sorted by batch and digest. Each batch
becomes a run: a row for each digest with the document that stays and the size of the group, sorted, and a filter, one
hash bit of SLOTS for each digest, packed in bitmaps. FAN runs of a level are compacted into one of the next: a digest
that no other run's filter knows goes over as it is, and only the others are shuffled and merged. What the levels hold
in the end is compacted the same way, and new rows are tested against the filters first. Digests that occur more than
once are hits, and their normalised texts are compared byte for byte before they count as equal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import ASCII_SPACE, checked_broadcast, join_hot, table, text_of

#: Hit rows that may be broadcast as 64-bit keys (at most 32 MB); more are joined by a shuffle.
BROADCAST_HITS = 1_000_000
#: Runs of a level that are merged into one of the next; bits of a filter for each digest; bits of one bitmap.
FAN, SLOTS, BITMAP = 4, 16, 32_768
#: Batches into which a table is flushed, and the rows of a task that go to one batch before the next one's turn.
BATCHES, MEMTABLE = 5, 256
#: Bitmaps that may be broadcast (at most 32 MB); more are joined by a shuffle.
BROADCAST_BITMAPS = 8_192


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{ASCII_SPACE}+", "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _rank() -> Column:
    """The smallest is the row that stays: most code points, then smallest id, ids before nulls."""
    return F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


@dataclass
class Run:
    """Sorted digests with their best row and number of rows, and the filter over them."""

    digests: DataFrame
    bitmaps: DataFrame
    slots: int

    @classmethod
    def write(cls, digests: DataFrame) -> Run:
        digests = table(digests.sortWithinPartitions("digest"), "exact-run")
        slots = max(1, -(-digests.count() * SLOTS // BITMAP)) * BITMAP
        slot = cls.slot(slots)
        spread = digests.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).distinct()
        bitmaps = spread.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return cls(digests, table(bitmaps, "exact-filter"), slots)

    @staticmethod
    def slot(slots: int) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(slots)) + 1

    @property
    def small(self) -> bool:
        """The filter can be broadcast."""
        return self.slots // BITMAP <= BROADCAST_BITMAPS

    def tested(self, keyed: DataFrame, name: str) -> DataFrame:
        """``keyed`` with a column that says whether the run may hold the row's digest; where it is false it does not."""
        slot = self.slot(self.slots)
        placed = keyed.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("bit", F.bitmap_bit_position(slot))
        met = placed.join(checked_broadcast(self.bitmaps, self.slots // BITMAP, BROADCAST_BITMAPS), "bucket", "left")
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
        return met.select(*keyed.columns, held.alias(name))

    def candidates(self, keyed: DataFrame) -> DataFrame:
        """The rows whose digest the run may hold."""
        return self.tested(keyed, "held").where("held").select(keyed.columns)


class DigestIndex:
    """The index: ``flush`` adds a batch, ``probe`` answers for new rows, ``members`` for every flushed row.

    ``digest`` maps the normalised text to a binary column (SHA-256 unless a test wants collisions).
    """

    def __init__(self, digest=sha256):
        self.digest = digest
        self.flushed: list[tuple[DataFrame, DataFrame]] = []  # batches, and their rows with digests
        self.levels: list[list[Run]] = []
        self.waiting: list[DataFrame] = []  # rows that no run holds yet

    def _keyed(self, docs: DataFrame) -> DataFrame:
        text = text_of()
        return docs.select("doc_id", text.alias("text")).withColumn("norm", normalised(text)).select("doc_id", F.char_length("text").cast("long").alias("n_points"), "norm", self.digest(F.col("norm")).alias("digest"))

    def flush(self, docs: DataFrame, batches: int = 1) -> DigestIndex:
        """Digest the rows of a table, dealt to ``batches``; each task writes its part as one file sorted by batch and digest,
        so a batch is read by itself."""
        row = F.monotonically_increasing_id()  # the task in the upper 31 bits, its row in the lower 33
        batch = F.pmod(F.shiftright(row, 33) + F.floor(row.bitwiseAND((1 << 33) - 1) / MEMTABLE), F.lit(batches)).cast("int")
        rows = table(self._keyed(docs).drop("norm").withColumn("batch", batch).sortWithinPartitions("batch", "digest"), "exact-rows")
        self.flushed.append((docs, rows.drop("batch")))
        self.waiting += [rows.where(F.col("batch") == b).drop("batch") for b in range(batches)]
        return self

    def runs(self) -> list[Run]:
        """All runs, after batches that wait are made runs and full levels are merged."""
        for rows in self.waiting:
            self._add(Run.write(_merged(rows.select("digest", F.lit(1).cast("long").alias("rows"), _rank().alias("best")))), 0)
        self.waiting = []
        return [run for level in self.levels for run in level]

    def _add(self, run: Run, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN:
            full, self.levels[level] = self.levels[level], []
            self._add(Run.write(_compacted(full)), level + 1)

    def _texts(self, hits: DataFrame, only: bool = True) -> DataFrame:
        """(doc_id, n_points, norm, digest) of all flushed rows under the digests ``hits`` (digest, group_size); only
        their texts are read again, once. Without ``only`` rows may be among them that the join's keys take for hits."""
        rows = reduce(DataFrame.unionByName, [rows for _, rows in self.flushed])
        held = join_hot(rows, hits, "digest", "group_size", rows.count(), "left_semi")
        keys = table(held.select(F.xxhash64("doc_id", "n_points").alias("hit")).distinct(), "exact-hits")
        n = keys.count()
        own = F.xxhash64("doc_id", F.char_length(text_of()).cast("long"))
        picked = [self._keyed(docs.select("doc_id", "text").join(checked_broadcast(keys, n, BROADCAST_HITS), own == F.col("hit"), "left_semi")) for docs, _ in self.flushed]
        texts = reduce(DataFrame.unionByName, picked)
        return join_hot(texts, hits, "digest", "group_size", n, "left_semi") if only else texts

    def members(self) -> DataFrame:
        """(doc_id, digest, keep_id, group_size) for every flushed row, after byte verification of the hits."""
        rows = reduce(DataFrame.unionByName, [rows for _, rows in self.flushed])
        groups = table(_compacted(self.runs()).where("rows > 1").select("digest", F.col("best.id").alias("keep_id"), F.col("rows").alias("group_size")), "exact-groups")
        texts = self._texts(groups.select("digest", "group_size"), only=False).groupBy("digest", "norm").agg(F.count("*").alias("copies"))
        differ = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("copies").alias("group_size"))
        collided, clashing = table(differ.where("texts > 1").select("digest", "group_size"), "exact-collided"), None
        if not collided.isEmpty():  # equal digests of different texts: these few are grouped by the texts themselves
            texts = self._texts(collided)
            best = texts.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.min(_rank()).alias("best"))
            clashing = texts.join(best, ["digest", "norm"]).select("doc_id", "digest", F.col("best.id").alias("keep_id"), "group_size")
            rows, groups = rows.join(collided, "digest", "left_anti"), groups.join(collided, "digest", "left_anti")
        out = join_hot(rows, groups, "digest", "group_size", rows.count(), "left").select(
            "doc_id", "digest",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        )
        return out if clashing is None else out.unionByName(clashing)

    def probe(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, keep_id, group_size) of the rows of ``docs`` whose normalised text the index holds: filters
        pick candidates, digests hits, and the bytes decide; keep_id and group_size are of the flushed rows."""
        new = table(self._keyed(docs), "exact-probe")
        keys = new.select("digest").distinct()
        met = [run.candidates(keys).join(run.digests.select("digest", "rows"), "digest") for run in self.runs()]
        if not met:
            return new.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).where("false")
        hits = table(reduce(DataFrame.unionByName, met).groupBy("digest").agg(F.sum("rows").alias("group_size")), "exact-probe-hits")
        best = self._texts(hits).groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.min(_rank()).alias("best"))
        return new.join(best, ["digest", "norm"]).select("doc_id", "digest", F.col("best.id").alias("keep_id"), "group_size")


def _merged(digests: DataFrame) -> DataFrame:
    """One row for each digest: the number of rows and the best of them."""
    return digests.groupBy("digest").agg(F.sum("rows").alias("rows"), F.min("best").alias("best"))


def _compacted(runs: list[Run]) -> DataFrame:
    """The rows of ``runs`` with one for each digest. A digest that stands in one run alone need not be shuffled, and
    where the other runs' filters can be broadcast they tell most of those; beyond that all are merged."""
    alone, met = [], []
    for run in runs:
        others = [r for r in runs if r is not run]
        if all(r.small for r in others):
            tested, names = run.digests, [f"held{i}" for i in range(len(others))]
            for name, other in zip(names, others, strict=True):
                tested = other.tested(tested, name)
            held = reduce(lambda a, b: a | b, [F.col(n) for n in names], F.lit(False))
            alone.append(tested.where(~held).select(run.digests.columns))
            met.append(tested.where(held).select(run.digests.columns))
        else:
            met.append(run.digests)
    return reduce(DataFrame.unionByName, [*alone, _merged(reduce(DataFrame.unionByName, met))])


def exact_duplicates(docs: DataFrame, digest=sha256) -> DataFrame:
    """Group documents whose texts are equal once ASCII white space is deleted.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each input row.

    * Of equal texts the row with the most code points in its original text stays, then the smallest doc_id.
    * A null text counts as empty; all empty or blank texts are equal. Texts of any length are digested whole.
    * A null doc_id ranks after every id; its row is kept only if no row of its group has an id.
    * Repeated rows (same doc_id) all appear, each marked kept if its doc_id is the keeper's.
    * An empty table gives an empty result; columns other than doc_id and text are not looked at.

    """
    found = DigestIndex(digest).flush(docs, BATCHES).members()
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
