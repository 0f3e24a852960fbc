"""Line deduplication by a deletion-neighbourhood join (DataFrame operations only).

The edit distance counts words: two lines are near when at most one word must be replaced, inserted or deleted.
Every line emits itself and its variants with one word deleted, as hashed keys. Lines that share a variant with
the same deleted position differ by a replaced word; a line that equals another's variant lacks one word. So in
each group of equal keys the earliest line stands for all of them, and the join is linear in the group's size.

Before that a filter that loses nothing: of two near lines the first or the second half agrees, so a line whose
halves occur in no other line emits no variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import checked_broadcast, free_name, join_hot, table, text_of

#: The edit bound is none for lines of fewer words, and one word for longer ones.
MIN_WORDS = 6
#: Lines that may be picked by a broadcast of their 64-bit keys (at most 32 MB); more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _raw_lines(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line"))


def _words(line: Column) -> Column:
    """Hashes of the line's words. Lines with single blanks only, the usual ones, need no pattern."""
    other = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\v\f\r":
        other |= F.contains(line, F.lit(c))
    cut = F.filter(F.split(line, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    words = F.when(line == "", F.array().cast("array<string>")).when(other, cut).otherwise(F.split(line, " "))
    return F.transform(words, lambda w: F.xxhash64(w))


def _lines(docs: DataFrame) -> DataFrame:
    some = F.col("line").rlike("[^\\x20\\x09-\\x0D]")  # a test on the words would have them cut twice, below and above the filter
    return _raw_lines(docs).where(some).select("doc_id", "line_no", _words(F.col("line")).alias("words"))


def _pair(*cols: Column) -> Column:
    """A key of 128 bits."""
    return F.struct(F.xxhash64(*cols).alias("x"), F.xxhash64(F.lit(0x9E37), *cols).alias("y"))


def _halves(n: Column, words: Column) -> Column:
    """Keys of the halves that a line shares with any line within one word of it."""

    def keys(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit(1), m, F.slice(words, 1, half)), F.xxhash64(F.lit(2), m, F.slice(words, n - (m - half) + 1, m - half))]

    return F.array(*keys(n), *keys(n - 1))


def _within_one(a: Column, b: Column) -> Column:
    """At most one word replaced, inserted or deleted."""

    def without(words: Column, at: Column) -> Column:
        return F.concat(F.slice(words, 1, at - 1), F.slice(words, at + 1, F.size(words)))

    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True).cast("int")
    return (a == b) | (
        F.when(F.size(a) == F.size(b), F.size(F.filter(differ, lambda d: d)) <= 1)
        .when(F.size(a) == F.size(b) + 1, without(a, at) == b)
        .when(F.size(b) == F.size(a) + 1, without(b, at) == a)
        .otherwise(False)
    )


#: A prime under 2**31, so that products fit in a long, and a base with its inverse.
_PRIME, _BASE = 2_147_483_647, 1_000_003
_BACK = pow(_BASE, -1, _PRIME)


def _variants(lines: DataFrame) -> DataFrame:
    """(pos, order, bag, length, at): the line itself with at = -1 and its variants without the word at each position.

    ``order`` is a polynomial in the words' hashes and ``bag`` their exclusive or, together 95 bits. Sums over the
    words before each position give every variant's in constant time. A line that shares only one half with others
    emits the variants of the other half.
    """
    words, n = F.col("words"), F.col("n")
    start = F.struct(F.array(F.lit(0).cast("long")).alias("sums"), F.lit(1).cast("long").alias("power"))

    def step(acc: Column, w: Column) -> Column:
        total = F.pmod(F.element_at(acc["sums"], -1) + F.pmod(w, F.lit(_PRIME)) * acc["power"], F.lit(_PRIME))
        return F.struct(F.concat(acc["sums"], F.array(total)).alias("sums"), F.pmod(acc["power"] * _BASE, F.lit(_PRIME)).alias("power"))

    sums = F.aggregate(words, start, step, lambda acc: acc["sums"])
    bag = F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(w))
    low = F.when(F.col("first") & ~F.col("second"), F.floor((n - 1) / 2)).otherwise(0).cast("int")
    high = F.when(F.col("second") & ~F.col("first"), F.floor(n / 2)).otherwise(n - 1).cast("int")
    rows = lines.select("pos", "words", "n", sums.alias("sums"), bag.alias("bag"), low.alias("low"), high.alias("high"))

    def variant(i: Column) -> Column:
        before, after = F.get("sums", i), F.get("sums", n) - F.get("sums", i + 1) + _PRIME
        return F.struct(F.pmod(before + F.pmod(after, F.lit(_PRIME)) * _BACK, F.lit(_PRIME)).alias("order"), F.col("bag").bitwiseXOR(F.get(words, i)).alias("bag"), (n - 1).alias("length"), i.alias("at"))

    own = F.array(F.struct(F.get("sums", n).alias("order"), F.col("bag").alias("bag"), n.alias("length"), F.lit(-1).alias("at")))
    return rows.select("pos", F.inline(F.concat(own, F.transform(F.sequence("low", "high"), variant))))


def _near(distinct: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(pos, earlier): distinct lines with an earlier line within one word, by their first places."""
    halves = distinct.where(F.col("n") >= min_words).select("pos", F.col("id.x").alias("line"), F.posexplode("halves").alias("which", "half"))
    open_ = halves.groupBy("half").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("half")
    shared = halves.join(open_, "half").groupBy("pos").agg(F.max(F.col("which") % 2 == 0).alias("first"), F.max(F.col("which") % 2 == 1).alias("second"))
    picked = table(shared, "lines-picked")
    place = picked.select(F.xxhash64("pos").alias("place"))
    pos = F.struct("doc_id", "line_no")
    lines = _raw_lines(docs).select(pos.alias("pos"), "line")
    lines = lines.join(checked_broadcast(place, picked.count(), BROADCAST_LINES), F.xxhash64("pos") == F.col("place"), "left_semi")
    lines = lines.select("pos", _words(F.col("line")).alias("words")).dropDuplicates(["pos"]).join(picked, "pos").withColumn("n", F.size("words"))
    lines = table(lines, "lines-words")

    variants = table(_variants(lines), "lines-variants")
    key = ["order", "bag", "length"]
    least = variants.groupBy(*key, "at").agg(F.min("pos").alias("first"), F.count("*").alias("lines"))
    ends = least.groupBy(*key).agg(F.min(F.when(F.col("at") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("cut"), F.sum("lines").alias("lines")).where("lines > 1 AND whole IS NOT NULL AND cut IS NOT NULL")
    ends = table(ends.select(*key, "whole", "cut"), "lines-ends")
    least = table(least.where("lines > 1 AND at >= 0").select(*key, "at", "first"), "lines-least")
    across = variants.join(ends, key).select("pos", F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")).alias("earlier"))
    replaced = variants.join(least, [*key, "at"]).select("pos", F.col("first").alias("earlier"))
    pairs = across.unionByName(replaced).where("earlier < pos")
    words = lines.select("pos", "words")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(words, "pos").join(words.select(F.col("pos").alias("earlier"), F.col("words").alias("other")), "earlier")
        return both.select("pos", "earlier", _within_one(F.col("words"), F.col("other")).alias("near"))

    least = table(verified(pairs.groupBy("pos").agg(F.min("earlier").alias("earlier"))), "lines-verified")
    found, failed = least.where("near").select("pos", "earlier"), least.where("NOT near").select("pos")
    if failed.isEmpty():
        return found
    # keys that are equal by chance hid other candidates of these few lines, so all of them are verified
    again = verified(pairs.join(failed, "pos", "left_semi").distinct()).where("near").groupBy("pos").agg(F.min("earlier").alias("earlier"))
    return found.unionByName(again)


def line_duplicates(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that an earlier line makes superfluous: doc_id, line_no, keep_doc_id, keep_line_no.

    Earlier means a smaller (doc_id, line_no). The edit bound grows with the line: none below ``min_words`` words, where
    one word is much of the line, and one from there on. keep_* is the earliest line with the same words, or else the
    earliest near line; of a chain of near lines only the first stays, so keep_* may name a line that goes itself. Blank
    lines always stay. Lines of any length are compared whole. A null text has no
    lines, rows with a null doc_id are left alone, rows that repeat a doc_id are one document whose lines overlay.
    Empty tables give an empty result; columns other than doc_id and text are not looked at.
    """
    n, words = F.size("words"), F.col("words")
    lines = _lines(docs).select(F.struct("doc_id", "line_no").alias("pos"), n.alias("n"), _pair(words).alias("id"), F.when(n >= min_words, _halves(n, words)).alias("halves"))
    lines = table(lines, "lines")
    distinct = table(lines.groupBy("id").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.max("halves").alias("halves"), F.count("*").alias("copies")), "lines-distinct")
    near = table(_near(distinct, docs, min_words), "lines-near")
    found = distinct.select("id", "copies", F.col("pos").alias("own")).join(near.select(F.col("pos").alias("own"), "earlier"), "own", "left")
    gone = table(found.where("copies > 1 OR earlier IS NOT NULL").select("id", "own", "earlier", "copies"), "lines-gone")
    out = join_hot(lines.select("pos", "id"), gone, "id", "copies", lines.count()).withColumn("keep", F.when(F.col("pos") == F.col("own"), F.col("earlier")).otherwise(F.col("own")))
    return out.where("keep IS NOT NULL AND keep <> pos").select("pos.doc_id", "pos.line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"))


def line_counts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines (ascending) for each document with an id; rows that repeat an id are one."""
    gone = line_duplicates(docs, min_words).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped_lines"))
    sizes = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))).alias("n_lines"))
    out = sizes.join(gone, "doc_id", "left").withColumn("dropped_lines", F.coalesce("dropped_lines", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("dropped_lines").alias("n_dropped"), "dropped_lines")


def drop_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its superfluous lines taken out of ``text``; rows without an id stay as they are."""
    name = free_name("__gone", docs.columns)
    gone = line_duplicates(docs, min_words).groupBy("doc_id").agg(F.collect_set("line_no").alias(name))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(name, i))
    return docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop(name)


def sql(min_words: int = MIN_WORDS) -> str:
    """``line_counts`` in DuckDB SQL, with dropped_lines as text: pairs of lines that share a half, and word by word."""
    halves = ", ".join(f"concat_ws(chr(1), '{kind}', {m}, array_to_string({part}, chr(0)))" for m in ("n", "n - 1") for kind, part in (("a", f"w[1 : ({m}) // 2]"), ("b", f"w[n - (({m}) - ({m}) // 2) + 1 : n]")))
    differ = "coalesce(list_min(list_filter(range(1, least(a.n, b.n) + 1), lambda i: a.w[i] <> b.w[i])), least(a.n, b.n) + 1)"
    return f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
l0 AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM d),
l AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l0),
f AS (SELECT w, len(w) AS n, min(struct_pack(d := doc_id, l := line_no)) AS pos FROM l WHERE len(w) > 0 GROUP BY w),
h AS (SELECT pos, n, w, unnest([{halves}]) AS half FROM f WHERE n >= {min_words}),
near AS (SELECT DISTINCT a.pos FROM h a JOIN h b ON a.half = b.half AND b.pos < a.pos AND abs(a.n - b.n) <= 1 WHERE CASE
  WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) <= 1
  WHEN a.n > b.n THEN a.w[{differ} + 1 : a.n] = b.w[{differ} : b.n]
  ELSE b.w[{differ} + 1 : b.n] = a.w[{differ} : a.n] END),
g AS (SELECT l.doc_id, l.line_no FROM l JOIN f ON f.w = l.w LEFT JOIN near ON near.pos = f.pos WHERE f.pos <> struct_pack(d := l.doc_id, l := l.line_no) OR near.pos IS NOT NULL),
s AS (SELECT doc_id, count(*) AS n_dropped, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS dropped_lines FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS INT) AS n_lines, CAST(coalesce(s.n_dropped, 0) AS INT) AS n_dropped, coalesce(s.dropped_lines, '') AS dropped_lines FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
