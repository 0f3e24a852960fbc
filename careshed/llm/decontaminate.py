"""Benchmark decontamination by spaced-seed hashing (DataFrame operations only).

A seed is a window of up to SPAN tokens seen through a fixed mask that ignores some of them, so that a replaced token
there leaves the hash as it was. Test items and documents are hashed at every position through each mask. Equal hashes
give alignments of an item in a document; each is verified token by token. No accepted alignment is lost: one that
matches in 75 % of the item has a stretch of 9 tokens with 2 replaced, of 12 with 3 or of 16 with 4 (or fewer), and
so has one of 11 matches in 13; each way to replace these leaves one of the masks whole, which a test enumerates.
Items shorter than such a stretch have masks of their own length: those of four and more tokens may have one token
replaced, those of eight two, and shorter ones none.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import checked_broadcast, table, text_of

#: Fixed masks; 0 marks an ignored token. A share below SHARE or fewer masks would lose alignments.
MASKS = ("110111", "110001011", "1111001", "101000111", "100101011")
SPAN = 9
#: An alignment counts if this share of the item's tokens match, or this many within WINDOW tokens in a row.
SHARE, WINDOW, MATCHES = 0.75, 13, 11
#: Seeds, candidate alignments, and tokens of all items that may be broadcast (at most 64 MB); more are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_HITS, BROADCAST_TOKENS = 500_000, 500_000, 1_000_000


def tokens(text: Column) -> Column:
    """Letters and digits in lower case, cut at everything else; an array without empty tokens."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def short_masks(n: int, share: float = SHARE) -> list[str]:
    """Masks for items of ``n`` tokens, under SPAN, of which ``share`` must match: the positions are dealt to two classes
    more than tokens may be replaced, and each mask ignores as many classes as that, so the replaced ones lie in them. Ignored ends are cut off, as an item may
    stand at an end of a text without its own."""
    replaced = n - math.ceil(share * n)
    if not replaced:
        return ["1" * n]
    masks = ("".join("0" if i % (replaced + 2) in ignored else "1" for i in range(n)) for ignored in combinations(range(replaced + 2), replaced))
    return sorted({m.strip("0") for m in masks})


def _seeds(texts: DataFrame, words: str, masks: list[str]) -> DataFrame:
    """A row (at, seed) for every position and mask that fits there, beside the first column; in generated code
    throughout, as a lambda over positions would be interpreted."""
    least = min(map(len, masks))
    starts = texts.where(F.size(words) >= least).select(texts.columns[0], words, F.explode(F.sequence(F.lit(0), F.size(words) - least)).alias("at"))

    def seed(mask: str) -> Column:
        tokens = [F.get(words, F.col("at") + j) for j, bit in enumerate(mask) if bit == "1"]
        return F.when(F.col("at") + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *tokens))

    return starts.select(texts.columns[0], "at", F.explode(F.array(*map(seed, masks))).alias("seed")).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, shortest: int = 1) -> DataFrame:
    """Pairs of a document and a test item that it holds, up to replaced tokens.

    Returns doc_id, item_id, matched_tokens, item_tokens, overlap (matched share of the item, best alignment).

    * Tokens are runs of letters and digits in lower case.
    * Items of every length are searched: one to three tokens must stand whole, as 75 % of them are all. A caller whose
      items are too short to be told from chance leaves out those under ``shortest`` tokens.
    * Texts of any length are searched whole, at every position.
    * Null texts are empty and match nothing; null ids of documents or items are never reported.
    * Repeated rows give a pair once. Empty tables give an empty result. Other columns are not looked at.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", tokens(text_of()).alias("item")).where(F.size("item") >= max(shortest, 1)).distinct()
    items = table(items, "decontaminate-items")
    n_tokens = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    short = sorted(r.n for r in items.where(F.size("item") < SPAN).select(F.size("item").alias("n")).distinct().collect())  # at most SPAN - 1 numbers
    masks = {n: short_masks(n, share) for n in short}
    seeds = _seeds(items.where(F.size("item") >= SPAN), "item", list(MASKS))
    for n in short:
        seeds = seeds.unionByName(_seeds(items.where(F.size("item") == n), "item", masks[n]))
    seeds = table(seeds.withColumnRenamed("at", "item_at").distinct(), "decontaminate-seeds")
    seeds = checked_broadcast(seeds, seeds.count(), BROADCAST_SEEDS)

    words = docs.where("doc_id IS NOT NULL").select("doc_id", tokens(text_of()).alias("words"))
    hits = _seeds(words, "words", [*MASKS, *dict.fromkeys(m for n in short for m in masks[n])]).join(seeds, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = table(hits.distinct(), "decontaminate-hits")
    hits = checked_broadcast(hits, hits.count(), BROADCAST_HITS)

    aligned = words.join(hits, "doc_id").join(checked_broadcast(items, n_tokens, BROADCAST_TOKENS), "item_id")
    same = F.transform(F.sequence(F.lit(0), F.size("item") - 1), lambda k: F.when(F.get("words", F.col("shift") + k) == F.get("item", k), 1).otherwise(0))
    aligned = aligned.select("doc_id", "item_id", F.size("item").alias("item_tokens"), same.alias("same"))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    runs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("item_tokens") - WINDOW + 1))
    dense = F.exists(runs, lambda s: F.aggregate(F.slice("same", s, F.lit(WINDOW)), F.lit(0), lambda a, x: a + x) >= MATCHES)
    held = aligned.withColumn("matched", total).where((F.col("matched") >= share * F.col("item_tokens")) | dense)
    best = held.groupBy("doc_id", "item_id", "item_tokens").agg(F.max("matched").alias("matched_tokens"))
    return best.select("doc_id", "item_id", "matched_tokens", "item_tokens", F.round(F.col("matched_tokens") / F.col("item_tokens"), 6).alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item; rows with a null doc_id have no item and stay."""
    return docs.join(overlaps(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")


def sql(share: float = SHARE) -> str:
    """The overlaps by brute force in DuckDB SQL: all alignments of equal tokens, without seeds."""
    cut = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH i AS (SELECT DISTINCT item_id, {cut} AS item FROM benchmark WHERE item_id IS NOT NULL),
it AS (SELECT item_id, item, len(item) AS n, unnest(item) AS tok, generate_subscripts(item, 1) AS k FROM i),
d AS (SELECT doc_id, row_number() OVER () AS r, {cut} AS words FROM documents WHERE doc_id IS NOT NULL),
dt AS (SELECT doc_id, r, unnest(words) AS tok, generate_subscripts(words, 1) AS pos FROM d),
m AS (SELECT doc_id, r, item_id, item, n, pos - k AS shift, list(k ORDER BY k) AS ks FROM dt JOIN it ON it.tok = dt.tok GROUP BY doc_id, r, item_id, item, n, pos - k HAVING count(*) >= least({share} * n, {MATCHES})),
h AS (SELECT doc_id, item_id, n, len(ks) AS matched FROM m WHERE len(ks) >= {share} * n OR len(list_filter(range(1, len(ks) - {MATCHES} + 2), lambda x: ks[x + {MATCHES - 1}] - ks[x] < {WINDOW})) > 0)
SELECT doc_id, item_id, CAST(max(matched) AS INT) AS matched_tokens, CAST(n AS INT) AS item_tokens, round(max(matched) / CAST(n AS DOUBLE), 6) AS overlap FROM h GROUP BY doc_id, item_id, n
"""
