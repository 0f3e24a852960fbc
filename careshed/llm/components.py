"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careshed.llm.common import join_hot, table


def _least(edges: DataFrame, own: str, other: str) -> DataFrame:
    """For each ``own`` end of a link the least of its ``other`` ends, and how many there are."""
    return edges.groupBy(own).agg(F.min(other).alias("least"), F.count("*").alias("n"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the least id that can be reached.

    Each step is two aggregations with map-side combining and two joins over the links alone, in which an id with a
    large share of all links is met by a broadcast. The links of a step are written to the shared folder, so lineage
    stays short and a lost executor costs one step at most. Nulls and self links are ignored; links may repeat and
    stand in either order.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = table(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n, seen = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(_least(both, "u", "v").select("u", F.least("u", "least").alias("m"), "n"), "least")
        large = join_hot(both.where("v > u"), least, "u", "n", 2 * n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = table(large, "large")
        least = table(_least(large, "u", "v"), "least")
        small = join_hot(large, least, "u", "n", n).select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        edges = table(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        n, seen = now[0], now
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
