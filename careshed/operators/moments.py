"""Pairwise complete moments of many columns, and exact quantiles without a sort of all values in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careshed.core.work import broadcast_if_small, in_arrow, table

#: Columns on a side of a block of moments, and blocks that a task adds up in one pass (some 80 MB).
BLOCK, BLOCKS = 128, 64
#: What a block holds for columns a and b over the rows in which both are there; sums are of distances from the means.
SUMS, LEAST, MOST = ("n", "a", "b", "aa", "bb", "ab"), ("min_a", "min_b"), ("max_a", "max_b")
#: Ranges into which a round of a quantile search cuts what is left, and values that one task may sort at the end.
RANGES, FINISH = 1024, 100_000


def _add(own: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> None:
    for name in SUMS:
        own[name] += more[name]
    for name in LEAST:
        np.minimum(own[name], more[name], out=own[name])
    for name in MOST:
        np.maximum(own[name], more[name], out=own[name])


def _empty(rows: int, columns: int) -> dict[str, np.ndarray]:
    return {n: np.full((rows, columns), np.inf if n in LEAST else -np.inf if n in MOST else 0.0) for n in (*SUMS, *LEAST, *MOST)}


def _ends(x: np.ndarray, there: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each column of x over the rows in which each column of the other side is there too.
    Columns that are missing in the same rows are done together."""
    patterns, which = np.unique(np.packbits(other, axis=0), axis=1, return_inverse=True)
    low, high = np.empty((patterns.shape[1], x.shape[1])), np.empty((patterns.shape[1], x.shape[1]))
    for k in range(patterns.shape[1]):
        rows = other[:, int(np.flatnonzero(which.reshape(-1) == k)[0])][:, None] & there
        low[k], high[k] = np.where(rows, x, np.inf).min(axis=0, initial=np.inf), np.where(rows, x, -np.inf).max(axis=0, initial=-np.inf)
    return low[which.reshape(-1)].T, high[which.reshape(-1)].T


def block_moments(x: np.ndarray, y: np.ndarray, shift_x: np.ndarray, shift_y: np.ndarray) -> dict[str, np.ndarray]:
    """The moments of columns x against columns y (NaN is missing), by matrix products."""
    in_x, in_y = ~np.isnan(x), ~np.isnan(y)
    a, b = np.where(in_x, x - shift_x, 0.0), np.where(in_y, y - shift_y, 0.0)
    m, k = in_x.astype(float), in_y.astype(float)
    out = {"n": m.T @ k, "a": a.T @ k, "b": m.T @ b, "aa": (a * a).T @ k, "bb": m.T @ (b * b), "ab": a.T @ b}
    out["min_a"], out["max_a"] = _ends(x, in_x, in_y)
    low, high = _ends(y, in_y, in_x)
    return out | {"min_b": low.T, "max_b": high.T}


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, data): the moments of all pairs of columns in blocks, i <= j; ``data`` is one array after the other.

    Each task adds its rows up with matrix products and sends a row for each block, so what is shuffled is the blocks of
    each task, whatever the number of rows; blocks beyond BLOCKS take further passes over ``df``.
    """
    shift = np.array([x or 0.0 for x in df.agg(*[F.avg(F.col(f"`{c}`").cast("double")) for c in columns]).first()])
    at = [slice(s, min(s + BLOCK, len(columns))) for s in range(0, len(columns), BLOCK)]
    pairs = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    schema, names = "i int, j int, data binary", ("i", "j", "data")

    def packed(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        data = [np.concatenate([sums[k][n].reshape(-1) for n in (*SUMS, *LEAST, *MOST)]).tobytes() for k in keys]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(data, pa.binary())], names=names)

    def unpacked(i: int, j: int, data: bytes) -> dict[str, np.ndarray]:
        shape = (at[i].stop - at[i].start, at[j].stop - at[j].start)
        parts = np.frombuffer(data, np.float64).reshape(-1, *shape)
        return {n: p.copy() for n, p in zip((*SUMS, *LEAST, *MOST), parts, strict=True)}

    def partial(wanted: list[tuple[int, int]]):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {p: _empty(at[p[0]].stop - at[p[0]].start, at[p[1]].stop - at[p[1]].start) for p in wanted}
            for batch in batches:
                x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
                for i, j in wanted:
                    _add(sums[i, j], block_moments(x[:, at[i]], x[:, at[j]], shift[at[i]], shift[at[j]]))
            yield packed(sums)

        return add

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], dict] = {}
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (i, j) in sums:
                    _add(sums[i, j], unpacked(i, j, data))
                else:
                    sums[i, j] = unpacked(i, j, data)
        yield packed(sums)

    out = None
    for s in range(0, len(pairs), BLOCKS):
        some = in_arrow(values, partial(pairs[s : s + BLOCKS]), schema)
        some = in_arrow(some.repartition(min(len(pairs), 64), "i", "j"), merge, schema)
        out = some if out is None else out.unionByName(some)
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, r) of the upper triangle: pairwise complete correlations, null if either column is constant where both are."""
    at = [slice(s, min(s + BLOCK, len(columns))) for s in range(0, len(columns), BLOCK)]

    def relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                shape = (at[i].stop - at[i].start, at[j].stop - at[j].start)
                m = dict(zip((*SUMS, *LEAST, *MOST), np.frombuffer(data, np.float64).reshape(-1, *shape), strict=True))
                with np.errstate(all="ignore"):
                    cov = m["ab"] / m["n"] - m["a"] / m["n"] * (m["b"] / m["n"])
                    r = cov / np.sqrt(m["aa"] / m["n"] - (m["a"] / m["n"]) ** 2) / np.sqrt(m["bb"] / m["n"] - (m["b"] / m["n"]) ** 2)
                known = (m["n"] > 0) & (m["min_a"] < m["max_a"]) & (m["min_b"] < m["max_b"]) & np.isfinite(r)
                row, column = np.nonzero(np.ones(shape, bool) if i < j else np.triu(np.ones(shape, bool), 1))
                own = known[row, column]
                yield pa.RecordBatch.from_arrays([pa.array((row + at[i].start).astype(np.int32)), pa.array((column + at[j].start).astype(np.int32)), pa.array(np.clip(r[row, column], -1, 1), mask=~own)], names=["i", "j", "r"])

    return in_arrow(moments(df, columns), relate, "i int, j int, r double")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], by: str | None = None) -> DataFrame:
    """(column, share, value), with ``by`` for each of its values: the quantiles that a sort would give, by linear
    interpolation, nulls and NaN left out.

    Each round counts what is left of a column in RANGES equal ranges between its least and greatest value and keeps the
    ranges that hold a wanted rank, until at most FINISH values are left or all that is left is equal. Counts combine
    before the shuffle, so no task sees more than a range's values however many rows there are or however unevenly they
    lie. ``by`` is for a few groups; for many, a sort inside each group is cheaper.
    """
    keys = ["column"] if by is None else [by, "column"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("c")
    values = df.select(*[by] * (by is not None), cells).select(*keys[:-1], "c.column", "c.v").where("v IS NOT NULL AND NOT isnan(v)")
    wanted = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    wanted = wanted.select(*keys, "n", "lo", "hi", at)
    place = F.col("share") * (F.col("n") - 1)
    ranks = F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")
    left = table(wanted.select(*keys, "share", place.alias("place"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), ranks).distinct(), "quantile-ranks")
    done = None
    while True:
        # A rank's range [lo, hi] holds ``inside`` values, ``before`` of the column's lie below it.
        over = left.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= FINISH))
        more = left.where((F.col("lo") < F.col("hi")) & (F.col("inside") > FINISH))
        done = over if done is None else done.unionByName(over)
        if more.isEmpty():
            break
        spans = more.select(*keys, "lo", "hi").distinct()
        width = (F.col("hi") - F.col("lo")) / RANGES
        cut = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(RANGES - 1)).cast("int")
        counts = values.join(broadcast_if_small(spans), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        counts = counts.groupBy(*keys, "lo", "hi", F.when(width > 0, cut).otherwise(0).alias("cut")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        counts = table(counts, "quantile-counts")
        sofar = Window.partitionBy(*keys, "lo", "hi").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
        near = more.join(counts.withColumn("under", F.coalesce(F.sum("n").over(sofar), F.lit(0))), [*keys, "lo", "hi"])
        first = F.col("before") + F.col("under")
        near = near.where((F.col("rank") >= first) & (F.col("rank") < first + F.col("n")))
        left = table(near.select(*keys, "share", "place", F.col("low").alias("lo"), F.col("high").alias("hi"), first.alias("before"), F.col("n").alias("inside"), "rank"), "quantile-ranks")
    done = table(done, "quantile-ranks")
    spans = done.where("lo < hi").select(*keys, "lo", "hi", "before").distinct()
    inside = values.join(broadcast_if_small(spans), keys).where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "hi", "before").agg(F.sort_array(F.collect_list("v")).alias("sorted"))  # FINISH values at most
    found = done.join(inside, [*keys, "lo", "hi", "before"], "left").select(*keys, "share", "place", "rank", F.coalesce(F.get("sorted", (F.col("rank") - F.col("before")).cast("int")), "lo").alias("value"))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    part = F.max("place") - F.floor(F.max("place"))
    return found.groupBy(*keys, "share").agg((low * (1 - part) + high * part).alias("value"))


def sketched_quantiles(df: DataFrame, columns: list[str], shares: list[float], error: float = 1e-4) -> DataFrame:
    """(column, share, value) from one pass of mergeable sketches: the rank of a value is off by at most ``error`` of all rows."""
    at = F.array(*[F.lit(float(s)) for s in shares])
    sketches = [F.struct(F.lit(c).alias("column"), at.alias("shares"), F.percentile_approx(F.col(f"`{c}`").cast("double"), list(map(float, shares)), round(1 / error)).alias("values")) for c in columns]
    rows = df.agg(F.array(*sketches).alias("s")).select(F.inline("s"))
    return rows.select("column", F.explode(F.arrays_zip("shares", "values")).alias("z")).select("column", F.col("z.shares").alias("share"), F.col("z.values").alias("value"))
