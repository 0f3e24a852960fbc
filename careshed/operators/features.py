"""Modelling tables: joins of feature families, temporal and interaction features, profiles, selection, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from careshed.functions.scalars import season
from careshed.operators.moments import correlations, exact_quantiles

#: Decimals of a correlation that are told apart: what comes after them is the order in which rows were added up.
R_DIGITS = 9


def merge_families(families: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of the families on the keys; of columns that several have, the first family's stays."""

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.select(*keys, *[c for c in right.columns if c not in left.columns]), keys, "full")

    return reduce(merge, families)


def with_counts(features: DataFrame, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    return features.join(counts.select(*keys, count), keys, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def union_areas(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def temporal(panel: DataFrame, area: str, week: str) -> DataFrame:
    """ISO week, month, quarter, season, days since the first week of all, and the area's week number."""
    first = panel.agg(F.min(week).alias("__first"))
    w = Window.partitionBy(area).orderBy(week)
    out = panel.join(F.broadcast(first))  # one row
    out = out.withColumn("week_of_year", F.weekofyear(week)).withColumn("month", F.month(week)).withColumn("quarter", F.quarter(week)).withColumn("season", season(F.col(week)))
    return out.withColumn("days_since_start", F.datediff(week, "__first")).withColumn("week_number", F.row_number().over(w)).drop("__first")


def interactions(panel: DataFrame, area: str, week: str, temp: str = "t_mean", rain: str = "p_total", hot: str = "t_max", wet: str = "wetday_frac") -> DataFrame:
    """Products and flags of climate columns, each only if its columns are there."""
    have, out = set(panel.columns), panel
    if {temp, rain} <= have:
        out = out.withColumn("temp_x_rain", F.col(temp) * F.col(rain))
    if hot in have:
        out = out.withColumn("extreme_heat", (F.col(hot) > 35).cast("int"))
    if rain in have:
        out = out.withColumn("heavy_rain", (F.col(rain) > 10).cast("int"))
        w = Window.partitionBy(area).orderBy(week).rowsBetween(-3, 0)
        out = out.withColumn("rain_4w", F.when(F.count(rain).over(w) == 4, F.sum(rain).over(w)))
    if {hot, wet} <= have:
        out = out.withColumn("dry_heat", F.when(F.col(hot) > 35, 1 - F.col(wet)).otherwise(F.col(hot) * 0))
    return out


def lagged(panel: DataFrame, target: str, area: str, week: str, split: str | None = None, lags: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The target of earlier rows of the area, inside each split if there is one."""
    w = Window.partitionBy(*[c for c in (split, area) if c]).orderBy(week)
    return panel.select("*", *[F.lag(target, k).over(w).alias(f"{target}_lag{k}") for k in lags])


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") AS (feature, n_missing)"))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """0/1 columns for all of the training values, in order, but the first."""
    return df.select("*", *[F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in sorted(values)[1:]])


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = exact_quantiles(df, columns, [0.5]).groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"__{c}") for c in columns])
    out = df.join(F.broadcast(medians))  # one row
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def standardise(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation, of ``train``; a constant column becomes 0."""
    stats = train.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = df.join(F.broadcast(stats))  # one row
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return out.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, median, zeros, zero_pct, missing, missing_pct), from one aggregation."""
    n = F.count("*")

    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        zeros, missing = F.count(F.when(x == 0, 1)), F.count(F.when(x.isNull(), 1))
        return F.struct(F.lit(c).alias("feature"), F.avg(x).alias("mean"), F.stddev(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.median(x).alias("median"), zeros.alias("zeros"), F.try_divide(100.0 * zeros, n).alias("zero_pct"), missing.alias("missing"), F.try_divide(100.0 * missing, n).alias("missing_pct"))

    return df.agg(F.array(*[stats(c) for c in columns]).alias("s")).select(F.inline("s"))


def _corr(x: Column, y: Column) -> Column:
    """Pairwise complete correlation; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    moments = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), moments))


def target_correlation(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, ord, r): ord is the place of the feature in the list."""
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ord"), _corr(F.col(c), F.col(target)).alias("r")) for i, c in enumerate(features)]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def strongest_first(correlations: DataFrame) -> DataFrame:
    """By the size of r, equal ones in the order of the list. A column and one minus it are equal but for the last digits."""
    return correlations.orderBy(F.round(F.abs("r"), R_DIGITS).desc_nulls_last(), "ord")


def top_features(correlations: DataFrame, k: int) -> DataFrame:
    return strongest_first(correlations.where("r IS NOT NULL")).limit(k)


def ranked_features(correlations: DataFrame) -> tuple[list[str], list[str]]:
    """The features with a correlation, the strongest first, and those without, in the order of the list."""
    rows = strongest_first(correlations).collect()  # one row for each feature
    return [r.feature for r in rows if r.r is not None], [r.feature for r in rows if r.r is None]


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, left, right, r) of the upper triangle, from moments that tasks add up in blocks."""
    names = F.array(*[F.lit(f) for f in features])
    return correlations(df, features).select("i", "j", F.get(names, "i").alias("left"), F.get(names, "j").alias("right"), "r")


def prune_collinear(matrix: DataFrame, features: DataFrame, limit: float = 0.95) -> DataFrame:
    """Features (feature, ord) without those that correlate beyond the limit with any earlier one, dropped or not."""
    gone = matrix.where(F.abs("r") > limit).select(F.col("right").alias("feature")).distinct()
    return features.join(gone, "feature", "left_anti")


def temporal_split(panel: DataFrame, week_number: str = "week_number", train_to: int = 18, val_to: int = 22) -> DataFrame:
    n = F.col(week_number)
    return panel.withColumn("split", F.when(n <= train_to, "train").when(n <= val_to, "val").otherwise("test"))


def stamp(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def metadata_json(panel: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row, one JSON document: sizes, target and feature statistics."""
    stats = profile(panel, [target, *features]).agg(F.collect_list(F.struct("feature", "mean", "std", "min", "max", "median", "missing")).alias("columns"))
    head = panel.agg(F.count("*").alias("n_rows"))
    return head.join(F.broadcast(stats)).select(F.to_json(F.struct("n_rows", F.lit(target).alias("target"), F.lit(len(features)).alias("n_features"), "columns")).alias("value"))  # one row
