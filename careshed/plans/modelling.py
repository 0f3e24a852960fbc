"""From feature families and weekly counts to a modelling table, and from that to compared models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careshed.core.work import table
from careshed.operators import features as ft
from careshed.operators import models


def modelling_table(families: list[DataFrame], counts: DataFrame, area: str, week: str, target: str, top: int = 60, limit: float = 0.95, train_to: int = 18, val_to: int = 22, fit_on: str = "all") -> DataFrame:
    """Keys, target, temporal columns, the selected features and the split.

    Families are merged and counts joined, rows without a target dropped, temporal and interaction features added,
    features ranked by correlation with the target and pruned of collinear ones; ``fit_on`` says on which rows.
    """
    keys = [area, week]
    panel = ft.with_counts(ft.merge_families(families, keys), counts, keys, target)
    panel = ft.interactions(ft.temporal(panel.dropna(subset=[target]), area, week), area, week)
    panel = table(ft.temporal_split(panel, train_to=train_to, val_to=val_to), "modelling")
    fixed = {*keys, target, "week_number", "week_of_year", "month", "quarter", "days_since_start"}
    names = ft.numeric_columns(panel, fixed)
    basis = panel.where("split = 'train'") if fit_on == "train" else panel
    ranked = table(ft.top_features(ft.target_correlation(basis, target, names), top), "modelling-ranks")
    order = [r.feature for r in ft.strongest_first(ranked).collect()]  # one row for each feature
    kept = {r.feature for r in ft.prune_collinear(ft.correlation_matrix(basis, order), ranked, limit).collect()} if len(order) > 1 else set(order)
    return panel.select(*keys, target, "week_number", "week_of_year", "month", "quarter", "season", "days_since_start", "split", *[f for f in order if f in kept])


def compare_models(panel: DataFrame, features: list[str], area: str, week: str, target: str, fits: dict = models.MODELS, sets: tuple[str, ...] | None = None) -> DataFrame:
    """The leaderboard over the feature sets, with lags of the target inside each split."""
    rows = ft.lagged(panel, target, area, week, "split")
    rows = table(ft.one_hot(rows, "season", ["Fall", "Spring", "Summer", "Winter"]), "modelling-lags")
    lags = [f"{target}_lag1", f"{target}_lag2"]
    temporal = ["week_of_year", "month", "days_since_start"]
    train = rows.where("split = 'train'")
    known = train.agg(*[F.count(c).alias(c) for c in features]).first()  # a feature without values would leave no row to fit
    top, rest = ft.ranked_features(ft.target_correlation(train, target, [c for c in features if known[c]]))
    chosen = models.feature_sets(temporal, top, lags, rest)
    return models.compare(rows, {k: f for k, f in chosen.items() if sets is None or k in sets}, target, fits)
