"""All queries of the library by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from careshed.queries.views import Views, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", places).cast("double").alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None, helpers: dict[str, str] | None = None, places: int | None = 6, raw: bool = False):
    """Register a function of Views under ``name``; its doubles are rounded to ``places`` (none: it rounds them itself).
    ``raw`` SQL has its views already."""

    def register(f: Callable[[Views], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir)) if places is None else rounded(f(Views(spark, sf_dir)), places)
        if sql:
            _SQL[name] = sql if raw else with_views(sql, helpers)
        return f

    return register


def _load() -> None:
    for module in ("surveillance", "spatial", "climate", "features", "models", "exports"):
        importlib.import_module(f"careshed.queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
