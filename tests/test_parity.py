"""Every query with SQL gives DuckDB's rows; every other one gives rows with a stable schema."""

from __future__ import annotations

import math

import duckdb
import pytest

from careshed.queries import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x if x is None or isinstance(x, (int, bool)) else str(x)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = db.sql(registry.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    theirs = [tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()]
    assert ordered(ours) == ordered(theirs)


@pytest.mark.parametrize("name", ["o9_overlap_removal", "m3_ridge", "m12_pca"])
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
