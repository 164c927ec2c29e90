"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from matchloom.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    def shown(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) and not math.isinf(v) else str(v)

    return sorted("|".join(shown(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_all_branches_are_reached(spark):
    assert {r.status for r in QUERIES["recognize_cards"](spark, SF).select("status").distinct().collect()} == {"matched", "ambiguous", "unrecognized"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_stays_cached(spark):
    """Queries leave nothing behind in the session that a later one could read."""
    for name in ("recognize_cards", "response_flat", "accuracy_by_slice"):
        QUERIES[name](spark, SF).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
