"""Every named query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import queries as named

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
named.load_all()
QUERIES, TWINS = dict(named.QUERIES), dict(named.TWINS)
assert QUERIES.keys() <= entry.queries().keys() and TWINS.keys() <= entry.oracle_sql().keys()
ROWS_ONLY = {"split_cold_full_optimised", "featurize_hash", "mlp_scores", "parameter_search", "mean_similarity_all", "shingle_jaccard_low"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


def text(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def test_rows_only_queries_are_the_fitted_ones():
    assert set(QUERIES) - set(TWINS) == ROWS_ONLY
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(TWINS[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(tuple(map(text, row)) for row in result.fetchall())
    got = sorted(tuple(text(row[c]) for c in columns) for row in df.collect())
    assert got == expected


@pytest.mark.parametrize("name", sorted(ROWS_ONLY - {"split_cold_full_optimised"}))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
