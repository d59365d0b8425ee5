"""The registered queries: against their twins, and the pipeline stage by stage."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from pairloom.llm.common import materialize
from pairloom.llm.queries import QUERIES, TWINS
from tests.llm.helpers import DOCS, awkward, frame, words
from tests.llm.test_tables import components, fingerprint

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    result = con.execute(TWINS[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows(spark, con, name):
    table = "pages" if name.startswith("op10") else "documents"
    n, rows = QUERIES[name](spark, SF).count(), con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    assert n >= rows if name.startswith("op7") else n == rows


def test_pipeline_stages(spark):
    """What each stage keeps of its own input."""
    rows = awkward()
    docs = materialize(frame(spark, rows).repartition(3), "test")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = materialize(stage(spark, docs, SF), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema == out[0].schema
    raw, ruled, lined, unique, mixed = ([tuple(r) for r in d.collect()] for d in out)
    assert {r[0] for r in raw} - {r[0] for r in ruled} == {130, 131, 132, 151, 152}
    assert len(lined) == len(ruled) and all(r[4] == len(r[1]) for r in lined)
    root = components([fingerprint(r[1]) for r in lined], 2)
    assert len(unique) == len(set(root))
    assert set(mixed) <= set(unique) and all(mixed.count(r) <= 2 for r in unique)
    assert sum(len(words(r[1])) for r in mixed) <= 1.5 * sum(len(words(r[1])) for r in unique)
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in mixed}


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
    assert docs.count() == 0


def test_pipeline_query(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
