from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import scalars as S
from pairloom.operators import validate

GOOD = ("CCO", "ACDEFGHIK", "1")


def reasons(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_row long, smiles string, sequence string, activation string")
    return [r["reason"] for r in validate.with_reason(df).orderBy("source_row").collect()]


def test_one_row_per_reason(spark):
    found = reasons(spark, [
        GOOD, ("", "ACD", "1"), ("C", " ", "1"), ("C", "ACD", "1.0"), ("C", "ACB", "0"),
        ("C" * 511, "ACD", "0"), ("C", "A" * 701, "0"),
    ])
    assert found == [None, *validate.REASONS]


def test_priority_nulls_and_limits(spark):
    found = reasons(spark, [
        (None, None, None), ("C", None, "x"), ("C", "acd", None), ("C" * 600, "ACB", "1"),
        ("C" * 510, "A" * 700, "1"), ("C" * 511, "A" * 701, "1"), (" CCO\t", "ACD\n", " 1 "),
    ])
    assert found == [
        "empty_smiles", "empty_sequence", "invalid_activation", "non_canonical_sequence", None, "smiles_too_long", None,
    ]


def test_partition_and_counts(spark):
    rows = [GOOD, ("", "ACD", "1"), ("", "ACD", "1"), ("C", "X1", "0")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_row long, smiles string, sequence string, activation string")
    checked = validate.with_reason(df)
    assert validate.accepted(checked).select("source_row", "label").collect() == [(0, 1)]
    assert [tuple(r) for r in validate.reason_counts(checked).collect()] == [("empty_smiles", 2), ("non_canonical_sequence", 1)]
    validate.require_accepted(checked)
    with pytest.raises(ValueError, match="rejected"):
        validate.require_accepted(checked.where("source_row > 0"))
    with pytest.raises(ValueError, match="no data"):
        validate.require_accepted(checked.where("false"))


def test_headers(spark):
    df = spark.createDataFrame([("a", "b", "1", "x")], [" SMILES", "Sequence ", "ACTIVATION", "other"])
    assert validate.resolve_columns(df).columns == ["smiles", "sequence", "activation"]
    with pytest.raises(ValueError, match="activation"):
        validate.resolve_columns(df.drop("ACTIVATION"))
    with pytest.raises(ValueError, match="expected 3"):
        validate.positional_columns(df)


def test_scalars(spark):
    df = spark.createDataFrame([(" Kd run/1! ", 0.0), ("..--", 1e9), ("", 50.0)], "t string, x double")
    assert [r[0] for r in df.select(S.slug(F.col("t"))).collect()] == ["Kd_run_1", "custom", "custom"]
    p = [r[0] for r in df.select(F.round(S.nm_to_p(F.col("x")), 6)).collect()]
    assert p == [19.0, 0.0, 7.30103]
    back = [r[0] for r in df.select(F.round(S.convert_unit(S.nm_to_p(F.col("x")), "p", "nM"), 6)).collect()]
    assert back == [0.0, 1e9, 50.0]
    with pytest.raises(ValueError):
        S.convert_unit(F.col("x"), "uM", "p")
    plain = spark.createDataFrame([("CC(=O)O",), ("C@H",), ("",), ("A\n",)], "s string")
    assert [r[0] for r in plain.select(S.is_plain_smiles(F.col("s"))).collect()] == [True, False, True, False]
    metric = spark.createDataFrame([(0.5,), (None,)], "m double").select(S.metric_text(F.col("m")))
    assert [r[0] for r in metric.collect()] == ["0.500000", "n/a"]


def test_logit_loss_does_not_overflow(spark):
    df = spark.createDataFrame([(1000.0, 0), (-1000.0, 1), (0.0, 1)], "z double, y int")
    got = [round(r[0], 6) for r in df.select(S.logit_loss(F.col("z"), F.col("y"))).collect()]
    assert got == [1000.0, 1000.0, 0.693147]
