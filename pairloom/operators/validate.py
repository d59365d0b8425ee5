"""Checks on raw records: header names, first failing rule, accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.functions import scalars as S

# The names of the three input columns and the rejection reasons
# in order of priority.
TRIPLET = ("smiles", "sequence", "activation")
REASONS = (
    "empty_smiles",
    "empty_sequence",
    "invalid_activation",
    "non_canonical_sequence",
    "smiles_too_long",
    "sequence_too_long",
)


def resolve_columns(df: DataFrame, names: tuple[str, ...] = TRIPLET) -> DataFrame:
    """Pick columns by trimmed, case-insensitive header."""
    by_name = {c.strip().lower(): c for c in df.columns}
    missing = [n for n in names if n not in by_name]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select([F.col(f"`{by_name[n]}`").alias(n) for n in names])


def positional_columns(df: DataFrame, names: tuple[str, ...] = TRIPLET) -> DataFrame:
    """Name the columns by position; the width must match."""
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(df.columns)}")
    return df.toDF(*names)


def reason(smiles: Column, sequence: Column, activation: Column,
           max_smiles: int = S.MAX_SMILES, max_sequence: int = S.MAX_SEQUENCE) -> Column:
    """Name of the first failing rule, NULL for a good record."""
    def empty(c: Column) -> Column:
        return c.isNull() | (c == "")

    return (
        F.when(empty(smiles), "empty_smiles")
        .when(empty(sequence), "empty_sequence")
        .when(~S.is_binary_label(activation), "invalid_activation")
        .when(~S.is_canonical_sequence(sequence), "non_canonical_sequence")
        .when(~S.fits(smiles, max_smiles), "smiles_too_long")
        .when(~S.fits(sequence, max_sequence), "sequence_too_long")
    )


def with_reason(df: DataFrame) -> DataFrame:
    """Trim the three text columns and add ``reason``."""
    trimmed = df.withColumns({c: S.strip(F.col(c)) for c in TRIPLET})
    return trimmed.withColumn("reason", reason(*[F.col(c) for c in TRIPLET]))


def accepted(checked: DataFrame) -> DataFrame:
    """Good records with an integer ``label``."""
    good = checked.where(F.col("reason").isNull())
    return good.withColumn("label", F.col("activation").try_cast("int")).drop("activation", "reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull())


def reason_counts(checked: DataFrame) -> DataFrame:
    """Rejected rows per reason, in order of the reason."""
    return rejected(checked).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).orderBy("reason")


def counted(checked: DataFrame) -> tuple[DataFrame, Observation]:
    """The checked rows, and what is seen of them as they go by: ``accepted`` and the rows per reason.

    The counts are there once the rows have been written, without a second pass.
    """
    seen = Observation("checked rows")
    counts = [F.count_if(F.col("reason").isNull()).alias("accepted"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]]
    return checked.observe(seen, *counts), seen


def require_counted(counts: dict[str, int]) -> None:
    """:func:`require_accepted` by counts."""
    if not sum(counts.values()):
        raise ValueError("no data rows were found")
    if not counts["accepted"]:
        raise ValueError("every row was rejected")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_accepted(checked: DataFrame) -> DataFrame:
    """Fail on empty input and on input of which nothing is accepted."""
    require_rows(checked, "no data rows were found")
    require_rows(checked.where(F.col("reason").isNull()), "every row was rejected")
    return checked
