"""Entity tables with dense ids, and the relation between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.scalars import numbered_id
from pairloom.operators.sampling import global_position

# First occurrences are numbered block by block of this many row numbers.
ROW_BLOCK = 1 << 20


@dataclass(frozen=True)
class Tables:
    left: DataFrame
    right: DataFrame
    relation: DataFrame


def entity_table(df: DataFrame, value: str, row: str, ident: str, prefix: str) -> DataFrame:
    """One row per distinct value; ids count up in order of first appearance.

    ``row`` is the dense 0-based row number, so ``row / ROW_BLOCK`` bounds the
    rows that are numbered together, however large the table is.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(row).alias("first_row"))
    block = F.floor(F.col("first_row") / ROW_BLOCK)
    numbered = global_position(first, block, [F.col("first_row")], "n")
    return numbered.select(numbered_id(prefix, F.col("n")).alias(ident), value, "first_row")


def to_tables(df: DataFrame, left_value: str = "smiles", right_value: str = "sequence",
              row: str = "source_row", label: str = "label") -> Tables:
    """Normalise accepted records; duplicates stay in the relation."""
    left = entity_table(df, left_value, row, "drug_id", "drug")
    right = entity_table(df, right_value, row, "prot_id", "protein")
    relation = df
    for table, value in ((left, left_value), (right, right_value)):
        lookup = table.drop("first_row")
        relation = relation.join(lookup, value)
    relation = relation.select("drug_id", "prot_id", label, row)
    return Tables(left.drop("first_row"), right.drop("first_row"), relation)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stable order, as an aggregate that combines early."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[
        F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns
    ])


def join_by_position(a: DataFrame, b: DataFrame, pos: str = "source_row") -> DataFrame:
    """Put two equally ordered lists side by side."""
    return a.join(b, pos)


def translate_ids(rel: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Replace an id by its counterpart; unknown ids become NULL."""
    lookup = mapping.select(F.col(source).alias(column), F.col(target).alias("_to"))
    out = rel.join(lookup, column, "left")
    return out.select(*[F.col("_to").alias(c) if c == column else F.col(c) for c in rel.columns])


def prefixed(col: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), col.cast("string"))
