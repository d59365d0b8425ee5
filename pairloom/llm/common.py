"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import materialize, tune

# The white space of every contract, as characters and as a character class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = [
    "LOWER", "SPACE", "SPACE_CLASS", "UPPER", "ascii_lower", "filled", "key_pair", "materialize", "no_space",
    "read_table", "tune", "words",
]


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def filled(text: str | Column) -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def no_space(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters outside ``SPACE``."""
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def key_pair(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that differ in their start, together a 128-bit key."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)
