"""Scalar expressions on text, labels and measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty canonical residues, the SMILES characters accepted
# for affinity data, the characters that count as white space, and the limits.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
SMILES_CHARACTERS = r"A-Za-z0-9\(\)\[\]\-\.=#$:/+"
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
MAX_SMILES = 510
MAX_SEQUENCE = 700
MIN_STRUCTURE = 30
AFFINITY_CEILING = 1e7


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends of the text form."""
    return F.btrim(col.cast("string"), F.lit(WHITE_SPACE))


def is_binary_label(col: Column) -> Column:
    return F.coalesce(col.isin("0", "1"), F.lit(False))


def is_canonical_sequence(col: Column) -> Column:
    return F.coalesce(col.rlike(rf"\A[{AMINO_ACIDS}]+\z"), F.lit(False))


def is_plain_smiles(col: Column, characters: str = SMILES_CHARACTERS) -> Column:
    return F.coalesce(col.rlike(rf"\A[{characters}]*\z"), F.lit(False))


def fits(col: Column, max_len: int, inclusive: bool = True) -> Column:
    n = F.length(col)
    return n <= max_len if inclusive else n < max_len


def strip_qualifier(col: Column) -> Column:
    """Drop the ``<`` and ``>`` that mark one-sided measurements."""
    return F.translate(col, "<>", "")


def nm_to_p(col: Column) -> Column:
    """Concentration in nM to its negative decadic log in M; zero counts as 1e-10 nM."""
    nm = col.cast("double")
    return -F.log10(F.when(nm == 0.0, F.lit(1e-10)).otherwise(nm) * F.lit(1e-9))


def p_to_nm(col: Column) -> Column:
    return F.pow(F.lit(10.0), -col.cast("double")) / F.lit(1e-9)


def convert_unit(col: Column, source: str, target: str) -> Column:
    """Convert between the units ``nM`` and ``p``."""
    if {source, target} - {"nM", "p"}:
        raise ValueError("units are 'nM' and 'p'")
    nm = col.cast("double") if source == "nM" else p_to_nm(col)
    return nm_to_p(nm) if target == "p" else nm


def slug(col: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(col), "[^A-Za-z0-9._-]+", "_")
    bare = F.regexp_replace(cleaned, "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("custom"))


def numbered_id(prefix: str, n: Column) -> Column:
    return F.format_string(prefix + "_%06d", n)


def id_field(col: Column, separator: str = r"\|", field: int = 1) -> Column:
    """One field of a delimited identifier; NULL where there are too few."""
    return F.get(F.split(col, separator), F.lit(field))


def characters(col: Column) -> Column:
    """Characters of a text, in order."""
    return F.when(F.length(col) > 0, F.split(col, "")).otherwise(F.array().cast("array<string>"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def decide(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).when(p < threshold, 0)


def metric_text(col: Column) -> Column:
    return F.when(col.isNull(), "n/a").otherwise(F.format_string("%.6f", col))


def logit_loss(z: Column, y: Column) -> Column:
    """Log loss of one logit, in the form that does not overflow."""
    y = y.cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
