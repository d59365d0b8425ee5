"""Keyed, engine-independent pseudo-randomness: ``md5(seed ':' key)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_key(*cols: str | Column) -> Column:
    """One string key out of several columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def seeded_hash(seed: int | str | Column, key: str | Column) -> Column:
    """32 hex digits; their order is the random order of the keys."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def hash_int(h: Column) -> Column:
    """First 60 bits of a hash as a non-negative BIGINT."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def hex_threshold(fraction: float) -> str:
    """First eight hex digits below which a ``fraction`` of all hashes lies."""
    if not 0.0 <= fraction < 1.0:
        raise ValueError("fraction must be in [0, 1)")
    return f"{int(fraction * 16**8):08x}"
