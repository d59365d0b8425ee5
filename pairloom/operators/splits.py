"""Train / validation / test assignment and class balancing.

Sizes follow the remainder rule: ``n_test = ceil(r_test * n)``, then
``n_val = ceil(r_val * (n - n_test))``, and the rest trains.

A hash cut is a literal, so every split that depends on hashes alone is a
map-side expression on the relation: no join and no shuffle of the rows.  Only
rows that share the very hash of a cut are told apart by a further order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hashing import hex_threshold, seeded_hash
from pairloom.operators.sampling import HashCuts, hash_cuts, within
from pairloom.session import materialize

# Default ratios (the second for the plain classifier), default
# balancing quota, strategy names and their aliases.
RATIO = (0.79, 0.01, 0.20)
RATIO_PLAIN = (0.65, 0.15, 0.20)
UNBALANCED_RATIO = 10
STRATEGIES = {
    "warm": "random",
    "random": "random",
    "cold_drug": "cold_drug",
    "cold_target": "cold_target",
    "cold_full": "cold_full",
}
SPLITS = ("train", "val", "test")


def strategy_name(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"unknown split strategy {name!r}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def check_ratio(ratio: Sequence[float]) -> tuple[float, float, float]:
    if len(ratio) != 3 or any(r < 0 for r in ratio) or abs(sum(ratio) - 1.0) > 1e-9:
        raise ValueError("ratio must be three non-negative shares that sum to 1")
    return tuple(float(r) for r in ratio)


def split_ranks(ratio: Sequence[float]) -> dict[str, Column]:
    """Cumulative cut ranks over ``total``: test first, then validation."""
    _, r_val, r_test = check_ratio(ratio)
    n_test = F.ceil(F.lit(r_test) * F.col("total").cast("double"))
    n_val = F.ceil(F.lit(r_val) * (F.col("total") - n_test).cast("double"))
    return {"test": n_test, "val": n_test + n_val}


def split_label(h: Column) -> Column:
    """``unused`` where there is no hash, as for a missing entity."""
    return F.when(h.isNull(), "unused").when(within("test", h), "test").when(within("val", h), "val").otherwise("train")


def _label_by(df: DataFrame, cuts: HashCuts, h: Column, name: str = "split") -> DataFrame:
    return cuts.drop(cuts.attach(df, h).withColumn(name, split_label(h)))


def split_rows(
    rel: DataFrame,
    key: Column,
    ratio: Sequence[float] = RATIO,
    seed: int | Column = 42,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Warm split: rows are drawn regardless of their entities."""
    h = seeded_hash(seed, key)
    return _label_by(rel, hash_cuts(rel, h, split_ranks(ratio), group_cols), h)


def entity_cuts(
    rel: DataFrame, entity: str, ratio: Sequence[float], seed: int | str | Column, group_cols: Sequence[str] = ()
) -> HashCuts:
    """Cuts over the distinct entities, which are written once and then read twice."""
    distinct = rel.select(*group_cols, entity).where(F.col(entity).isNotNull()).distinct()
    entities = materialize(distinct, "entities")
    return hash_cuts(entities, seeded_hash(seed, entity), split_ranks(ratio), group_cols)


def split_cold(
    rel: DataFrame,
    entity: str,
    ratio: Sequence[float] = RATIO,
    seed: int | Column = 42,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """Cold split on one side: every entity lands in exactly one split.

    The entities split are the ones that occur, whatever their numbering.
    """
    return _label_by(rel, entity_cuts(rel, entity, ratio, seed, group_cols), seeded_hash(seed, entity))


def right_seed(seed: int | str) -> str:
    """Seed of the right side, so equal ids on both sides are independent."""
    return f"{seed}:right"


def split_cold_both(
    rel: DataFrame,
    left: str,
    right: str,
    ratio: Sequence[float] = RATIO,
    seed: int = 42,
    check: bool = True,
) -> DataFrame:
    """Cold on both sides; rows whose entities disagree become ``unused``."""
    right_key = right_seed(seed)
    out = _label_by(rel, entity_cuts(rel, left, ratio, seed), seeded_hash(seed, left), "_left")
    out = _label_by(out, entity_cuts(rel, right, ratio, right_key), seeded_hash(right_key, right), "_right")
    agreed = F.when(F.col("_left") == F.col("_right"), F.col("_left")).otherwise("unused")
    out = out.withColumn("split", agreed).drop("_left", "_right")
    if check:
        require_splits(out)
    return out


def require_splits(df: DataFrame, hint: str = "try another seed or larger validation/test ratios") -> None:
    """Raise unless train, validation and test all have rows."""
    found = {r["split"] for r in df.where(F.col("split").isin(*SPLITS)).select("split").distinct().collect()}
    missing = [s for s in SPLITS if s not in found]
    if missing:
        raise ValueError(f"empty split: {', '.join(missing)}; {hint}")


def split_by_indicator(rel: DataFrame, indicator: str = "indicator") -> DataFrame:
    """Honour a supplied split: 1 train, 2 validation, 3 test; other rows go."""
    code = F.col(indicator)
    named = F.when(code == 1, "train").when(code == 2, "val").when(code == 3, "test")
    return rel.withColumn("split", named).where(F.col("split").isNotNull())


def drop_unmapped(rel: DataFrame, left_entities: DataFrame, right_entities: DataFrame, left: str, right: str) -> DataFrame:
    """Keep the pairs whose entities are both known."""
    return rel.join(left_entities.select(left), left, "left_semi").join(
        right_entities.select(right), right, "left_semi"
    )


def carve_validation(
    rel: DataFrame, key: Column, fraction: float = 0.01, seed: int = 42, indicator: str = "indicator"
) -> DataFrame:
    """Move about ``fraction`` of the training rows (1) to validation (2)."""
    low = F.substring(seeded_hash(seed, key), 1, 8) < hex_threshold(fraction)
    return rel.withColumn(indicator, F.when((F.col(indicator) == 1) & low, 2).otherwise(F.col(indicator)))


def balance(
    rel: DataFrame,
    key: Column,
    ratio: int | None = 1,
    seed: int | Column = 42,
    label: str = "label",
    group_cols: Sequence[str] = ("split",),
) -> DataFrame:
    """Keep all positives and at most ``ratio`` negatives per positive, per split.

    Rows outside the three splits are dropped.  A falsy ratio keeps all.
    """
    used = rel.where(F.col("split") != "unused") if "split" in group_cols else rel
    if not ratio:
        return used
    h = seeded_hash(seed, key)
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    negative = F.coalesce(F.col(label) == 0, F.lit(False))
    cuts = hash_cuts(
        used,
        h,
        {"neg": F.lit(int(ratio)) * F.col("positives")},
        group_cols,
        where=negative,
        totals={"positives": positive.cast("bigint")},
    )
    return cuts.drop(cuts.attach(used, h).where(positive | (negative & within("neg", h))))


def split_relation(
    rel: DataFrame,
    strategy: str,
    key: Column,
    left: str = "drug_id",
    right: str = "prot_id",
    ratio: Sequence[float] = RATIO,
    seed: int = 42,
    balanced: bool = True,
    unbalanced_ratio: int | None = UNBALANCED_RATIO,
    attempts: int = 6,
) -> DataFrame:
    """Split by any strategy, then balance each split."""
    strategy = strategy_name(strategy)
    if strategy == "random":
        out = split_rows(rel, key, ratio, seed)
    elif strategy == "cold_drug":
        out = split_cold(rel, left, ratio, seed)
    elif strategy == "cold_target":
        out = split_cold(rel, right, ratio, seed)
    else:
        from pairloom.operators.coldfull import optimise_cold_both

        out = optimise_cold_both(rel, left, right, ratio, seed, attempts=attempts, balanced=balanced)
        require_splits(out)
    out = balance(out, key, 1 if balanced else unbalanced_ratio, seed)
    if strategy == "cold_full" and balanced:
        require_splits(out, "balancing emptied it; use larger ratios or an unbalanced scenario")
    return out
