"""Counts, profiles, repeated-run summaries, run choice and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_KEYS = ("dataset", "scenario")


def profile(rel: DataFrame, group_cols: Sequence[str] = ("split",), left: str = "drug_id",
            right: str = "prot_id", label: str = "label") -> DataFrame:
    """Rows, positives, negatives and distinct entities per group."""
    return rel.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.countDistinct(left).alias("drugs"),
        F.countDistinct(right).alias("targets"),
    )


# Repeats of a split whose bits fit a BIGINT.
MASK_REPEATS = 15


def profile_repeats(rel: DataFrame, sides: DataFrame, entity: str, other: str, seeds: Sequence[int], left: str = "drug_id",
                    label: str = "label") -> DataFrame:
    """:func:`profile` per ``seed`` and ``split`` of a split by one side, for all seeds at once.

    ``sides`` has a row per seed and value of ``entity`` with its ``split``.  The rows
    are read once for either side and never repeated for a seed: an entity stands
    for its rows, and one of the other side keeps a bit for each split that it meets.
    """
    if len(seeds) > MASK_REPEATS:
        parts = [profile_repeats(rel, sides, entity, other, some, left, label) for some in (seeds[:MASK_REPEATS], seeds[MASK_REPEATS:])]
        return parts[0].unionByName(parts[1])
    cells = [(s, k) for s in seeds for k in ("train", "val", "test", "unused")]
    bit = {c: 1 << i for i, c in enumerate(cells)}

    def each(hits: Column) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(k).alias("split"), hits.bitwiseAND(F.lit(b)).alias("hit")) for (s, k), b in bit.items()]))

    own = F.sum(F.coalesce(*[F.when((F.col("seed") == s) & (F.col("split") == k), F.lit(b)) for (s, k), b in bit.items()]).cast("bigint"))
    masks = sides.where(F.col(entity).isNotNull()).groupBy(entity).agg(own.alias("_mask"))
    missing = F.lit(sum(bit[s, "unused"] for s in seeds)).cast("bigint")
    counted = rel.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    ).join(masks, entity, "left").withColumn("_mask", F.coalesce("_mask", missing))
    sums = counted.select(entity, "rows", "positives", "negatives", each(F.col("_mask"))).where("hit <> 0").groupBy("seed", "split").agg(
        *[F.sum(c).alias(c) for c in ("rows", "positives", "negatives")], F.count(entity).alias("_own")
    )
    met = rel.select(other, entity).join(masks, entity, "left").groupBy(other).agg(F.bit_or(F.coalesce("_mask", missing)).alias("_mask"))
    found = met.select(other, each(F.col("_mask"))).where("hit <> 0").groupBy("seed", "split").agg(F.count(other).alias("_other"))
    drugs, targets = ("_own", "_other") if entity == left else ("_other", "_own")
    return sums.join(found, ["seed", "split"]).select(
        "seed", "split", "rows", "positives", "negatives", F.col(drugs).alias("drugs"), F.col(targets).alias("targets")
    )


def class_histogram(rel: DataFrame, label: str = "label") -> DataFrame:
    return rel.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def entity_stats(rel: DataFrame, left: str = "drug_id", right: str = "prot_id", label: str = "label",
                 approximate: bool = False) -> DataFrame:
    """Entities, interactions and the share of cells that interact."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    interactions = F.col(label) == 1
    counts = rel.agg(
        count(left).alias("drugs"),
        count(right).alias("targets"),
        F.count_if(interactions).alias("interactions"),
    )
    cells = F.col("drugs").cast("double") * F.col("targets")
    return counts.withColumn("density", F.try_divide(F.col("interactions").cast("double"), cells))


def contingency(rel: DataFrame, left: str = "drug_id", right: str = "prot_id") -> DataFrame:
    """Row count per pair; pairs that do not occur count 0 and are not stored."""
    return rel.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))


def contingency_wide(rel: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Pivoted counts for a known, short list of columns, absent ones 0."""
    return rel.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def both_classes(rel: DataFrame, group_cols: Sequence[str] = ("split",), label: str = "label") -> DataFrame:
    test = (F.max(label) == 1) & (F.min(label) == 0)
    return rel.groupBy(*group_cols).agg(test.alias("both_classes"))


def repeats(runs: DataFrame, metrics: Sequence[str], keys: Sequence[str] = RUN_KEYS, digits: int = 6) -> DataFrame:
    """Mean and sample deviation over runs; a single run deviates by 0."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("runs")]
    for m in metrics:
        deviation = F.coalesce(F.stddev_samp(m), F.lit(0.0))
        aggs += [F.round(F.avg(m), digits).alias(f"mean_{m}"), F.round(deviation, digits).alias(f"std_{m}")]
    return runs.groupBy(*keys).agg(*aggs)


def best_run(runs: DataFrame, keys: Sequence[str], run: str, score: str, mtime: str, is_last: str | None = None) -> DataFrame:
    """Run with the highest score, then the latest; a ``last`` run only if alone.

    Among ``last`` runs only the time counts.  A run without a score ranks below all.
    """
    last = F.col(is_last) if is_last else F.lit(False)
    value = F.when(last, F.lit(None)).otherwise(F.col(score))
    rank = F.struct(
        (~last).alias("regular"),
        F.coalesce(value, F.lit(float("-inf"))).alias("score"),
        F.col(mtime).alias("mtime"),
        F.col(run).alias("run"),
    )
    kept = F.struct(*[F.col(c) for c in dict.fromkeys((run, score, mtime))])
    return runs.groupBy(*keys).agg(F.max_by(kept, rank).alias("_best")).select(*keys, "_best.*")


def pending_runs(planned: DataFrame, logged: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Planned runs without a log that yields every metric."""
    done = logged.na.drop(subset=list(metrics)).select(*keys).distinct()
    return planned.join(done, list(keys), "left_anti")


def export_rows(checked: DataFrame, predictions: DataFrame, splits: DataFrame | None = None,
                row: str = "source_row") -> DataFrame:
    """Every original row with its reason, prediction and split.

    Rows without a prediction are ``excluded``; predicted rows without a split
    are ``unused``.
    """
    scored = predictions.select(row, "predicted_label", "probability_active", "probability_inactive")
    out = checked.withColumn("excluded_reason", F.coalesce("reason", F.lit(""))).join(
        scored.withColumn("_scored", F.lit(True)), row, "left"
    )
    columns = [
        F.col(row), F.col("smiles"), F.col("sequence"), F.col("activation").alias("activity"),
        F.col("excluded_reason"), F.col("predicted_label"), F.col("probability_active"),
        F.col("probability_inactive"),
    ]
    if splits is not None:
        out = out.join(splits.select(row, F.col("split").alias("_split")), row, "left")
        columns.append(
            F.when(F.col("_scored"), F.coalesce("_split", F.lit("unused"))).otherwise("excluded").alias("split")
        )
    return out.select(*columns)


def held_out(rows: DataFrame, splits: DataFrame, row: str = "source_row", split: str = "test") -> DataFrame:
    return rows.join(splits.where(F.col("split") == split).select(row), row, "left_semi")


def stability(df: DataFrame, anchor: str, score: str) -> DataFrame:
    """Five-number summary and deviation of each anchor's scores over its contexts."""
    from pairloom.operators.metrics import quantiles

    spread = df.groupBy(anchor).agg(
        F.count(F.lit(1)).alias("contexts"),
        F.min(score).alias("low"),
        F.max(score).alias("high"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
    )
    return spread.join(quantiles(df, score, (0.25, 0.5, 0.75), [anchor]), anchor)


def group_dictionary(df: DataFrame, group: str, ident: str, order: str) -> DataFrame:
    """Dense code per id inside a batch, in order of first appearance.

    Batches have a fixed size, which bounds the ids ranked together.
    """
    first = df.groupBy(group, ident).agg(F.min(order).alias("first_pos"))
    code = F.row_number().over(Window.partitionBy(group).orderBy("first_pos")) - 1
    return first.select(group, ident, code.alias("code"))
