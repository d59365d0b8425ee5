"""Ranking and classification metrics, exact with ties, without a global sort in one task.

Scores are first combined to one row per distinct score.  Those rows are range
partitioned, written once, and each range is cumulated on its own on top of the
sums of the ranges above it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import materialize

# Screening cutoffs and the early-recognition weight.
EF_FRACTIONS = (0.005, 0.01, 0.02)
BEDROC_ALPHA = 80.5


def ranked_scores(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with counts above it.

    Columns: the groups, ``score, pos, n, pos_above, n_above`` and the group
    totals ``n_pos, n_all``, as DOUBLE so that products of counts do not overflow.
    """
    g = list(group_cols)
    points = (
        df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(*g, F.col(p).alias("score"))
        .agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    ranged = materialize(
        points.repartitionByRange(*g, F.desc("score")).withColumn("_range", F.spark_partition_id()), "scores"
    )
    sums = ranged.groupBy(*g, "_range").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*g).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*g)
    offsets = sums.select(
        *g,
        "_range",
        F.coalesce(F.sum("_pos").over(above), F.lit(0.0)).alias("_pos0"),
        F.coalesce(F.sum("_n").over(above), F.lit(0.0)).alias("_n0"),
        F.sum("_pos").over(group).alias("n_pos"),
        F.sum("_n").over(group).alias("n_all"),
    )
    inside = Window.partitionBy(*g, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_p", F.coalesce(F.sum("pos").over(inside), F.lit(0.0)))
        .withColumn("_m", F.coalesce(F.sum("n").over(inside), F.lit(0.0)))
        .join(offsets, [*g, "_range"])
        .select(
            *g, "score", "pos", "n",
            (F.col("_pos0") + F.col("_p")).alias("pos_above"),
            (F.col("_n0") + F.col("_m")).alias("n_above"),
            "n_pos", "n_all",
        )
    )


def _per_group(ranked: DataFrame, group_cols: Sequence[str], **aggs: Column) -> DataFrame:
    return ranked.groupBy(*group_cols).agg(*[c.alias(n) for n, c in aggs.items()])


def _auroc() -> Column:
    """Pairs ranked right, ties counting half; NULL for a single class."""
    neg = F.col("n") - F.col("pos")
    n_neg = F.col("n_all") - F.col("n_pos")
    neg_below = n_neg - (F.col("n_above") - F.col("pos_above")) - neg
    return F.try_divide(
        F.sum(F.col("pos") * (neg_below + 0.5 * neg)), F.max(F.col("n_pos")) * F.max(n_neg)
    )


def _average_precision() -> Column:
    """Sum over distinct scores of recall gained times precision, without interpolation."""
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    return F.try_divide(F.sum(F.col("pos") * precision), F.max("n_pos"))


def ranking_metrics(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``auc`` and ``auprc`` with a ``note`` where a class is missing."""
    out = _per_group(
        ranked_scores(df, y, p, group_cols), group_cols, auc=_auroc(), auprc=_average_precision()
    )
    return out.withColumn(
        "note",
        F.concat_ws(
            " ",
            F.when(F.col("auc").isNull(), "AUC is undefined for a single class."),
            F.when(F.col("auprc").isNull(), "AUPRC is undefined without positives."),
        ),
    )


def auroc(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return _per_group(ranked_scores(df, y, p, group_cols), group_cols, auroc=_auroc())


def average_precision(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return _per_group(ranked_scores(df, y, p, group_cols), group_cols, average_precision=_average_precision())


def confusion(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Confusion counts at ``p >= threshold`` and F1, which is 0 when undefined."""
    hit, real = F.col(p) >= threshold, F.col(y) == 1
    counts = df.groupBy(*group_cols).agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )
    twice = 2 * F.col("tp")
    f1 = F.coalesce(F.try_divide(twice, twice + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.withColumn("f1", f1.cast("double"))


def mean_loss(df: DataFrame, loss: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg(loss).alias("loss"))


def enrichment(df: DataFrame, y: str, p: str, fractions: Sequence[float] = EF_FRACTIONS,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Hit rate among the top ``ceil(fraction * n)`` rows over the overall hit rate.

    Where the cutoff falls inside a tie, the tied rows count with their share of
    hits, so the result does not depend on the order of equal scores.
    """
    ranked = ranked_scores(df, y, p, group_cols).withColumn(
        "fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    )
    top = F.ceil(F.col("fraction") * F.col("n_all")).cast("double")
    taken = F.greatest(F.lit(0.0), F.least(F.col("n"), top - F.col("n_above")))
    hits = F.sum(F.col("pos") * taken / F.col("n"))
    rate = F.max("n_pos") / F.max("n_all")
    return ranked.groupBy(*group_cols, "fraction").agg(
        F.try_divide(hits / F.max(top), rate).alias("enrichment")
    )


def bedroc(df: DataFrame, y: str, p: str, alpha: float = BEDROC_ALPHA, group_cols: Sequence[str] = ()) -> DataFrame:
    """Boltzmann-enhanced discrimination, with tied rows at their mean weight."""
    ranked = ranked_scores(df, y, p, group_cols)
    step = F.lit(float(alpha)) / F.col("n_all")
    # Mean of exp(-step * rank) over the ranks n_above+1 .. n_above+n.
    geometric = (
        F.exp(-step * (F.col("n_above") + 1))
        * (F.lit(1.0) - F.exp(-step * F.col("n")))
        / (F.lit(1.0) - F.exp(-step))
        / F.col("n")
    )
    sums = ranked.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * geometric).alias("s"), F.max("n_pos").alias("k"), F.max("n_all").alias("n")
    )
    a, share = F.lit(float(alpha)), F.col("k") / F.col("n")
    random_sum = share * (1 - F.exp(-a)) / (F.exp(a / F.col("n")) - 1)
    rie = F.try_divide(F.col("s"), random_sum)
    scale = share * F.sinh(a / 2) / (F.cosh(a / 2) - F.cosh(a / 2 - a * share))
    shift = 1 / (1 - F.exp(a * (1 - share)))
    value = F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), rie * scale + shift)
    return sums.select(*group_cols, value.alias("bedroc"))


def rank_sum(df: DataFrame, first: str, value: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Two-sample Wilcoxon rank-sum with tie-averaged ranks and normal approximation.

    ``first`` is 1 for the first sample and 0 for the second.
    """
    ranked = ranked_scores(df, first, value, group_cols)
    below = F.col("n_all") - F.col("n_above") - F.col("n")
    mean_rank = below + (F.col("n") + 1) / 2
    sums = ranked.groupBy(*group_cols).agg(
        F.sum(F.col("pos") * mean_rank).alias("w"), F.max("n_pos").alias("n1"),
        F.max(F.col("n_all") - F.col("n_pos")).alias("n2"),
    )
    total = F.col("n1") + F.col("n2")
    z = F.try_divide(
        F.col("w") - F.col("n1") * (total + 1) / 2, F.sqrt(F.col("n1") * F.col("n2") * (total + 1) / 12)
    )
    return sums.withColumn("z", z).withColumn("p_value", two_sided_p(F.col("z")))


# Runs of one comparison that the exact law is worked out for; its table grows with their square.
EXACT_RUNS = 400


def rank_sum_exact(df: DataFrame, first: str, value: str, group_cols: Sequence[str]) -> DataFrame:
    """Two-sample rank-sum test by the exact law of the sum, for few repeats.

    ``first`` is 1 for the first sample and 0 for the second; ties share their mean
    rank.  A dynamic program over the ranks counts the choices of the first sample
    for each sum; the two-sided p-value is the share of choices whose sum is at
    least as far from its mean.  A comparison is one group, of at most
    ``EXACT_RUNS`` rows; larger ones are an error, since there the normal form of
    :func:`rank_sum` holds.  NULL in either column leaves a row out; a missing
    sample gives NULL.
    """
    g = list(group_cols)
    kept = df.where(F.col(first).isin(0, 1) & F.col(value).isNotNull()).select(*g, F.col(first).cast("int").alias("_x"), F.col(value).cast("double").alias("_v"))
    # Counted before they are gathered: an aggregate that combines early.
    sizes = kept.groupBy(*g).agg(F.count("*").alias("_n"))
    checked = sizes.withColumn("_ok", F.when(F.col("_n") <= EXACT_RUNS, True).otherwise(F.raise_error(F.lit(f"more than {EXACT_RUNS} runs in a comparison"))))
    rows = kept.join(checked.where("_ok").select(*[F.col(c).alias(f"_g_{c}") for c in g]), reduce(and_, [kept[c].eqNullSafe(F.col(f"_g_{c}")) for c in g], F.lit(True)))
    gathered = rows.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("_v", "_x"))).alias("_s"))

    @F.pandas_udf("w double, n1 int, n2 int, p_value double")
    def law(samples: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_rank_sum_law([(s["_v"], s["_x"]) for s in sample]) for sample in samples], columns=["w", "n1", "n2", "p_value"])

    return gathered.select(*g, law("_s").alias("_r")).select(*g, "_r.*")


def _rank_sum_law(sample: list[tuple[float, int]]) -> tuple[float, int, int, float | None]:
    values = np.array([v for v, _ in sample])
    chosen = np.array([x for _, x in sample], bool)
    # Twice the mean rank of each value, so that ties stay whole numbers.
    twice = np.searchsorted(values, values, "left") + np.searchsorted(values, values, "right") + 1
    n, n1 = len(values), int(chosen.sum())
    w = int(twice[chosen].sum())
    if n1 in (0, n):
        return w / 2, n1, n - n1, None
    top = int(np.sort(twice)[-n1:].sum())
    ways = np.zeros((n1 + 1, top + 1))
    ways[0, 0] = 1.0
    for rank in twice.tolist():
        for k in range(n1, 0, -1):
            ways[k, rank:] += ways[k - 1, : top + 1 - rank]
    mean = n1 * (n + 1)  # of twice the sum
    far = np.abs(np.arange(top + 1) - mean) >= abs(w - mean)
    return w / 2, n1, n - n1, min(1.0, float(ways[n1, far].sum() / ways[n1].sum()))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail by a published polynomial (absolute error below 1.5e-7)."""
    # Coefficients 7.1.26 of Abramowitz and Stegun.
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-x * x)


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], group_cols: Sequence[str]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``q_<percent>`` each.

    Works on counts per distinct value, so a group may be of any size.
    """
    ranked = ranked_scores(df.withColumn("_one", F.lit(1)), "_one", value, group_cols)
    below = F.col("n_all") - F.col("n_above") - F.col("n")

    def at(index: Column) -> Column:
        return F.max(F.when((below <= index) & (index < below + F.col("n")), F.col("score")))

    aggs = {}
    for q in probabilities:
        pos = F.lit(float(q)) * (F.col("n_all") - 1)
        low, part = F.floor(pos).cast("double"), F.max(pos - F.floor(pos))
        lower, upper = at(low), at(F.least(low + 1, F.col("n_all") - 1))
        aggs[f"q_{round(q * 100)}"] = lower + (upper - lower) * part
    return _per_group(ranked, group_cols, **aggs)
