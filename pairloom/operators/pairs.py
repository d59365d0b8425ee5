"""Positive pairs, the complement of the known pairs, and negatives drawn from it.

With ``m`` left and ``n`` right entities the complement has ``m*n`` cells minus
the known pairs.  It is never enumerated.  Both sides get a dense index, and the
free cells of one left entity are stored as runs ``(lo, hi)`` of right indexes
between its known ones: about as many rows as there are known pairs.  Sampling
draws cells by hash and rejects the known ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_int, seeded_hash
from pairloom.operators.sampling import global_position, sample_exact, shuffled_position
from pairloom.session import materialize

# Known pairs of one left entity are ordered in blocks of this many right indexes.
RIGHT_BLOCK = 1 << 16
DRAW_BLOCK = 1 << 20
# A draw is 60 bits of hash; with this many cells or fewer all are equally likely to one part in 16.
MAX_CELLS = 1 << 56


def linked_entities(entities: DataFrame, links: DataFrame, ident: str) -> DataFrame:
    """Entities that occur in the (unfiltered) link table."""
    return entities.join(links.select(ident).distinct(), ident, "left_semi")


def positives(links: DataFrame, left: DataFrame, right: DataFrame,
              left_id: str = "drug_id", right_id: str = "prot_id") -> DataFrame:
    """Distinct links whose two ends both survive."""
    known = links.select(left_id, right_id).na.drop().distinct()
    kept = known.join(left.select(left_id), left_id, "left_semi").join(
        right.select(right_id), right_id, "left_semi"
    )
    return kept.select(left_id, right_id)


def unmapped(rel: DataFrame, entities: DataFrame, ident: str) -> DataFrame:
    """Ids in the relation that the entity table lacks, with their rows."""
    return (
        rel.join(entities.select(ident), ident, "left_anti")
        .groupBy(ident)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def require_mapped(rel: DataFrame, entities: DataFrame, ident: str) -> DataFrame:
    if not unmapped(rel, entities, ident).isEmpty():
        raise ValueError(f"relation has {ident} values without an entity")
    return rel


@dataclass(frozen=True)
class Grid:
    """Dense indexes of both sides and the known cells between them."""

    left: DataFrame
    right: DataFrame
    known: DataFrame
    n_left: int
    n_right: int


def dense_index(entities: DataFrame, ident: str, name: str, seed: int | str) -> DataFrame:
    """Index 0..n-1 in hash order, the same for any id type."""
    ids = entities.select(ident).distinct()
    return shuffled_position(ids, seeded_hash(seed, ident), name)


def grid(links: DataFrame, left: DataFrame, right: DataFrame,
         left_id: str = "drug_id", right_id: str = "prot_id", seed: int = 42) -> Grid:
    """Each index is written once; counting, drawing and naming read it."""
    left_ix = materialize(dense_index(left, left_id, "left_ix", seed), "left-index")
    right_ix = materialize(dense_index(right, right_id, "right_ix", f"{seed}:right"), "right-index")
    known = (
        links.select(left_id, right_id).distinct()
        .join(left_ix, left_id).join(right_ix, right_id)
        .select("left_ix", "right_ix")
    )
    return Grid(left_ix, right_ix, materialize(known, "known-cells"), left_ix.count(), right_ix.count())


def free_runs(cells: Grid, block: int = RIGHT_BLOCK) -> DataFrame:
    """The complement as runs ``left_ix, lo, hi`` of free right indexes.

    Each left entity is fenced by the index ``n_right``; the cells between two
    neighbouring known indexes are free.  Neighbours are found per block of
    right indexes, which bounds the rows ordered together even for a left entity
    that holds a third of all links; the largest index of the earlier blocks
    carries over.
    """
    fence = cells.left.select("left_ix", F.lit(cells.n_right).cast("bigint").alias("right_ix"))
    marks = cells.known.unionByName(fence).withColumn("_b", F.floor(F.col("right_ix") / block))
    inside = Window.partitionBy("left_ix", "_b").orderBy("right_ix")
    earlier = Window.partitionBy("left_ix").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.groupBy("left_ix", "_b").agg(F.max("right_ix").alias("_max"))
        .select("left_ix", "_b", F.max("_max").over(earlier).alias("_carry"))
    )
    return (
        marks.withColumn("_prev", F.lag("right_ix").over(inside))
        .join(carried, ["left_ix", "_b"])
        .select(
            "left_ix",
            (F.coalesce("_prev", "_carry", F.lit(-1)) + 1).alias("lo"),
            (F.col("right_ix") - 1).alias("hi"),
        )
        .where(F.col("lo") <= F.col("hi"))
    )


def expand_runs(runs: DataFrame, chunk: int = RIGHT_BLOCK) -> DataFrame:
    """Every free cell, one row each, a bounded stretch of a run at a time.  The result is as large as the complement."""
    stretches = runs.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(chunk).cast("bigint"))))
    return stretches.select("left_ix", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + (chunk - 1)))).alias("right_ix"))


def draws_needed(k: int, free: int, cells: int) -> int:
    """Uniform draws over all cells that leave ``k`` distinct free ones, with slack."""
    expected = -cells * math.log1p(-k / free) if k < free else math.inf
    return int(expected + 8 * math.sqrt(expected) + 64)


def negatives(links: DataFrame, left: DataFrame, right: DataFrame, k: int | None,
              left_id: str = "drug_id", right_id: str = "prot_id", seed: int = 42) -> DataFrame:
    """``k`` free cells, uniform without replacement; all of them for ``None`` or more than there are.

    Cells are drawn by hash until ``k`` distinct free ones are found, so the work
    grows with ``k`` and not with the number of cells.  A sample of more than half
    of the free cells is as large as they are: then they are written out and the
    first ``k`` in hash order stay.
    """
    spark = links.sparkSession
    cells = grid(links, left, right, left_id, right_id, seed)
    all_cells = cells.n_left * cells.n_right
    if all_cells >= MAX_CELLS:
        raise ValueError(f"{all_cells} cells: more than the hash of a draw can tell apart")
    free = all_cells - cells.known.count()
    if k is None or 2 * k > free:
        found = expand_runs(free_runs(cells))
        if k is not None and k < free:
            found = sample_exact(materialize(found, "free-cells"), k, seeded_hash(seed, F.concat_ws(":", "left_ix", "right_ix")))
    else:
        n_draws = draws_needed(k, free, all_cells)
        while True:
            found = materialize(_draw(spark, n_draws, cells, seed), "drawn-cells")
            if found.count() >= k:
                break
            n_draws += draws_needed(k - found.count(), free, all_cells)
        found = global_position(found, F.floor(F.col("draw") / DRAW_BLOCK), [F.col("draw")])
        found = found.where(F.col("pos") < k)
    return found.join(cells.left, "left_ix").join(cells.right, "right_ix").select(left_id, right_id)


def sample_negatives(links: DataFrame, left: DataFrame, right: DataFrame, k: int | None = None,
                     left_id: str = "drug_id", right_id: str = "prot_id", seed: int = 42) -> DataFrame:
    """``k`` free cells; by default as many as there are links between the entities."""
    if k is None:
        k = positives(links, left, right, left_id, right_id).count()
    return negatives(links, left, right, k, left_id, right_id, seed)


def cell_index(cell: Column, n_right: int) -> tuple[Column, Column]:
    """Left and right index of a cell number, in integers throughout."""
    right_ix = F.pmod(cell, F.lit(n_right).cast("bigint"))
    return F.call_function("div", cell, F.lit(n_right).cast("bigint")), right_ix


def _draw(spark: SparkSession, n_draws: int, cells: Grid, seed: int) -> DataFrame:
    """Distinct free cells among the draws, with the first draw that hit each."""
    cell = hash_int(seeded_hash(seed, F.col("id"))) % F.lit(cells.n_left * cells.n_right)
    left_ix, right_ix = cell_index(F.col("cell"), cells.n_right)
    return (
        spark.range(n_draws)
        .select(F.col("id").alias("draw"), cell.alias("cell"))
        .groupBy("cell").agg(F.min("draw").alias("draw"))
        .select(left_ix.alias("left_ix"), right_ix.alias("right_ix"), "draw")
        .join(cells.known, ["left_ix", "right_ix"], "left_anti")
    )


def labelled_pairs(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def submatrix(links: DataFrame, left: DataFrame, right: DataFrame, k_left: int, k_right: int,
              left_id: str = "drug_id", right_id: str = "prot_id", seed: int = 42) -> DataFrame:
    """Links among sampled entities; entities left without a link drop out by themselves."""
    rows = sample_exact(left.select(left_id).distinct(), k_left, seeded_hash(seed, left_id))
    cols = sample_exact(right.select(right_id).distinct(), k_right, seeded_hash(f"{seed}:right", right_id))
    known = links.select(left_id, right_id).distinct()
    kept = known.join(rows, left_id, "left_semi").join(cols, right_id, "left_semi")
    return kept.select(left_id, right_id)


def known_targets(rel: DataFrame, entities: DataFrame, ident: str = "prot_id") -> DataFrame:
    """Relation rows whose entity still exists."""
    return rel.join(entities.select(ident).distinct(), ident, "left_semi")
