"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed hash.  A document's virtual
finish time is the number of source words up to and including it, divided by the
weight of its source; a second pass over a source goes on where the first ended.
All passes are range-sorted by finish time and cut where the budget is reached.
A source that is used up simply has no more entries, so what it leaves is shared
out among the others by weight, which is what its target says.

Prefix sums are made in blocks of about the square root of the number of rows,
over leading hash bits, so that a source with a third of all rows is many tasks.
Only one row per source goes through a single task.

Defined results: NULL and empty texts have size 0; they take nothing but count
as taken while the cut is not reached.  A NULL source is a source, after all
others.  Rows that are alike in every column are interchangeable; each is mixed
on its own.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import filled, materialize, words

WEIGHTS = (3, 1, 2)
RATIO = 1.5
PASSES = 2


def word_count(text: Column) -> Column:
    return F.size(words(filled(text))).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, passes: int = PASSES) -> DataFrame:
    """One row per source: ``source, source_size, weight, target``.

    Sources in code point order get the weights in turn.  Targets share ``ratio``
    times all sizes by weight and stop at ``passes`` times their source: with
    sources in the order of that limit over their weight, the first one that stays
    below it sets the level of all that follow.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(passes)
    every = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        each.select("source", "source_size", limit.alias("limit"), weight.alias("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * ratio)
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.sum("weight").over(after))
        .withColumn("open", F.col("limit") / F.col("weight") > F.col("level"))
        .withColumn("share", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every))
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("share.level") * F.col("weight"), F.col("limit")))
    return levels.select("source", "source_size", "weight", target.alias("target"), "budget")


def plan(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, passes: int = PASSES, seed: int = 42
) -> DataFrame:
    """``id, key, source, size`` rows with ``copies``, ``source_size`` and ``target`` added.

    ``key`` stands for the text: with the id it decides the order.  A column ``mark``
    may tell apart rows that are alike in both; it has no part in the order.
    """
    spark = rows.sparkSession
    order = F.xxhash64(F.lit(seed), "id", "key", "size")
    mark = F.col("mark") if "mark" in rows.columns else F.lit(0).cast("long")
    sized = materialize(rows.select("id", "key", "source", "size", mark.alias("mark"), order.alias("h")), "sizes")
    blocks = 1 << max(0, math.ceil(math.log2(math.sqrt(sized.count() + 1))))
    bits = max(1, int(math.log2(blocks)))
    blocked = sized.withColumn("block", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits))
    sums = blocked.groupBy("source", "block").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s2"), F.col("block").alias("b2"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("source", "block").orderBy("h", "id", "key", "size", "mark")
    placed = blocked.select(
        "id", "key", "source", "size", "mark", "h", "block",
        F.row_number().over(inside).alias("row"),
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("within"),
    )
    recipe = materialize(targets(sized, weights, ratio, passes), "targets")
    each = recipe.select(F.col("source").alias("s3"), "source_size", "weight", "target")
    timed = placed.join(starts, placed["source"].eqNullSafe(starts["s2"]) & (placed["block"] == starts["b2"])).join(
        each, placed["source"].eqNullSafe(each["s3"])
    )
    entries = timed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select(
        "id", "key", "source", "block", "row", "size", "mark", "source_size", "target", "turn",
        ((F.col("turn") * F.col("source_size") + F.col("start") + F.col("within")) / F.col("weight")).alias("finish"),
    )
    total_order = ["finish", "source", "turn", "block", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        entries.repartitionByRange(parts, *total_order).withColumn("part", F.spark_partition_id()), "queue"
    )
    of_part = ranged.groupBy("part").agg(F.sum("size").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*total_order).rowsBetween(Window.unboundedPreceding, 0))
    # The budget is one number, read from the table of sources.
    head = recipe.agg(F.max("budget").alias("b")).first()
    served = ranged.withColumn("run", running).join(offsets, "part").withColumn(
        "in", F.col("run") + F.col("offset") <= F.lit(float(head["b"] or 0.0))
    )
    return served.groupBy("source", "block", "row", "id", "key", "size", "mark", "source_size", "target").agg(
        F.count_if("in").alias("copies")
    ).drop("block", "row")


def text_key(text: Column) -> Column:
    """A number that stands for a text; NULL and empty ones are told apart."""
    return F.xxhash64(text, text.isNull())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    Id and text decide the order, so other columns do not change a mix.  Rows are
    told apart by all their columns but maps, which have no hash.
    """
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.xxhash64(*told).alias("mark"))
    rows = keyed.select(
        F.col(f"d.`{id_col}`").alias("id"), text_key(F.col(f"d.`{text_col}`")).alias("key"), "mark", F.col(f"d.`{source_col}`").alias("source"),
        word_count(F.col(f"d.`{text_col}`")).alias("size"),
    )
    copies = plan(rows, **options).groupBy("mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # Rows that are alike in every column share what was taken of them.
    nth = F.row_number().over(Window.partitionBy("mark").orderBy("mark"))
    met = keyed.join(copies.where("copies > 0"), "mark").withColumn("nth", nth)
    times = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return met.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int")))).where("copy > 0").select("d.*")


# --- the query; the order of the shuffle is a hash that SQL elsewhere lacks, so there is no twin ------------------------


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("id"), text_key(docs["text"]).alias("key"), "source", word_count(docs["text"]).alias("size"))
    mixed = plan(rows)
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
