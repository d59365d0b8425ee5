"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters.  The
distinct blocks are dealt out by hash, sorted within their partition, and named
by an integer, partition first.  Then adjacent names are paired, pairs are named
in the same way, and so on until each document has one name.  Two documents get
the same name exactly when they are equal: names stand for values, not hashes.

Blocks meet their names through 128-bit keys.  That the keys are different for
all distinct blocks is checked on the table of names; if they are not, they are
made anew with another start.  So whole blocks are shuffled once, combined on
the map side, and a block that a third of all rows hold is one row per task.

Defined results: NULL counts as empty; all empty texts are equal.  A NULL id is
larger than any other.  Rows alike in id, length and normalised text are one
document with several rows: each counts in ``group_size`` and one of them is kept.
Texts of any length are named whole, block by block.  Other columns stay as they
are in :func:`dedup`, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import filled, materialize, no_space

BLOCK_CHARS = 2048


def _keys(start: int, *values: str) -> list[Column]:
    return [F.xxhash64(F.lit(start), *values).alias("h1"), F.xxhash64(F.lit(-1 - start), *values).alias("h2")]


def _named(distinct: DataFrame, values: list[str], label: str) -> tuple[DataFrame, int]:
    """Table ``h1, h2, name`` of the distinct values, and the start of its keys."""
    ordered = distinct.sortWithinPartitions(*values).withColumn("name", F.monotonically_increasing_id())
    first = 0
    names = materialize(ordered.select(*_keys(first, *values), "name", *values[1:]), label)
    while names.groupBy("h1", "h2").count().where("count > 1").limit(1).count():
        first += 1
        names = materialize(ordered.select(*_keys(first, *values), "name"), label)
    return names.select("h1", "h2", "name"), first


def identities(rows: DataFrame, value: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key`` and ``(level, name)`` of every row of ``key, <value>``; the key stands for the value."""
    blocks = rows.select("key", F.posexplode(_blocks(F.col(value), block_chars)).alias("pos", "block"))
    names, start = _named(blocks.select("block").groupBy("block").agg(F.lit(1).alias("_")).drop("_"), ["block"], "blocks")
    level = 0
    chain = materialize(
        blocks.select("key", "pos", *_keys(start, "block")).join(names, ["h1", "h2"]).select("key", "pos", "name"), "names-0"
    )
    done = None
    while True:
        ends = chain.groupBy("key").agg(F.max("pos").alias("last"))
        whole = chain.join(ends.where("last = 0").select("key"), "key", "left_semi").select("key", F.lit(level).alias("level"), "name")
        done = whole if done is None else done.union(whole)
        pairs = (
            chain.join(ends.where("last > 0").select("key"), "key", "left_semi")
            .groupBy("key", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = materialize(pairs, f"pairs-{level}")
        if pairs.isEmpty():
            return done.distinct()
        level += 1
        names, start = _named(pairs.select("a", "b").distinct(), ["a", "b"], f"pair-names-{level}")
        chain = materialize(
            pairs.select("key", "pos", *_keys(start, "a", "b")).join(names, ["h1", "h2"]).select("key", "pos", "name"),
            f"names-{level}",
        )


def _blocks(text: Column, size: int) -> Column:
    """Blocks of ``size`` code points; an empty text is one empty block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Of equal texts the row with the most code points before normalising stays, of
    those the smallest id.
    """
    text = filled(docs[text_col])
    norm = docs.select(docs[id_col].alias("id"), F.length(text).alias("n"), no_space(text).alias("norm"))
    keyed = norm.select(F.struct("id", "n", F.unhex(F.sha2("norm", 256)).alias("sha")).alias("key"), "norm")
    names = identities(keyed, "norm", block_chars)
    rows = keyed.groupBy("key").agg(F.count("*").alias("rows"))
    known = materialize(rows.join(names, "key"), "identities")
    best = F.min(F.struct((-F.col("key.n")).alias("n"), F.col("key.id").isNull().alias("no_id"), F.col("key.id").alias("id")))
    groups = known.groupBy("level", "name").agg(best.alias("best"), F.sum("rows").alias("group_size"))
    # Written first: a join of two plain tables can split a group that a third of all rows belong to.
    met = known.join(materialize(groups, "groups"), ["level", "name"])
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    first = (F.col("copy") == 1) & F.col("key.id").eqNullSafe(F.col("best.id")) & (F.col("key.n") == -F.col("best.n"))
    return copies.select(
        F.col("key.id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        "group_size",
        first.alias("kept"),
        F.lower(F.hex("key.sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows one."""
    text = filled(docs[text_col])
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
        docs[id_col].alias("id"), F.length(text).alias("n"), F.sha2(no_space(text), 256).alias("sha"),
    )
    marks = mark_duplicates(docs, id_col, text_col, block_chars).where("kept").select("doc_id", "text_sha256")
    met = keyed.join(marks, keyed["id"].eqNullSafe(marks["doc_id"]) & (keyed["sha"] == marks["text_sha256"]))
    nth = F.row_number().over(Window.partitionBy("id", "sha").orderBy(F.desc("n")))
    return met.withColumn("nth", nth).where("nth = 1").select("d.*")


# --- the query and its twin -------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    return mark_duplicates(docs.select("doc_id", "text"))


SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""
