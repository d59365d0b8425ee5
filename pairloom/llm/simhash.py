"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: one bit per position, set if more than half of the hashes of a
text's word shingles have it.  Equal fingerprints are one node from then on.

Search: the distinct codes are range-partitioned and sorted by Gray rank, in which
neighbours share long bit patterns.  Every ``max_node`` codes in a row form a
leaf, every ``FANOUT`` nodes in a row a node above; a node is the mask of the bits
that all its codes share, and those bits.  The tree is then compared with itself
from the root down, a join per level: where two nodes meet, the differences on the
bits that both have newly settled are added to those counted above, and once
there are more than ``d`` the whole pair of groups is left out.  What is left are
pairs of leaves.  A leaf shares about as many bits as there are doublings of
leaves, so it keeps in the order of ``log(leaves) ** d`` partners, whatever the
number of codes, and never more than there are patterns within ``d`` bits.  A task
compares two leaves at a time, and gives back a spanning set of their links.

Components: alternating large-star and small-star rounds on the links, each
written to the shared folder, until every node points at the smallest one.

Defined results: NULL and empty texts have no words and fingerprint zero, linked
like any other.  Rows whose id is NULL link but never name a component, which is
NULL if it has no other.  Rows that repeat an id are fingerprinted one by one.
Texts of any length are read whole, some thousand shingles at a time.  Other
columns stay as they are, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairloom.llm.common import filled, materialize

SEED = 42
BITS = 64
MAX_NODE = 256
FANOUT = 8
CHUNK = 1 << 16


# --- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text in UTF-8, a bounded number of shingles at a time."""
    words = text.lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    spans = zip(starts, ends[shingle - 1 :] if len(words) >= shingle else ends[-1:])
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    while hashes := [digest(line[a:b], SEED) for a, b in islice(spans, CHUNK)]:
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, *keys: Column, shingle: int = 3) -> DataFrame:
    """The key columns and ``fp``, the fingerprint as a signed BIGINT."""
    rows = docs.select(*keys, filled(docs[text_col]).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            codes = [fingerprint(t.as_py(), shingle) for t in texts]
            fp = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], "fp"])

    fields = [f for f in rows.schema.fields if f.name != "_text"]
    return rows.mapInArrow(run, StructType([*fields, StructField("fp", LongType())]))


# --- the tree ---------------------------------------------------------------------------------------------------------


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected binary order, as 64 bits."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


LEAF_SCHEMA = "node long, ones long, zeros long, codes binary"


def leaves_of(codes: DataFrame, max_node: int = MAX_NODE) -> DataFrame:
    """Leaves in Gray order: ``node`` (partition and place in it), the AND and OR of its codes, and the codes."""
    spark = codes.sparkSession
    # Signed order of the rank with its first bit turned is unsigned order of the rank.
    ranked = codes.select("fp", gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranked.repartitionByRange(parts, "rank").sortWithinPartitions("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, part = np.empty(0, np.int64), 0, None
        for batch in batches:
            part = batch.column(1)[0].as_py() if part is None and batch.num_rows else part
            held = np.concatenate((held, batch.column(0).to_numpy(zero_copy_only=False)))
            whole = len(held) // max_node * max_node
            yield leaves(held[:whole], part, place)
            held, place = held[whole:], place + whole // max_node
        if len(held):
            yield leaves(held, part, place)

    def leaves(fp: np.ndarray, part: int, place: int) -> pa.RecordBatch:
        at = np.arange(0, len(fp), max_node)
        ones, zeros = (np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)) if len(fp) else (fp, fp)
        node = ((part or 0) << 32) + place + np.arange(len(at))
        blobs = pa.array([fp[i : i + max_node].tobytes() for i in at], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(ones), pa.array(zeros), blobs], names=["node", "ones", "zeros", "codes"])

    return materialize(dealt.select("fp", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, LEAF_SCHEMA), "leaves")


def tree_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables ``node, above, mask, bits`` from the leaves to the root, which is node 0.

    Within a partition every ``fanout`` nodes have one above them; once there is one
    node to a partition, every ``fanout`` partitions have.
    """
    size = leaves.agg(F.max(F.col("node").bitwiseAND((1 << 32) - 1)), F.max(F.shiftright("node", 32))).first()
    place, part = (size[0] or 0), (size[1] or 0)
    level, out = leaves.select("node", "ones", "zeros"), []
    while True:
        if place:
            above = (F.shiftright("node", 32) * (1 << 32) + F.floor(F.col("node").bitwiseAND((1 << 32) - 1) / fanout)).cast("long")
        else:
            above = (F.floor(F.shiftright("node", 32) / fanout) * (1 << 32)).cast("long")
        mask = F.bitwise_not(F.col("ones").bitwiseXOR(F.col("zeros")))
        out.append(level.select("node", above.alias("above"), mask.alias("mask"), F.col("ones").alias("bits")))
        if not place and not part:
            return out
        level = level.groupBy(above.alias("node")).agg(F.bit_and("ones").alias("ones"), F.bit_or("zeros").alias("zeros"))
        place, part = (place // fanout, part) if place else (0, part // fanout)


def near_leaves(levels: list[DataFrame], distance: int, report: list[dict] | None = None) -> DataFrame:
    """Pairs ``x, y`` of leaves, ``x`` not behind ``y``, that may hold near codes.

    With ``report`` the nodes of each level, and the pairs met and left out there, are counted into it.
    """
    top = levels[-1]
    pairs = top.select(F.col("node").alias("x"), F.col("node").alias("y"), F.col("mask").alias("seen"), F.lit(0).alias("spent"))
    for level in reversed(levels[:-1]):
        one = level.select(F.col("node").alias("x"), F.col("above").alias("_ax"), F.col("mask").alias("_mx"), F.col("bits").alias("_bx"))
        two = level.select(F.col("node").alias("y"), F.col("above").alias("_ay"), F.col("mask").alias("_my"), F.col("bits").alias("_by"))
        above = pairs.select(F.col("x").alias("_px"), F.col("y").alias("_py"), "seen", "spent")
        met = above.join(one, F.col("_px") == F.col("_ax")).join(two, (F.col("_py") == F.col("_ay")) & (F.col("x") <= F.col("y")))
        both = F.col("_mx").bitwiseAND(F.col("_my"))
        new = F.bit_count(F.col("_bx").bitwiseXOR(F.col("_by")).bitwiseAND(both).bitwiseAND(F.bitwise_not("seen")))
        counted = met.select("x", "y", both.alias("seen"), (F.col("spent") + new).alias("spent"))
        pairs = counted.where(F.col("spent") <= distance)
        if report is not None:
            pairs = materialize(pairs, "node-pairs")
            report.append({"nodes": level.count(), "met": counted.count(), "kept": pairs.count()})
    return pairs.select("x", "y")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the smallest place it is linked with, over any number of links ``a, b``."""
    root = np.arange(n)
    while (differ := a != b).any():
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
    return root


def leaf_links(one: np.ndarray, two: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between codes of two leaves, or within one, that are near; enough to span all of them."""
    differ = (one[:, None] ^ two[None, :]).view(np.uint64)  # of signed numbers the count is that of the absolute value
    a, b = np.nonzero(np.bitwise_count(differ) <= distance)
    if len(a) <= len(one) + len(two):
        return one[a], two[b]
    codes = np.concatenate((one, two))
    root = spanning(a, b + len(one), len(codes))
    other = np.flatnonzero(root != np.arange(len(codes)))
    return codes[other], codes[root[other]]


def near_links(codes: DataFrame, distance: int, max_node: int = MAX_NODE, report: list[dict] | None = None) -> DataFrame:
    """Links ``a, b`` between the distinct ``fp`` of a table, enough to span all that are near."""
    leaves = leaves_of(codes, max_node)
    pairs = materialize(near_leaves(tree_levels(leaves), distance, report), "leaf-pairs")
    held = leaves.select("node", "codes")
    met = pairs.join(held.withColumnsRenamed({"node": "x", "codes": "one"}), "x").join(held.withColumnsRenamed({"node": "y", "codes": "two"}), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                leaf_links(*(np.frombuffer(c.as_buffer(), np.int64) for c in row), distance) for row in zip(batch.column(0), batch.column(1))
            ]
            left, right = (np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in (0, 1))
            differ = left != right
            yield pa.RecordBatch.from_arrays([pa.array(left[differ]), pa.array(right[differ])], names=["a", "b"])

    return met.select("one", "two").mapInArrow(run, "a long, b long")


def star_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node but the roots; the root is the smallest node."""

    def larger_first(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges, mark, turn = materialize(larger_first(links), "links"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark, turn = now, turn + 1
        both = edges.union(edges.select("b", "a"))
        # Written first: a join of two plain tables can split the hub of a giant component.
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"low-{turn}")
        large_star = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(larger_first(large_star), f"large-star-{turn}")
        low = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), f"low-{turn}")
        small_star = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = materialize(larger_first(small_star), f"small-star-{turn}")


def components(rows: DataFrame, distance: int = 2, max_node: int = MAX_NODE) -> DataFrame:
    """Rows ``id, fp, ...`` with ``component_id``, the smallest id reachable."""
    codes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "codes")
    roots = star_components(near_links(codes.select("fp"), distance, max_node))
    rooted = codes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(named, "root").drop("root"), "fp")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2
) -> DataFrame:
    """One document of each component: the smallest id, of repeated ids one row; NULL ids last."""
    text = filled(docs[text_col])
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), docs[id_col].alias("id"), F.xxhash64(text).alias("k"))
    rows = fingerprints(docs, text_col, docs[id_col].alias("id"), F.xxhash64(text).alias("k"), shingle=shingle)
    rows = materialize(rows, "fingerprints")
    codes = rows.groupBy("fp").agg(
        F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first")
    )
    codes = materialize(codes, "codes")
    roots = star_components(near_links(codes.select("fp"), distance)).select(F.col("node").alias("fp"), "root")
    rooted = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stay = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id2"), F.col("first.k").alias("k2")), "stay")
    met = keyed.join(stay, keyed["id"].eqNullSafe(stay["id2"]) & (keyed["k"] == stay["k2"]))
    nth = F.row_number().over(Window.partitionBy("id", "k").orderBy("k"))
    return met.withColumn("nth", nth).where("nth = 1").select("d.*")


# --- the query --------------------------------------------------------------------------------------------------------


def digest(docs: DataFrame) -> DataFrame:
    rows = materialize(fingerprints(docs, "text", docs["doc_id"].alias("id")), "fingerprints")
    return components(rows).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
