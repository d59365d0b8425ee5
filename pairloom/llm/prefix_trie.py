"""Prefix trie of conversations over range-partitioned shards.

A conversation is the path of its turns; a turn stands in it as sixteen bytes of
a SHA-256 of role and text.  Conversations are sorted by path and id and cut
into shards by splitters, which are conversations of a sample.  The members of a
node lie next to each other in that order, so a node whose members are in more
than one shard is a prefix of a splitter.  The trie of the splitters, the
skeleton, is broadcast: a shard walks its sorted rows with one stack, finishes
every node outside of the skeleton, and returns partial aggregates for the
skeleton nodes it has seen.  Those are reduced by node and added up from the
leaves of the skeleton to its root.

Sizes: the sample has about ``OVERSAMPLE`` rows a shard, a splitter at most
``SPLITTER_TURNS`` turns, the skeleton at most ``SKELETON_TURNS`` turns; with
more, every other splitter is left out and shards get larger, which changes no
result.  Any set of splitters is right, so a group of copies of any size is cut
by id.  A shard holds the open subtree below a skeleton node.  A conversation is
one row of about thirty bytes a turn, whatever the length of its texts.  The ids
that end at a skeleton node are hashed in a stream of chunks, in constant memory.

Defined results: rows without an id belong to no conversation; NULL role and text
count as empty; turns are ordered by number, NULL first, then role, then
hash; repeated rows are turns of their own.  An empty table has no nodes, not
even a root.  Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pairloom.llm.common import filled, materialize

KEY_BYTES = 16
OVERSAMPLE = 20
TURNS_PER_SHARD = 1 << 19
SPLITTER_TURNS = 1 << 12
SKELETON_TURNS = 1 << 18
CHUNK_IDS = 1 << 11
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
# What a shard returns: finished nodes, parts of skeleton nodes, and ids that end at a skeleton node.
NODE, PART, ENDS = 0, 1, 2


# --- paths ------------------------------------------------------------------------------------------------------------


def turn_lists(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_id, turns``: the keys and lengths of each conversation's turns, in order."""
    role, text = filled(turns["role"]), filled(turns["text"])
    key = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * KEY_BYTES)
    named = turns.where(turns[conv_col].isNotNull()).select(
        turns[conv_col].alias("conv_id"), F.struct(turns["turn"], role.alias("role"), key.alias("key"), F.length(text).alias("len")).alias("t")
    )
    listed = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t["key"].alias("key"), t["len"].alias("len"))).alias("turns"))


def with_paths(convs: DataFrame) -> DataFrame:
    """``conv_id, path, lens`` of rows ``conv_id, turns``."""
    keys = F.transform("turns", lambda t: t["key"])
    return convs.select("conv_id", F.unhex(F.array_join(keys, "")).alias("path"), F.transform("turns", lambda t: t["len"]).alias("lens"))


def rebuild(turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Conversations whose first turns are those of the first one of their family.

    The first *h* turns come from conversation ``c - c % family``, the rest from the
    conversation itself after its first *h*; *h* is ``crc32(c) % heads``.
    """
    own = materialize(turn_lists(turns), "conversations")
    firsts = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("head"))
    met = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(firsts, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return with_paths(met.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns")))


# --- splitters and their trie -----------------------------------------------------------------------------------------


class Skeleton:
    """The trie of sorted splitters, its nodes numbered in preorder from the root, 0."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        while sum(len(p) for p, _ in splitters) > SKELETON_TURNS * KEY_BYTES:
            splitters = splitters[1::2]
        self.splitters = splitters
        self.parent, self.depth = [-1], [0]
        self.child: dict[tuple[int, bytes], int] = {}
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), KEY_BYTES):
                step = node, path[at : at + KEY_BYTES]
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


def choose_splitters(paths: DataFrame, shards: int, rows: int) -> list[tuple[bytes, int]]:
    """Up to ``shards - 1`` conversations that cut the sorted ones in about equal shares."""
    if shards < 2:
        return []
    share = min(1.0, OVERSAMPLE * shards / max(rows, 1))
    drawn = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))
    sample = paths.where(drawn & (F.octet_length("path") <= SPLITTER_TURNS * KEY_BYTES)).select("path", "conv_id")
    order = Window.orderBy("path", "conv_id")  # of the sample alone
    step = max(1, round(share * rows / shards))
    ranked = sample.withColumn("r", F.row_number().over(order)).where(F.col("r") % step == 0)
    return sorted((bytes(r["path"]), r["conv_id"]) for r in ranked.select("path", "conv_id").collect())[: 2 * shards]


# --- one shard --------------------------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths share."""
    n = min(len(a), len(b)) // KEY_BYTES
    if a[: n * KEY_BYTES] == b[: n * KEY_BYTES]:
        return n
    low, high = 0, n  # the first ``low`` are equal, the first ``high`` are not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * KEY_BYTES : mid * KEY_BYTES] == b[low * KEY_BYTES : mid * KEY_BYTES]:
            low = mid
        else:
            high = mid
    return low


class Open:
    """A node on the stack."""

    __slots__ = ("children", "ends", "leaves", "len", "least", "n", "saved", "skeleton", "slot")

    def __init__(self, skeleton: int, slot: int, length: int):
        self.skeleton, self.slot, self.len = skeleton, slot, length
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.ends = None

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None or least < self.least else self.least


class Shard:
    """Walks the sorted rows of a shard and collects what it returns."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.out: list[tuple] = []
        self.stack: list[Open] = []
        self.subtree: list[list] = []  # nodes below the open top node outside of the skeleton, in preorder
        self.path = b""

    def row(self, path: bytes, conv: int, lens: np.ndarray) -> None:
        if not self.stack:
            self.stack.append(Open(0, -1, 0))
        same = _common(self.path, path)
        while len(self.stack) > same + 1:
            self.close()
        for depth in range(same + 1, len(path) // KEY_BYTES + 1):
            above = self.stack[-1]
            known = -1
            if above.skeleton >= 0:
                known = self.skeleton.child.get((above.skeleton, path[(depth - 1) * KEY_BYTES : depth * KEY_BYTES]), -1)
            slot = -1
            if known < 0:
                slot = len(self.subtree)
                self.subtree.append([NODE, above.skeleton if above.skeleton >= 0 else None, None, depth, above.slot])
            self.stack.append(Open(known, slot, int(lens[depth - 1])))
        self.path = path
        self.end(self.stack[-1], conv)

    def end(self, node: Open, conv: int) -> None:
        """A conversation ends here; those of one node come in ascending order."""
        node.add(1, conv)
        if node.skeleton < 0:
            if node.ends is None:
                node.ends = hashlib.sha256(str(conv).encode())
            else:
                node.ends.update(f",{conv}".encode())
        else:
            node.ends = node.ends or []
            node.ends.append(conv)
            if len(node.ends) == CHUNK_IDS:
                self.send(node)

    def send(self, node: Open) -> None:
        if node.ends:
            self.out.append((ENDS, node.skeleton, node.ends[0], None, None, None, None, None, None, ",".join(map(str, node.ends)), None))
        node.ends = None

    def close(self) -> None:
        node = self.stack.pop()
        if node.skeleton >= 0:
            self.send(node)
            # Also where nothing but skeleton nodes lies below: the length of its turn is known here alone.
            self.out.append((PART, node.skeleton, node.least, None, None, node.n, node.children, node.leaves, node.saved, None, node.len))
            return
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.len
        above = self.stack[-1]
        above.add(node.n, node.least)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        done = self.subtree[node.slot]
        done[2] = node.least
        done += [node.n, node.children, node.leaves, node.saved, node.ends.hexdigest() if node.ends else NO_ENDS, None]
        if above.skeleton >= 0:  # now the least ids of all parents are known
            for d in self.subtree:
                d[4] = self.subtree[d[4]][2] if d[4] >= 0 else None
            self.out += map(tuple, self.subtree)
            self.subtree = []

    def finish(self) -> None:
        while self.stack:
            self.close()


SHARD_SCHEMA = StructType([
    StructField("kind", IntegerType()), StructField("node", IntegerType()), StructField("conv_id", LongType()),
    StructField("depth", LongType()), StructField("parent_conv_id", LongType()),
    *[StructField(c, LongType()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    StructField("ends", StringType()), StructField("len", LongType()),
])
SHARD_TYPES = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64()]


def _walk(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(shared.value)

        def sent(least: int) -> Iterator[pa.RecordBatch]:
            while len(shard.out) > least:
                some, shard.out = shard.out[:8192], shard.out[8192:]
                columns = [pa.array(c, t) for c, t in zip(zip(*some), SHARD_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, names=SHARD_SCHEMA.names)

        for batch in batches:
            ids, lens = batch.column("conv_id").to_pylist(), batch.column("lens")
            offsets, values = lens.offsets.to_numpy(), lens.values.to_numpy()
            for i, path in enumerate(batch.column("path")):
                shard.row(path.as_py(), ids[i], values[offsets[i] : offsets[i + 1]])
            yield from sent(8192)
        shard.finish()
        yield from sent(0)

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the ids of each node; chunks come by node, in order of their ids."""
    node, state, done = None, None, []
    for batch in batches:
        for at, chunk in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if at != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
    if state:
        done.append((node, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string())], names=["node", "sha"])


# --- the trie ---------------------------------------------------------------------------------------------------------


def _added_up(skeleton: Skeleton, parts: dict[int, tuple], ends: dict[int, str]) -> list[tuple]:
    """Rows ``node, *COLUMNS`` of the skeleton: what lies below each node, from the last in preorder to the root."""
    size = len(skeleton.parent)
    n, least, children, leaves, saved, length = ([0] * size for _ in range(6))
    least = [None] * size
    for node, (part_n, part_least, part_children, part_leaves, part_saved, part_len) in parts.items():
        n[node], least[node], children[node] = part_n, part_least, part_children
        leaves[node], saved[node], length[node] = part_leaves, part_saved, part_len
    for node in range(size - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        saved[node] += (n[node] - 1) * length[node]
        if (above := skeleton.parent[node]) >= 0:
            n[above] += n[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
            children[above] += 1
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    return [
        (i, least[i], skeleton.depth[i], least[skeleton.parent[i]] if i else None, n[i], children[i], leaves[i], saved[i], ends.get(i, NO_ENDS))
        for i in range(size) if n[i]
    ]


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``conv_id, path, lens``, see ``COLUMNS``.  Ids are distinct."""
    spark = paths.sparkSession
    paths = materialize(paths, "paths")
    rows, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("lens")), F.lit(0))).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / TURNS_PER_SHARD))
    skeleton = Skeleton(choose_splitters(paths, shards, rows))
    shared = spark.sparkContext.broadcast(skeleton)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = map(shared.value.shard, batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.int32())], names=[*batch.schema.names, "shard"])

    routed = paths.mapInArrow(route, StructType([*paths.schema.fields, StructField("shard", IntegerType())]))
    sorted_rows = routed.repartitionById(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("path", "conv_id")
    walked = materialize(sorted_rows.mapInArrow(_walk(shared), SHARD_SCHEMA), "shards")

    # Both are bounded by the skeleton, whatever the number of conversations.
    reduced = walked.where(F.col("kind") == PART).groupBy("node").agg(
        F.sum("n_convs"), F.min("conv_id"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("len")
    )
    chunks = walked.where(F.col("kind") == ENDS).select("node", "conv_id", "ends")
    hashed = chunks.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_ends, "node int, sha string")
    upper = _added_up(skeleton, {r[0]: tuple(r)[1:] for r in reduced.collect()}, dict(map(tuple, hashed.collect())))
    kinds = [LongType(), LongType(), LongType(), LongType(), LongType(), LongType(), LongType(), StringType()]
    schema = StructType([StructField("node", IntegerType()), *[StructField(c, k) for c, k in zip(COLUMNS, kinds)]])
    top = spark.createDataFrame(upper, schema)
    known = F.broadcast(top.select("node", F.col("conv_id").alias("skeleton_conv")))
    lower = walked.where(F.col("kind") == NODE).join(known, "node", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "skeleton_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"),
    )
    return lower.unionByName(top.select(*COLUMNS))


# --- the query and its twin -------------------------------------------------------------------------------------------


def digest(turns: DataFrame) -> DataFrame:
    return trie(rebuild(turns.select("conv_id", "turn", "role", "text")))


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, length(x) AS len, key,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS rn
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x,
        left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS key
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t),
crc AS (SELECT conv_id, s, 0 AS i, 4294967295::BIGINT AS acc FROM c
    UNION ALL SELECT conv_id, s, i + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT)
    FROM (SELECT *, xor(acc, CASE WHEN i % 8 = 0 THEN ascii(substr(s, i // 8 + 1, 1)) ELSE 0 END::BIGINT) AS y FROM crc WHERE i < 8 * length(s))),
b AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(acc, 4294967295::BIGINT) % 6 AS h FROM crc WHERE i = 8 * length(s)),
r AS (SELECT b.conv_id, 0 AS part, rn, key, len FROM b JOIN t ON t.conv_id = b.base AND rn <= h
    UNION ALL SELECT b.conv_id, 1, rn, key, len FROM b JOIN t ON t.conv_id = b.conv_id AND rn > h),
p AS (SELECT conv_id, list(key) OVER (PARTITION BY conv_id ORDER BY part, rn) AS path, len FROM r
    UNION ALL SELECT conv_id, []::VARCHAR[], 0 FROM b),
n AS (SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS len FROM p GROUP BY path),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, path FROM p QUALIFY len(path) = max(len(path)) OVER (PARTITION BY conv_id)) GROUP BY path),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT path, n_convs, len, coalesce(n_children, 0) AS n_children, unnest(range(depth + 1)) AS up FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[1:up] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * len) AS saved_tokens FROM u GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN n q ON n.depth > 0 AND q.path = n.path[1:n.depth - 1]"""
