"""Exact nearest neighbours of every vector, without a distance limit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import seeded_hash
from pairloom.session import materialize

# Vectors in a block, which is what two of meet in a task, and the most centres there are.
BLOCK_VECTORS = 512
MAX_CENTRES = 4096
# Vectors of a tile, two of which meet in a task, and the tiles of a table too small to fill that many.
TILE_BYTES = 16 << 20
TILES = 8


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, from differences so that near ones are exact."""
    out = np.empty((len(a), len(b)))
    for at in range(0, len(a), 64):
        out[at : at + 64] = np.sqrt(((a[at : at + 64, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(ids: np.ndarray, a: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``src, dst, distance`` of the ``k`` nearest of each row of ``a``, ties by id.

    Products of the vectors tell which may be near, up to their rounding; those are
    measured by differences.
    """
    held_i, held_id, held_d = np.zeros(0, np.int64), ids[:0], np.zeros(0)
    bound = np.full(len(a), np.inf)
    for b_ids, b in others:
        if len(np.unique(b_ids)) < len(b_ids):  # rows that come twice take the place of others
            first = list({(i, v.tobytes()): at for at, (i, v) in enumerate(zip(b_ids.tolist(), b))}.values())
            b_ids, b = b_ids[first], b[first]
        rough = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        margin = 1e-9 * (1.0 + max(np.abs(a).max(), np.abs(b).max()) ** 2 * a.shape[1])
        same = ids[:, None] == b_ids[None, :]
        rough[same] = np.inf
        limit = bound**2
        if rough.shape[1] > k:
            limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((rough <= limit[:, None] + 2 * margin) & ~same)
        if not len(i):
            continue
        i, to = np.concatenate([held_i, i]), np.concatenate([held_id, b_ids[j]])
        d = np.concatenate([held_d, np.sqrt(((a[i[len(held_i):]] - b[j]) ** 2).sum(axis=1))])
        order = np.lexsort((to, d, i))
        i, to, d = i[order], to[order], d[order]
        other = np.append(True, (i[1:] != i[:-1]) | (to[1:] != to[:-1]) | (d[1:] != d[:-1]))
        i, to, d = i[other], to[other], d[other]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        full = rank == k - 1
        bound[i[full]] = d[full]
        best = rank < k
        held_i, held_id, held_d = i[best], to[best], d[best]
    return ids[held_i], held_id, held_d


def knn_exact(vectors: DataFrame, ident: str = "id", vec: str = "emb", k: int = 5, seed: int = 42) -> DataFrame:
    """``src, dst, distance, rank``: the ``k`` nearest other vectors of each, ties by id.

    Vectors go to the nearest of about ``sqrt(n)`` centres, drawn by hash, and lie
    in blocks of at most ``BLOCK_VECTORS`` of one centre, sorted by their distance to
    it.  Round one compares each block with itself and the next one of its centre,
    which bounds the distance of every vector's ``k``-th neighbour.  A vector is as
    far from any member of a block as the triangle inequality says of its and their
    distances to that block's centre; round two compares two blocks only where that
    can be within the bound.  Blocks travel in tiles of ``TILE_BYTES``, once for each
    other tile with a block to compare.  No vector is left out of either round, so the result
    is exact.

    NULL ids or vectors are left out; ids are distinct and vectors of one width.
    Fewer than ``k`` other vectors give all of them.
    """
    rows = materialize(
        vectors.where(F.col(ident).isNotNull() & F.col(vec).isNotNull()).select(F.col(ident).alias("id"), F.col(vec).cast("array<double>").alias("v")), "knn-vectors"
    )
    n = rows.count()
    wanted = min(MAX_CENTRES, max(1, math.isqrt(n)))
    share = min(1.0, 2.0 * wanted / max(n, 1))
    drawn = rows.where(seeded_hash(seed, "id") <= f"{min(16**8 - 1, math.ceil(share * 16**8)):08x}" + "f" * 24)
    picked = drawn.orderBy(seeded_hash(seed, "id")).limit(wanted).select("v").collect()  # at most MAX_CENTRES vectors
    if not picked:
        picked = rows.limit(1).select("v").collect()
    schema = "src {0}, dst {0}, distance double, rank int".format(rows.schema["id"].dataType.simpleString())
    if not picked:
        return vectors.sparkSession.createDataFrame([], schema)
    centres = np.array([r["v"] for r in picked], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(1)), shared.value)
                nearest = d.argmin(axis=1)
                own = d[np.arange(len(d)), nearest]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(own)], names=["id", "v", "c", "r"])

    id_type = rows.schema["id"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(place, f"id {id_type}, v array<double>, c int, r double"), "knn-placed")
    # A centre that a third of all vectors are near is cut by distance among many tasks.
    ordered = placed.repartitionByRange(F.col("c"), F.col("r"), F.col("id")).sortWithinPartitions("c", "r", "id")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held = TaskContext.get().partitionId(), 0, []

        def closed() -> pa.RecordBatch:
            nonlocal at
            ids, vs, cs, rs = zip(*held)
            held.clear()
            at += 1
            matrix = np.array(vs, np.float64)
            columns = [[(part << 32) + at], [cs[0]], [min(rs)], [max(rs)], [list(ids)], [matrix.tobytes()], [np.array(rs).tobytes()]]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), None, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) if t else pa.array(c) for c, t in zip(columns, types)], names=["b", "c", "low", "high", "ids", "m", "rs"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (held[-1][2] != row[2] or len(held) == BLOCK_VECTORS):
                    yield closed()
                held.append(row)
        if held:
            yield closed()

    blocks = materialize(ordered.mapInArrow(block, f"b long, c int, low double, high double, ids array<{id_type}>, m binary, rs binary"), "knn-blocks")

    # Blocks in a row make a tile; two tiles meet in a task, so a vector travels once for each tile that needs its own.
    width = centres.shape[1]
    per_tile = max(1, min(TILE_BYTES // (8 * width), math.ceil(n / TILES)))
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block, without its vectors
    before = F.coalesce(F.sum("_n").over(ahead), F.lit(0))
    tiles = materialize(blocks.select("b", F.size("ids").alias("_n")).select("b", F.floor(before / per_tile).alias("t")), "knn-tiles")

    def nearest_of(pairs: DataFrame) -> DataFrame:
        """The ``k`` nearest of each vector of block ``x`` among those of the blocks ``y`` of a tile."""
        of_x, of_y = (tiles.select(F.col("b").alias(e), F.col("t").alias(f"t{e}")) for e in ("x", "y"))
        listed = materialize(pairs.join(of_x, "x").join(of_y, "y").groupBy("tx", "ty", "x").agg(F.collect_list("y").alias("ys")), "knn-pairs")
        met = listed.select("tx", "ty").distinct()
        held = blocks.join(tiles, "b").select("t", "b", "ids", "m")
        rows = [
            met.join(held.withColumnRenamed("t", f"t{e}"), f"t{e}").select("tx", "ty", F.lit(e).alias("side"), "b", "ids", "m", F.lit(None).cast("array<bigint>").alias("ys"))
            for e in ("x", "y")
        ]
        pair_list = listed.select("tx", "ty", F.lit("p").alias("side"), F.col("x").alias("b"), F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("binary").alias("m"), "ys")

        def compare(table: pa.Table) -> pa.Table:
            sides: dict[str, dict] = {"x": {}, "y": {}, "p": {}}
            for side, b, ids, m, ys in zip(*[table.column(c) for c in ("side", "b", "ids", "m", "ys")]):
                own = ys.as_py() if side.as_py() == "p" else (np.array(ids.as_py()), np.frombuffer(m.as_buffer()).reshape(-1, width))
                sides[side.as_py()][b.as_py()] = own
            found = [_nearest(*sides["x"][b], [sides["y"][o] for o in others], k) for b, others in sides["p"].items()]
            columns = [np.concatenate(c) for c in zip(*found)]
            return pa.table({name: pa.array(c) for name, c in zip(("src", "dst", "distance"), columns)})

        return rows[0].unionByName(rows[1]).unionByName(pair_list).groupBy("tx", "ty").applyInArrow(compare, f"src {id_type}, dst {id_type}, distance double")

    def top(found: DataFrame) -> DataFrame:
        """The ``k`` best of each vector; what tasks give is at most ``k`` to a vector and block."""
        best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "dst"))), 1, k)
        return found.distinct().groupBy("src").agg(best.alias("best"))

    # Round one: each block with itself and those beside it, which are numbered next to it.
    beside = blocks.select(F.col("b").alias("x"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("y"))
    first = materialize(top(nearest_of(beside)), "knn-first")
    bound = first.select("src", F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).otherwise(F.lit(math.inf)).alias("bound"))
    # A block's reach: over its vectors, the largest bound; and from where to where they lie around each centre.
    member = blocks.select("b", F.explode("ids").alias("src")).join(bound, "src", "left")
    reach = member.groupBy("b").agg(F.max(F.coalesce("bound", F.lit(math.inf))).alias("reach"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, m, reach in zip(*batch.columns):
                x = np.frombuffer(m.as_buffer()).reshape(-1, shared.value.shape[1])
                d = _distances(x, shared.value)
                columns = [np.full(d.shape[1], b.as_py(), np.int64), np.arange(d.shape[1], dtype=np.int32), d.min(axis=0) - reach.as_py(), d.max(axis=0) + reach.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "c", "least", "most"])

    around = blocks.join(reach, "b").select("b", "m", "reach").mapInArrow(spans, "x long, c int, least double, most double")
    other = blocks.select(F.col("b").alias("y"), "c", "low", "high")
    slack = 1e-9
    second = around.join(other, "c").where((F.col("high") >= F.col("least") - slack) & (F.col("low") <= F.col("most") + slack)).select("x", "y")
    rest = nearest_of(second.where(F.abs(F.col("x") - F.col("y")) > 1))
    both = first.select("src", F.explode("best").alias("o")).select("src", "o.dst", "o.distance").unionByName(rest.select("src", "dst", "distance"))
    return top(both).select("src", F.posexplode("best").alias("p", "o")).select(
        "src", F.col("o.dst").alias("dst"), F.col("o.distance").alias("distance"), (F.col("p") + 1).alias("rank")
    )
