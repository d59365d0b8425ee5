"""Rounds of weighted neighbour sums over an adjacency in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.vectors import as_double
from pairloom.session import materialize

# Bytes of vectors one block should hold and receive in a round; rows and frames around them take many times that.
BLOCK_BYTES = 4 << 20
# Products of edges and dimensions held at a time.
CELLS = 1 << 22

# What a row of the adjacency asks its block to do, and what a row between blocks is.
ADD_HERE, SEND_SUM, SEND_VECTOR = 0, 1, 2
OWN, VECTOR, SUM = 0, 1, 2


def block_of(ident: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int")


def blocks_needed(vectors: int, width: int) -> int:
    """Blocks among which so many vectors, held or received, are dealt."""
    return math.ceil(vectors * 8 * max(1, width) / BLOCK_BYTES)


def adjacency(edges: DataFrame, blocks: int, weight: str = "w") -> DataFrame:
    """Edges ``src, dst`` dealt out to blocks of nodes: ``block, task, src, dst, w, to``.

    An edge lies either in the block of ``dst``, which then receives the vector of
    ``src`` once for all edges to it there, or in the block of ``src``, which then
    sends one sum for all its edges to ``dst``.  Whichever serves more edges is
    taken, so a hub on either end costs one vector per block instead of one per
    edge, and its edges are spread over all blocks.  Counted per node and block:
    such a window holds no more edges than a block has nodes.
    """
    placed = edges.select("src", "dst", F.col(weight).cast("double").alias("w")).where("src IS NOT NULL AND dst IS NOT NULL")
    placed = placed.withColumns({"_from": block_of(F.col("src"), blocks), "_to": block_of(F.col("dst"), blocks)})
    served = placed.withColumns({
        "_by_sum": F.count(F.lit(1)).over(Window.partitionBy("dst", "_from")),
        "_by_vector": F.count(F.lit(1)).over(Window.partitionBy("src", "_to")),
    }).withColumn("_push", F.col("_by_sum") >= F.col("_by_vector"))
    served = materialize(served, "placed-edges")
    kept = served.select(
        F.when(F.col("_push"), F.col("_from")).otherwise(F.col("_to")).alias("block"),
        F.when(F.col("_push"), F.lit(SEND_SUM)).otherwise(F.lit(ADD_HERE)).alias("task"),
        "src", "dst", "w", F.col("_to").alias("to"),
    )
    routes = served.where(~F.col("_push")).select("_from", "src", "_to").distinct()
    asked = routes.select(
        F.col("_from").alias("block"), F.lit(SEND_VECTOR).alias("task"), "src", F.col("src").alias("dst"),
        F.lit(1.0).alias("w"), F.col("_to").alias("to"),
    )
    return materialize(kept.unionByName(asked), "adjacency")


def rounds_of_sums(edges: DataFrame, emb: DataFrame, rounds: int, weight: str = "w", ident: str = "id",
                   vec: str = "emb", blocks: int | None = None) -> DataFrame:
    """``rounds`` times the weighted sum of source vectors per destination; one shuffle of vectors a round.

    A block adds what it received to its new vectors and sends on at once what the
    next round needs.  The number of blocks grows with nodes, edges and width, so that a
    block holds about ``BLOCK_BYTES``; a hub may add one vector per block to
    that.  Every node with an incoming edge from a node that has a vector is in the
    result.  Edges with a NULL end and NULL vectors count as absent.
    """
    if rounds < 0:
        raise ValueError("rounds must not be negative")
    own = emb.select(F.col(ident).alias("id"), as_double(F.col(vec)).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    first = own.select(F.size("vec").alias("n")).first()
    if rounds == 0 or first is None:
        return own.toDF(ident, vec)
    if blocks is None:
        blocks = max(blocks_needed(own.count() + edges.count(), first["n"]), emb.sparkSession.sparkContext.defaultParallelism)
    held = adjacency(edges, blocks, weight)
    kind = own.schema["id"].dataType.simpleString()
    schema = f"block int, kind int, id {kind}, vec array<double>"
    moving = own.select(block_of(F.col("id"), blocks).alias("block"), F.lit(OWN).alias("kind"), "id", "vec")
    for at in range(rounds + 1):
        step = _step(at > 0, at < rounds)
        moving = moving.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(step, schema)
    return moving.select(F.col("id").alias(ident), F.col("vec").alias(vec))


def _step(add: bool, send: bool):
    def run(moved: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if moved.empty:
            return _rows([])
        ids, matrix = (_added(moved, held[held["task"] == ADD_HERE]) if add else _matrix(moved))
        block = int(moved["block"].iloc[0])
        if not send:
            return _rows([(np.full(len(ids), block), OWN, ids, matrix)])
        out = []
        sums = held[held["task"] == SEND_SUM]
        to_of = sums.drop_duplicates("dst").set_index("dst")["to"]
        got, totals = _sums(sums, ids, matrix)
        if len(got):
            out.append((to_of.loc[got].to_numpy(), SUM, got, totals))
        routes = held[held["task"] == SEND_VECTOR]
        at = pd.Index(ids).get_indexer(routes["src"])
        out.append((routes["to"].to_numpy()[at >= 0], VECTOR, routes["src"].to_numpy()[at >= 0], matrix[at[at >= 0]]))
        return _rows(out)

    return run


def _rows(parts: list) -> pd.DataFrame:
    frames = [pd.DataFrame({"block": b, "kind": k, "id": i, "vec": list(v)}) for b, k, i, v in parts if len(i)]
    return pd.concat(frames) if frames else pd.DataFrame(columns=["block", "kind", "id", "vec"], dtype=object)


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(), np.stack(rows["vec"].to_numpy()) if len(rows) else np.empty((0, 0))


def _added(moved: pd.DataFrame, held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """New vectors of a block: sums sent to it, and edges kept in it times the vectors sent to it."""
    ids, totals = _matrix(moved[moved["kind"] == SUM])
    more, extra = _sums(held, *_matrix(moved[moved["kind"] == VECTOR]))
    if not len(more):
        both, parts = ids, totals
    elif not len(ids):
        both, parts = more, extra
    else:
        both, parts = np.concatenate([ids, more]), np.concatenate([totals, extra])
    codes, unique = pd.factorize(both)
    return np.asarray(unique), _grouped(parts, codes, len(unique))


def _sums(edges: pd.DataFrame, ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per destination the sum of weighted source vectors; sources without a vector add nothing."""
    at = pd.Index(ids).get_indexer(edges["src"]) if len(ids) else np.full(len(edges), -1)
    edges, at = edges[at >= 0], at[at >= 0]
    codes, unique = pd.factorize(edges["dst"])
    width = matrix.shape[1]
    out, weights = np.zeros((len(unique), width)), edges["w"].to_numpy()
    step = max(1, CELLS // max(1, width))
    for first in range(0, len(at), step):
        part = slice(first, first + step)
        out += _grouped(matrix[at[part]] * weights[part, None], codes[part], len(unique))
    return np.asarray(unique), out


def _grouped(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1] if rows.ndim == 2 else 0))
    if len(rows):
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        out[codes[order][starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out
