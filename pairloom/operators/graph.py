"""Similarity graphs over entity vectors, and sums over neighbours.

Vectors stay arrays through every join.  Element-wise sums use the vector
aggregate of Spark ML, which combines on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pairloom.functions.vectors import as_double
from pairloom.operators import cells
from pairloom.operators.blocked import rounds_of_sums
from pairloom.operators.sampling import bottom_k_per_key
from pairloom.session import materialize

# Vectors compared in one task are bounded by two chunks of so many bytes, and
# distances held at a time by so many cells.
CHUNK_BYTES = 32 << 20
CELLS = 1 << 22


def vector_sum(v: Column) -> Column:
    """Element-wise sum of array vectors."""
    return vector_to_array(Summarizer.sum(array_to_vector(as_double(v))))


def vector_mean(v: Column, weight: Column | None = None) -> Column:
    """Element-wise (weighted) mean of array vectors."""
    vector = array_to_vector(as_double(v))
    return vector_to_array(Summarizer.mean(vector) if weight is None else Summarizer.mean(vector, weight))


# --- epsilon graph ---------------------------------------------------------


def _cells(emb: DataFrame, vec: str, tau: float) -> DataFrame:
    """Place vectors on a grid just wider than ``tau`` over their two main directions.

    The directions are orthonormal, so a projected difference never exceeds the
    distance: two vectors within ``tau`` lie in the same or in adjacent cells.
    Every vector is at home in its cell and visits half of the adjacent ones, so
    each pair of cells meets once.
    """
    dense = emb.withColumn("_dense", array_to_vector(as_double(F.col(vec))))
    projected = PCA(k=2, inputCol="_dense", outputCol="_p").fit(dense).transform(dense)
    at = vector_to_array("_p")
    width = tau * (1.0 + 1e-6)  # room for rounding in the projection
    placed = projected.withColumns(
        {"_x": F.floor(at[0] / width), "_y": F.floor(at[1] / width)}
    ).drop("_dense", "_p")
    spots = [(0, 0, 1), (1, -1, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    visit = F.explode(F.array(*[
        F.struct((F.col("_x") + dx).alias("x"), (F.col("_y") + dy).alias("y"), F.lit(bool(home)).alias("home"))
        for dx, dy, home in spots
    ]))
    return placed.withColumn("_spot", visit).select(
        "*", F.col("_spot.x").alias("_cx"), F.col("_spot.y").alias("_cy"), F.col("_spot.home").alias("_home")
    ).drop("_spot", "_x", "_y")


def eps_edges(
    emb: DataFrame,
    tau: float,
    group_cols: Sequence[str] = (),
    ident: str = "id",
    vec: str = "emb",
    inclusive: bool = False,
    chunk: int | None = None,
    nearest: int | None = None,
) -> DataFrame:
    """Pairs ``src < dst`` of vectors closer than ``tau``, with their distance.

    With ``group_cols`` (such as a batch number) only vectors of one group are
    compared, otherwise those in adjacent grid cells.  A group or cell of any
    size is compared in chunks of ``chunk`` vectors, by default as many as fit
    ``CHUNK_BYTES``, so a task holds at most about two chunks, and only the edges
    leave it, a bounded number at a time.  Within a task :func:`near_pairs` leaves
    out what a pivot rules out.  With ``nearest`` a task gives only the edges that are
    among so many nearest of either end, ties by id, which is all that :func:`topk`
    by distance and id of the symmetric edges can ask for.
    """
    g = list(group_cols)
    base = emb.select(*g, F.col(ident).alias("_id"), as_double(F.col(vec)).alias("_v"))
    if chunk is None:
        first = base.select(F.size("_v").alias("n")).first()
        chunk = max(1, CHUNK_BYTES // (8 * max(1, first["n"] if first else 1)))
    if g:
        placed = base.withColumns({"_cx": F.lit(0), "_cy": F.lit(0), "_home": F.lit(True)})
    else:
        placed = _cells(base, "_v", tau)
    cell = [*g, "_cx", "_cy"]
    sizes = placed.groupBy(*cell).agg(F.count_if("_home").alias("_h"), F.count(F.lit(1)).alias("_a"))
    parts = {
        "_nb": F.ceil(F.col("_h") / chunk).cast("int"),
        "_np": F.ceil(F.col("_a") / chunk).cast("int"),
    }
    sized = placed.join(sizes.where(F.col("_h") > 0).withColumns(parts).drop("_h", "_a"), cell)
    mine_b = F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int")
    mine_p = F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_np")).cast("int")

    def task(b: Column, p: Column, build: Column, probe: Column) -> Column:
        return F.struct(b.alias("b"), p.alias("p"), build.alias("build"), probe.alias("probe"))

    yes, no = F.lit(True), F.lit(False)
    as_build = F.transform(F.sequence(F.lit(0), F.col("_np") - 1), lambda p: task(mine_b, p, yes, no))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda b: task(b, mine_p, no, yes))
    single = (F.col("_nb") == 1) & (F.col("_np") == 1)
    tasks = (
        F.when(single, F.array(task(F.lit(0), F.lit(0), F.col("_home"), yes)))
        .when(F.col("_home"), F.concat(as_build, as_probe))
        .otherwise(as_probe)
    )
    spread = sized.withColumn("_t", F.explode(tasks)).select(
        *cell, "_id", "_v", "_home",
        F.col("_t.b").alias("_b"), F.col("_t.p").alias("_p"),
        F.col("_t.build").alias("_build"), F.col("_t.probe").alias("_probe"),
    )
    id_type = base.schema["_id"].dataType
    fields = [base.schema[c] for c in g] + [
        StructField("src", id_type), StructField("dst", id_type), StructField("dist", DoubleType())
    ]
    schema = StructType(fields)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames))
        build, probe = pdf[pdf["_build"]], pdf[pdf["_probe"]]
        if build.empty or probe.empty:
            return
        x, y = np.stack(build["_v"].to_numpy()), np.stack(probe["_v"].to_numpy())
        ids, place = np.unique(np.concatenate([build["_id"].to_numpy(), probe["_id"].to_numpy()]), return_inverse=True)
        of_x, of_y, home = place[: len(x)], place[len(x) :], probe["_home"].to_numpy()
        group = {c: pdf[c].iloc[0] for c in g}

        def edges(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({**{c: np.full(len(a), v) for c, v in group.items()}, "src": ids[a], "dst": ids[b], "dist": dist})

        best = Nearest(len(ids), nearest) if nearest else None
        for bi, pi, dist in near_pairs(x, y, tau, inclusive):
            a, b = of_x[bi], of_y[pi]
            keep = np.where(home[pi], a < b, a != b)
            a, b, dist = a[keep], b[keep], dist[keep]
            a, b = np.minimum(a, b), np.maximum(a, b)
            if best:
                best.add(a, b, dist)
            else:
                yield edges(a, b, dist)
        if best:
            yield edges(*best.edges())

    return spread.groupBy(*cell, "_b", "_p").applyInPandas(compare, schema)


class Nearest:
    """The edges among the ``k`` nearest of either end, ties by id, of any number that are added."""

    def __init__(self, nodes: int, k: int):
        self.k, self.bound = k, np.full(nodes, np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, max(CELLS // 4, 4 * k * nodes)

    def add(self, a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> None:
        near = dist <= np.maximum(self.bound[a], self.bound[b])
        self.kept.append((a[near], b[near], dist[near]))
        self.size += int(near.sum())
        if self.size > self.limit:
            self.edges()

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        a, b, dist = (np.concatenate(c) for c in zip((none, none, np.zeros(0)), *self.kept))
        # An id that repeats gives an edge more than once.
        order = np.lexsort((dist, b, a))
        a, b, dist = a[order], b[order], dist[order]
        other = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        a, b, dist = a[other], b[other], dist[other]
        wanted = np.zeros(len(a), bool)
        # Both directions of an edge, each in the order of its source.
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((dst, np.concatenate([dist, dist]), src))
        sorted_src = src[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_src, sorted_src)
        wanted[order[rank < self.k] % max(len(a), 1)] = True
        last = order[rank == self.k - 1]
        self.bound[src[last]] = dist[last % max(len(a), 1)]
        self.kept = [(a[wanted], b[wanted], dist[wanted])]
        self.size = int(wanted.sum())
        return self.kept[0]


def near_pairs(x: np.ndarray, y: np.ndarray, tau: float, inclusive: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y`` of vectors within ``tau``, and their distances, a bounded block at a time.

    Distances to a pivot differ by no more than the distance itself.  With both
    sides in order of theirs, a block of one side meets only the stretch of the
    other that its own, widened by ``tau``, leaves over.  The pivot is the vector of
    ``x`` farthest from their mean, which spreads the others most.
    """
    pivot = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    dx, dy = (np.sqrt(((v - pivot) ** 2).sum(1)) for v in (x, y))
    ox, oy = np.argsort(dx, kind="stable"), np.argsort(dy, kind="stable")
    dx, dy = dx[ox], dy[oy]
    slack = tau * (1 + 1e-9) + 1e-9 * (1.0 + (dx[-1] if len(dx) else 0.0))
    # The product form loses digits near zero, and more in short numbers: keep a margin, then measure.
    largest = max(np.abs(x).max(), np.abs(y).max())
    kind = np.float32 if largest < 1e12 else np.float64
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    margin = 1e-9 * (1.0 + largest**2 * x.shape[1]) + 4 * (x.shape[1] + 4) * np.finfo(kind).eps * (xx.max() + yy.max())
    # One product gives the squares of distances: each vector with its own square beside it.
    left = np.column_stack([-2.0 * x, xx, np.ones(len(x))]).astype(kind)
    right = np.column_stack([y, np.ones(len(y)), yy]).astype(kind)
    step = max(1, min(512, CELLS // max(1, len(y))))
    for first in range(0, len(x), step):
        block = ox[first : first + step]
        low, high = np.searchsorted(dy, dx[first] - slack), np.searchsorted(dy, dx[min(first + step, len(x)) - 1] + slack, "right")
        other = oy[low:high]
        if not len(other):
            continue
        rough = left[block] @ right[other].T
        i, j = np.divmod(np.flatnonzero(rough.ravel() <= tau * tau + margin), len(other))
        # Differences take as much room as the vectors: as many at a time as there are cells.
        some = max(1, CELLS // x.shape[1])
        for at in range(0, len(i), some):
            bi, pj = block[i[at : at + some]], other[j[at : at + some]]
            dist = np.sqrt(((x[bi] - y[pj]) ** 2).sum(1))
            near = dist <= tau if inclusive else dist < tau
            yield bi[near], pj[near], dist[near]


# --- edge lists ------------------------------------------------------------


def symmetric(edges: DataFrame, attrs: Sequence[str] = (), group_cols: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge, once each."""
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.withColumn("_way", F.explode(F.array(there, back)))
    return both.select(*group_cols, "_way.src", "_way.dst", *attrs).dropDuplicates([*group_cols, "src", "dst"])


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def add_self_loops(edges: DataFrame, nodes: DataFrame, ident: str = "id", group_cols: Sequence[str] = ()) -> DataFrame:
    """One loop per node in place of any loops there were."""
    loops = nodes.select(*group_cols, F.col(ident).alias("src"), F.col(ident).alias("dst")).distinct()
    return remove_self_loops(edges).select(*group_cols, "src", "dst").unionByName(loops)


def degrees(edges: DataFrame, nodes: DataFrame, ident: str = "id") -> DataFrame:
    """Degree per node of an undirected edge list; isolated nodes have 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(ident))
    counts = ends.groupBy(ident).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(ident).join(counts, ident, "left").na.fill(0, ["degree"])


def topk(edges: DataFrame, k: int, order: Sequence[Column], group_cols: Sequence[str] = ()) -> DataFrame:
    """First ``k`` neighbours per source node."""
    return bottom_k_per_key(edges, [*group_cols, "src"], k, order)


def known_edges(edges: DataFrame, nodes: DataFrame, ident: str = "id") -> DataFrame:
    """Edges between known, different nodes."""
    out = remove_self_loops(edges)
    for end in ("src", "dst"):
        out = out.join(nodes.select(F.col(ident).alias(end)).distinct(), end, "left_semi")
    return out


def with_isolated(edges: DataFrame, nodes: DataFrame, weight: str, ident: str = "id") -> DataFrame:
    """Total weight per node, 0 for nodes without an edge."""
    sums = edges.groupBy(F.col("src").alias(ident)).agg(F.sum(weight).alias(weight))
    return nodes.select(ident).join(sums, ident, "left").na.fill(0, [weight])


# --- aggregation over neighbours -------------------------------------------


def normalised_sum(edges: DataFrame, emb: DataFrame, rounds: int = 1, ident: str = "id", vec: str = "emb") -> DataFrame:
    """``rounds`` of neighbour sums weighted by 1/sqrt(deg * deg), self included.

    The edges are written once for degrees and weights, and again in blocks for the rounds.
    """
    full = materialize(add_self_loops(symmetric(edges), emb, ident), "edges")
    degree = full.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("deg"))
    weighted = (
        full.join(degree.select(F.col("node").alias("src"), F.col("deg").alias("_ds")), "src")
        .join(degree.select(F.col("node").alias("dst"), F.col("deg").alias("_dd")), "dst")
        .select("src", "dst", (1 / F.sqrt(F.col("_ds") * F.col("_dd"))).alias("w"))
    )
    return rounds_of_sums(materialize(weighted, "edge-weights"), emb, rounds, "w", ident, vec)


def weighted_sum(edges: DataFrame, emb: DataFrame, weight: str, ident: str = "id", vec: str = "emb") -> DataFrame:
    """Sum of source vectors times edge weight, per destination."""
    messages = edges.join(emb.select(F.col(ident).alias("src"), vec), "src")
    w = F.col(weight)
    scaled = F.transform(as_double(F.col(vec)), lambda x: x * w)
    return messages.withColumn("_m", scaled).groupBy(F.col("dst").alias(ident)).agg(
        vector_sum(F.col("_m")).alias(vec)
    )


def softmax_weights(edges: DataFrame, score: str) -> DataFrame:
    """Weight of each edge among those into the same destination.

    Maximum and sum are aggregates that combine early, joined back by
    destination, so a hub does not pass through one task's window.  The edges are
    written once and read three times.
    """
    edges = materialize(edges, "edges")
    top = edges.groupBy("dst").agg(F.max(score).alias("_top"))
    raised = edges.join(top, "dst").withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = raised.groupBy("dst").agg(F.sum("_e").alias("_sum"))
    return raised.join(total, "dst").withColumn("weight", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def cross_side_mean(rel: DataFrame, entities: DataFrame, other_emb: DataFrame, entity: str, other: str,
                    dim: int, vec: str = "emb", label: str = "label") -> DataFrame:
    """Mean vector of the known partners of each entity, from training positives only.

    Entities without such a partner get the zero vector.
    """
    known = rel.where((F.col("split") == "train") & (F.col(label) == 1)).select(entity, other).distinct()
    joined = known.join(other_emb.select(other, vec), other)
    means = joined.groupBy(entity).agg(vector_mean(F.col(vec)).alias("profile"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return entities.select(entity).join(means, entity, "left").withColumn("profile", F.coalesce("profile", zero))


def mean_pool(tokens: DataFrame, ident: str = "id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """Mean of the token vectors between the first and the last one.

    One aggregate: the sum over all tokens less the two ends.  NULL where
    nothing lies between them.
    """
    v = as_double(F.col(vec))
    parts = tokens.groupBy(ident).agg(
        vector_sum(F.col(vec)).alias("_sum"),
        F.min_by(v, F.col(pos)).alias("_first"),
        F.max_by(v, F.col(pos)).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    n = F.col("_n") - 2
    ends = F.zip_with("_first", "_last", lambda a, b: a + b)
    inner = F.zip_with(F.col("_sum"), ends, lambda s, e: (s - e) / n)
    return parts.select(ident, F.when(n > 0, inner).alias("pooled"))


# --- pair features ---------------------------------------------------------


def pair_vectors(rel: DataFrame, left_emb: DataFrame, right_emb: DataFrame, left: str = "drug_id",
                 right: str = "prot_id", vec: str = "emb", key: Sequence[str] = ("row_key",)) -> DataFrame:
    """Attach the vectors of both entities and their concatenation ``features``.

    Rows meet the vectors inside cells of ids (:mod:`pairloom.operators.cells`), so only ids
    and a few copies of each vector travel.  Where rows are too few for that, they
    are joined side by side, and carry one vector from the second join on.
    """
    sides = [(left_emb, left, vec), (right_emb, right, vec)]
    grid = cells.grid(rel, sides) if cells.joinable(rel, sides) else None
    if grid is not None:
        named = [(*side, name) for side, name in zip(sides, ("left_emb", "right_emb"))]
        out = cells.attach(rel, named, grid, [c for c in key if c in rel.columns])
    else:
        out = rel.join(left_emb.select(left, F.col(vec).alias("left_emb")), left)
        out = out.join(right_emb.select(right, F.col(vec).alias("right_emb")), right)
    return out.withColumn("features", F.concat("left_emb", "right_emb"))


def capped_neighbour_lists(links: DataFrame, tokens: DataFrame, entity: str, other: str, k: int,
                           order: Column, token_col: str = "tokens",
                           min_len: int | None = None, max_len: int | None = None) -> DataFrame:
    """Concatenated token arrays of at most ``k`` sampled neighbours per entity.

    Lists may be bounded strictly from below and above in length.
    """
    picked = bottom_k_per_key(links.withColumn("_o", order), [entity], k, [F.col("_o")])
    joined = picked.join(tokens.select(other, token_col), other)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_o"), F.col(token_col))))
    lists = joined.groupBy(entity).agg(F.flatten(F.transform(ordered, lambda s: s[token_col])).alias(token_col))
    size = F.size(token_col)
    if min_len is not None:
        lists = lists.where(size > min_len)
    if max_len is not None:
        lists = lists.where(size < max_len)
    return lists
