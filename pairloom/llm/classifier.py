"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document (lengths, shares of characters, repetition) are column
expressions.  Random Fourier features turn them into a bounded vector whose inner
product approximates a Gaussian kernel.  Each partition sums its part of the normal
equations, the parts are added up in a tree, and the ridge system, whose size
depends on the number of features alone, is solved on the driver.  Sums are kept
for each fold of the training rows, so that every training row also gets a score
from weights that have not seen it; those scores, in a fixed number of bins, are
pooled to a monotone curve.

All labelled rows are used.  Labels, language, source and id are no inputs.

Defined results: NULL counts as empty, and an empty text is scored like any other.
Labels other than 0 and 1 and rows without a label teach nothing; of repeated
labels the mean counts.  With no label at all every score is 0.5; with labels of
one kind it is that kind.  A row whose id is NULL is never learned from and counts
as held out.  Repeated rows are scored alike.  Texts of any length are measured
whole, on the order of a hundred bytes for each word of the longest.  Other columns
of either table are not read; without documents there are no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pairloom.llm.common import filled, materialize, words

FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-4
SEED = 42
FOLDS = 5  # the first is held out
BINS = 4096
CLIP = 6.0
TIE_SHARE = 1e-3
STATISTICS = 15
# Classes of characters whose shares are looked at.
CLASSES = (r"[#*$%&<>{}\[\]~^=_\\]", r"[!?]", r"[|»›•·→]", r"\p{Lu}", r"[0-9]", r"[.,;:]")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def _apart(array: str, n: int, merge) -> Column:
    size = F.greatest(F.size(array) - n, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), size), F.slice(array, F.lit(1 + n), size), merge)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``x``, the statistics of the text as an array of doubles."""
    base = docs.select(docs[id_col].alias("id"), filled(docs[text_col]).alias("_t"))
    split = base.select("id", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x != "").alias("_l"))
    counted = split.select(
        "id",
        F.size("_w").alias("_n"),
        F.length("_t").alias("_c"),
        F.size("_l").alias("_nl"),
        F.size(F.array_distinct("_l")).alias("_dl"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?…:;\"”»)]\s*$"))).alias("_closed"),
        *[F.regexp_count("_t", F.lit(c)).alias(f"_c{i}") for i, c in enumerate(CLASSES)],
        F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D]")).alias("_space"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
        F.size(F.filter("_w", lambda x: F.length(x) <= 3)).alias("_short"),
    )
    rest = [c for c in counted.columns if c != "_h"]
    paired = counted.select(
        *rest, "_h", F.size(F.array_distinct("_h")).alias("_distinct"), _apart("_h", 1, lambda a, b: F.xxhash64(a, b)).alias("_p"),
        F.size(F.filter(_apart("_h", 1, lambda a, b: a == b), lambda same: same)).alias("_same"),
    )
    tripled = paired.select(*rest, "_distinct", "_same", _apart("_p", 1, lambda a, b: F.xxhash64(a, b)).alias("_g"))
    n, chars = F.col("_n"), F.col("_c") - F.col("_space")
    x = F.array(
        F.log1p(n.cast("double")),
        _share(chars, n),
        *[_share(F.col(f"_c{i}"), chars) for i in range(len(CLASSES))],
        _share(F.col("_distinct"), n),
        _share(F.col("_same"), n),
        _share(F.size(F.array_distinct("_g")), F.size("_g")),
        _share(F.col("_short"), n),
        F.log1p(_share(chars, F.col("_nl"))),
        _share(F.col("_dl"), F.col("_nl")),
        _share(F.col("_closed"), F.col("_nl")),
    )
    return tripled.select("id", x.alias("x"))


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo ``FOLDS``; fold 0 is held out."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS).cast("int")


# --- the model --------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Bounded by the number of features and bins, whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2.0 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; where the curve is flat a small share of the raw score keeps its order."""
        raw = self.raw(x)
        level = np.interp(raw, self.curve_x, self.curve_y)
        return np.clip((1 - TIE_SHARE) * level + TIE_SHARE / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten()).reshape(len(column), -1)


def pool(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic means of ``y / n``, weighted by ``n``: adjacent blocks that fall are pooled."""
    blocks: list[list[float]] = []
    for total, weight in zip(y, n):
        blocks.append([total, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, weight, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + width]
    return np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on rows ``x, y, fold``; ``y`` lies between 0 and 1, folds count from 1."""
    dim = STATISTICS
    stats = rows.agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(dim)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(dim)]
    ).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(dim)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(dim)])
    random = np.random.default_rng(seed)
    model = Model(
        mean, scale, random.normal(0, 1 / width, (dim, features)), random.uniform(0, 2 * np.pi, features),
        np.append(np.zeros(features), 0.5), np.array([0.0]), np.array([0.5]),
    )
    size = features + 1
    shape = (FOLDS, size, size + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y, fold = model.map(_matrix(batch, "x")), *(np.asarray(batch.column(i)) for i in (1, 2))
            for f in range(FOLDS):
                mine = z[fold == f]
                total[f] += mine.T @ np.hstack([mine, y[fold == f, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.select("x", "y", "fold").mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
    if parts.isEmpty():
        return model
    folds = parts.treeReduce(lambda a, b: a + b, depth=3).reshape(shape)
    total = folds.sum(axis=0)

    def solve(s: np.ndarray) -> np.ndarray:
        penalty = ridge * max(1.0, s[-1, -2]) * np.eye(size)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(s[:, :-1] + penalty, s[:, -1])

    unseen = np.stack([solve(total - s) if s.any() and (total - s).any() else solve(total) for s in folds])
    model.weights = solve(total)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y, fold = model.map(_matrix(batch, "x")), *(np.asarray(batch.column(i)) for i in (1, 2))
            raw = (z * unseen[fold]).sum(axis=1)
            at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)
            n, t = np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(t[full])], names=["bin", "n", "t"])

    counts = rows.select("x", "y", "fold").mapInArrow(bins, "bin long, n long, t double")
    table = counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).orderBy("bin").collect()  # at most BINS rows
    at, n, t = (np.array([r[c] for r in table], float) for c in ("bin", "n", "t"))
    model.curve_x, model.curve_y = (at + 0.5) / BINS * 3 - 1, pool(t, n)
    return model


def learn(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **options) -> Model:
    """Fit on the rows ``id, x`` that have a label and are not held out."""
    given = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("y"))
    known = features.join(given, features["id"] == given["_id"]).select("x", F.col("y").cast("double").alias("y"), fold_of(F.col("id")).alias("fold"))
    return fit(materialize(known.where("fold <> 0"), "training"), **options)


def predict(features: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Replace ``x`` by ``score`` and ``predicted``."""
    own = [f for f in features.schema.fields if f.name != "x"]
    ordered = features.select(*[f.name for f in own], "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(model.score(_matrix(batch, "x")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    scored = ordered.mapInArrow(run, StructType([*own, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


# --- the query --------------------------------------------------------------------------------------------------------


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    features = materialize(statistics(docs), "statistics")
    model = learn(features, labels)
    return predict(features, model).select(
        F.col("id").alias("doc_id"), (fold_of(F.col("id")) == 0).alias("held_out"), "score", "predicted"
    )
