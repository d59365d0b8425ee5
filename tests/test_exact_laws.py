"""Exact rank-sum law, exact neighbours, and the mean over all pairs, each against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom.operators import metrics, neighbours, similarity


def by_enumeration(first: list[float], second: list[float]) -> tuple[float, float | None]:
    values = first + second
    rank = [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]
    w, mean = sum(rank[: len(first)]), len(first) * (len(values) + 1) / 2
    if not first or not second:
        return w, None
    sums = [sum(c) for c in itertools.combinations(rank, len(first))]
    return w, sum(abs(s - mean) >= abs(w - mean) - 1e-9 for s in sums) / len(sums)


def test_rank_sum_law(spark):
    rng = random.Random(4)
    groups = {f"g{i}": ([float(rng.randrange(9)) for _ in range(rng.randrange(0, 7))], [float(rng.randrange(12)) for _ in range(rng.randrange(0, 7))]) for i in range(30)}
    groups["ten"] = ([float(v) for v in range(10)], [v + 0.5 for v in range(2, 12)])
    groups["apart"] = ([1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0])
    rows = [(g, x, v) for g, sides in groups.items() for x, side in ((1, sides[0]), (0, sides[1])) for v in side]
    rows += [("g0", 1, None), ("g0", None, 5.0), (None, 1, 2.0), (None, 0, 3.0)]
    got = {r["g"]: r for r in metrics.rank_sum_exact(spark.createDataFrame(rows, "g string, x int, v double").repartition(3), "x", "v", ["g"]).collect()}
    for g, (first, second) in groups.items():
        if first or second:
            w, p = by_enumeration(first, second)
            assert got[g]["w"] == w and (got[g]["n1"], got[g]["n2"]) == (len(first), len(second))
            assert p is None and got[g]["p_value"] is None or got[g]["p_value"] == pytest.approx(p, abs=1e-12)
    assert got["apart"]["p_value"] == pytest.approx(2 / 70) and got[None]["p_value"] == 1.0


def test_too_many_runs_are_an_error(spark):
    rows = spark.range(metrics.EXACT_RUNS + 1).select(F.lit("g").alias("g"), (F.col("id") % 2).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    with pytest.raises(PySparkException, match="runs in a comparison"):
        metrics.rank_sum_exact(rows, "x", "v", ["g"]).collect()


def neighbours_by_force(ids: list, x: np.ndarray, k: int) -> set:
    out = set()
    for i, a in enumerate(ids):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), b) for j, b in enumerate(ids) if j != i)
        out |= {(a, b, round(dist, 9), r) for r, (dist, b) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize("k,block", [(1, 4), (3, 16), (7, 512)])
def test_neighbours(spark, monkeypatch, k, block):
    """Clusters, copies of one vector, and strays; many blocks to a centre."""
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", block)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in rng.normal(0, 4, (4, 3))] + [np.ones((60, 3)), rng.normal(0, 20, (9, 3))])
    ids = [int(i) for i in rng.permutation(len(x)) * 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(None, [0.0, 0.0, 0.0]), (7777, None)], "id long, emb array<double>")
    got = neighbours.knn_exact(df.repartition(4).withColumn("extra", F.lit(1)), k=k)
    assert {(r["src"], r["dst"], round(r["distance"], 9), r["rank"]) for r in got.collect()} == neighbours_by_force(ids, x, k)


def test_neighbours_of_few(spark):
    schema = "id string, emb array<double>"
    assert neighbours.knn_exact(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.knn_exact(spark.createDataFrame([("a", [1.0])], schema)).count() == 0
    two = neighbours.knn_exact(spark.createDataFrame([("a", [1.0]), ("b", [4.0])], schema), k=5)
    assert sorted(map(tuple, two.collect())) == [("a", "b", 3.0, 1), ("b", "a", 3.0, 1)]


def test_mean_over_all_pairs(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcdef", k=60)) for _ in range(12)]
    texts = ["".join(rng.choice(pool)[:40] for _ in range(3)) for _ in range(150)] + ["ab", ""] + [pool[0]] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    total = sum(len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and b)
    exact = total / len(sets) ** 2
    found = similarity.mean_similarity_all(similarity.shingles(df, "id", "text")).first()
    assert abs(found["mean_similarity"] - exact) < 0.01 * exact
    assert abs(found["mean_similarity"] - exact) < 4 * found["std_error"] + 1e-12
    none = spark.createDataFrame([], "id long, text string")
    assert similarity.mean_similarity_all(similarity.shingles(none, "id", "text")).first()["mean_similarity"] == 0.0
