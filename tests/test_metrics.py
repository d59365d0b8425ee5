from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import metrics, summary

TIES = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def brute(rows):
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for s in sorted(set(p), reverse=True):
        tp = (y[p >= s] == 1).sum()
        ap += (tp - seen) / len(pos) * tp / (p >= s).sum()
        seen = tp
    return auc, ap


def test_ties(spark):
    r = metrics.ranking_metrics(frame(spark, TIES), "y", "p").first()
    assert (round(r["auc"], 6), round(r["auprc"], 6), r["note"]) == (0.666667, 0.588889, "")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(int(rng.random() < 0.3), 0.5 if rng.random() < 0.3 else round(rng.random(), 2)) for _ in range(500)]
    rows[:2] = [(1, 0.4), (0, 0.4)]
    r = metrics.ranking_metrics(frame(spark, rows).repartition(7), "y", "p").first()
    assert np.allclose((r["auc"], r["auprc"]), brute(rows), atol=1e-12)


def test_groups_and_single_class(spark):
    rows = [("a", y, p) for y, p in TIES] + [("b", 1, 0.3), ("b", 1, 0.4), ("c", 0, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r for r in metrics.ranking_metrics(df, "y", "p", ["g"]).collect()}
    assert round(got["a"]["auc"], 6) == 0.666667
    assert got["b"]["auc"] is None and got["b"]["auprc"] == 1.0 and "AUC" in got["b"]["note"]
    assert got["c"]["auc"] is None and got["c"]["auprc"] is None and "AUPRC" in got["c"]["note"]
    assert metrics.confusion(df.where("g = 'c'"), "y", "p").first()["f1"] == 0.0


def test_confusion_threshold_is_inclusive(spark):
    r = metrics.confusion(frame(spark, [(1, 0.5), (0, 0.5), (1, 0.49), (0, 0.1)]), "y", "p").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (1, 1, 1, 1, 0.5)


def test_enrichment_and_bedroc_without_ties(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.1 + 0.3 * (i < 60)), 1.0 - i / 400) for i in range(400)]
    df = frame(spark, rows)
    y = np.array([r[0] for r in rows])
    got = {r["fraction"]: r["enrichment"] for r in metrics.enrichment(df, "y", "p").collect()}
    for f in metrics.EF_FRACTIONS:
        top = int(np.ceil(f * 400))
        assert np.isclose(got[f], y[:top].mean() / y.mean())
    ranks, n, a = np.nonzero(y)[0] + 1, 400, 80.5
    ra = len(ranks) / n
    rie = np.exp(-a * ranks / n).sum() / (ra * (1 - np.exp(-a)) / (np.exp(a / n) - 1))
    expected = rie * ra * np.sinh(a / 2) / (np.cosh(a / 2) - np.cosh(a / 2 - a * ra)) + 1 / (1 - np.exp(a * (1 - ra)))
    assert np.isclose(metrics.bedroc(df, "y", "p").first()["bedroc"], expected)


def test_tied_enrichment_is_the_mean_over_orders(spark):
    rows = [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)]
    r = metrics.enrichment(frame(spark, rows), "y", "p", [0.25]).first()
    assert np.isclose(r["enrichment"], 1.0)


def test_rank_sum(spark):
    a, b = [0.9, 0.8, 0.7, 0.7], [0.7, 0.5, 0.4]
    df = spark.createDataFrame([(1, x) for x in a] + [(0, x) for x in b], "first int, v double")
    r = metrics.rank_sum(df, "first", "v").first()
    assert r["w"] == 4 + 4 + 6 + 7
    z = (21 - 4 * 8 / 2) / np.sqrt(4 * 3 * 8 / 12)
    assert np.isclose(r["z"], z)
    from math import erfc, sqrt

    assert abs(r["p_value"] - erfc(abs(z) / sqrt(2))) < 2e-7


@pytest.mark.parametrize("n", [1, 2, 30, 101])
def test_quantiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.random(), 1) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    r = summary.stability(df, "g", "v").first()
    assert np.allclose([r["q_25"], r["q_50"], r["q_75"]], np.quantile(values, [0.25, 0.5, 0.75]))
    assert r["contexts"] == n and (n > 1 or r["std"] == 0.0)


def test_summaries(spark):
    runs = spark.createDataFrame([("d", "s", 0.5), ("d", "s", 0.7), ("d", "t", 0.9)], "dataset string, scenario string, auc double")
    got = {r["scenario"]: (r["runs"], r["mean_auc"], r["std_auc"]) for r in summary.repeats(runs, ["auc"]).collect()}
    assert got == {"s": (2, 0.6, 0.141421), "t": (1, 0.9, 0.0)}
    rows = [("k", "a", 0.8, 5, False), ("k", "b", 0.8, 6, False), ("k", "last", 0.99, 9, True), ("m", "last", 0.1, 3, True), ("n", "x", None, 1, False)]
    df = spark.createDataFrame(rows, "k string, run string, auc double, mtime int, is_last boolean")
    best = {r["k"]: r["run"] for r in summary.best_run(df, ["k"], "run", "auc", "mtime", "is_last").collect()}
    assert best == {"k": "b", "m": "last", "n": "x"}


def test_export_defaults(spark):
    checked = spark.createDataFrame(
        [(0, "C", "A", "1", None), (1, "", "A", "1", "empty_smiles"), (2, "C", "A", "0", None)],
        "source_row long, smiles string, sequence string, activation string, reason string",
    )
    predictions = spark.createDataFrame([(0, 1, 0.7, 0.3), (2, 0, 0.2, 0.8)], "source_row long, predicted_label int, probability_active double, probability_inactive double")
    assigned = spark.createDataFrame([(0, "train")], "source_row long, split string")
    out = {r["source_row"]: r for r in summary.export_rows(checked, predictions, assigned).collect()}
    assert [out[i]["split"] for i in range(3)] == ["train", "excluded", "unused"]
    assert out[1]["excluded_reason"] == "empty_smiles" and out[1]["predicted_label"] is None
    assert out[0]["excluded_reason"] == "" and out[0]["activity"] == "1"
    assert "split" not in summary.export_rows(checked, predictions).columns
