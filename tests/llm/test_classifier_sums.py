"""The classifier against statistics, sums and a curve worked out directly."""

from __future__ import annotations

import math

import numpy as np
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import classifier, packing, url_filter
from pairloom.llm.common import materialize
from tests.llm.helpers import CLASHES, awkward, frame, plain, prose, words
from tests.llm.test_tables import corpus


def share(a: float, b: float) -> float:
    return a / b if b > 0 else 0.0


def measured(text: str | None) -> list[float]:
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if x]
    n, chars = len(w), len(t) - sum(c in " \t\n\x0b\x0c\r" for c in t)
    triples = list(zip(w, w[1:], w[2:]))
    return [
        math.log1p(n), share(chars, n), *[share(len(regex.findall(c, t)), chars) for c in classifier.CLASSES],
        share(len(set(w)), n), share(sum(a == b for a, b in zip(w, w[1:])), n), share(len(set(triples)), len(triples)),
        share(sum(len(x) <= 3 for x in w), n), math.log1p(share(chars, len(lines))), share(len(set(lines)), len(lines)),
        share(sum(bool(regex.search(r"[.!?…:;\"”»)]\s*$", x)) for x in lines), len(lines)),
    ]


def test_statistics(spark):
    rows = awkward() + [(200 + i, t, "en", "s", 1) for i, t in enumerate(["a a a b", "A|b #x\n\nA|b #x\nfin.", "one", "word! " * 5000, "É ß 1 2\n»"])]
    got = [(r["id"], [round(v, 9) for v in r["x"]]) for r in classifier.statistics(frame(spark, rows, clashes=True).drop("id")).collect()]
    assert plain(got) == plain((r[0], [round(v, 9) for v in measured(r[1])]) for r in rows)


def test_weights_and_curve(spark):
    rows, labels = corpus(150)
    x = np.array([measured(r[1]) for r in rows])
    y = np.array([float(q) for _, q in labels])
    fold = np.array([classifier_fold(i) for i, *_ in rows])
    kept = fold != 0
    x, y, fold = x[kept], y[kept], fold[kept]
    features = classifier.statistics(frame(spark, rows).repartition(4))
    model = classifier.learn(features, spark.createDataFrame(labels, "doc_id long, quality int"))
    size = classifier.FEATURES
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    z = np.clip((x - model.mean) / model.scale, -classifier.CLIP, classifier.CLIP)
    waves = np.hstack([np.cos(z @ model.directions + model.phases) * math.sqrt(2 / size), np.ones((len(x), 1))])

    def ridge(rows: np.ndarray) -> np.ndarray:
        a, b = waves[rows], y[rows]
        total = waves if rows.all() else a
        penalty = classifier.RIDGE * max(1.0, len(total)) * np.eye(size + 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(a.T @ a + penalty, a.T @ b)

    assert np.allclose(model.weights, ridge(np.ones(len(x), bool)), atol=1e-6)
    raw = np.array([waves[i] @ ridge(fold != fold[i]) for i in range(len(x))])
    at = np.clip((raw + 1) / 3 * classifier.BINS, 0, classifier.BINS - 1).astype(int)
    bins = sorted(set(at.tolist()))
    n, t = np.array([(at == b).sum() for b in bins], float), np.array([y[at == b].sum() for b in bins])
    mean = lambda a, b: t[a : b + 1].sum() / n[a : b + 1].sum()
    curve = [max(min(mean(a, b) for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    assert np.allclose(model.curve_x, (np.array(bins) + 0.5) / classifier.BINS * 3 - 1)
    assert np.allclose(model.curve_y, curve)


def classifier_fold(i: int) -> int:
    import zlib

    return zlib.crc32(str(i).encode()) % classifier.FOLDS


def test_clashing_columns(spark):
    rows, labels = corpus(60)
    given = spark.createDataFrame(labels, "doc_id long, quality int").withColumns({c: F.lit(c) for c in ("id", "x", "y", "fold", "text", "score")})
    docs = frame(spark, rows)
    more = docs.withColumns({c: F.lit(c) for c in (*CLASHES, "x", "y", "fold", "score", "quality", "_t", "_w", "_text", "piece", "length", "offset")})
    assert plain(classifier.digest(more, given).collect()) == plain(classifier.digest(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    assert plain(packing.digest(more).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == plain(
        packing.digest(docs).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    )
    urls = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://casino.net/"), (3, None)], "page_id long, url string")
    other = urls.withColumns({c: F.lit(c) for c in (*CLASHES, "told", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "strict")})
    judged = url_filter.judge(other)
    assert plain(judged.select("page_id", "host", "verdict").collect()) == plain(url_filter.judge(urls).select("page_id", "host", "verdict").collect())
    assert all(r[c] == c for r in judged.collect() for c in (*CLASHES, "told", "strict"))


def test_pipeline_with_clashing_columns(spark):
    rows = [(i, prose(i, 60), "en", f"s{i % 3}", 0) for i in range(12)] + [(50, prose(3, 60), "en", "s1", 0), (60, prose(70, 4000), None, None, None)]
    docs = frame(spark, rows, clashes=True).withColumns({c: F.lit(c) for c in ("quality", "_quality", "clean_text", "_text", "size", "mark", "source_size")})
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names and all(r["mark"] == "mark" and r["id"] == "<id>" for r in docs.collect())
    assert {r["doc_id"] for r in docs.collect()} <= {r[0] for r in rows}
    assert docs.count() > 12
