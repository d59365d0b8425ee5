"""Steps whose cost grew faster than their input: what they move or hold now, and that they give the same rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pairloom.operators import affinity, coldfull, graph, neighbours, splits
from pairloom.sources import readers
from queries import runs


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_taken_apart_once_a_block(spark, tmp_path, monkeypatch):
    for name in ("part-2", "part-10", "part-02"):
        (tmp_path / name).write_text(f"{name} a\n{name} b\n")
    plans, write = {}, readers.materialize

    def watched(df, name):
        plans[name] = _plan(df)
        return write(df, name)

    monkeypatch.setattr(readers, "materialize", watched)
    rows = readers.with_source_row(spark.read.text(str(tmp_path))).orderBy("source_row").collect()
    assert "regexp_replace" not in plans["numbered-rows"]
    assert [r["source_row"] for r in rows] == list(range(6))
    assert [r["value"] for r in rows[4:]] == ["part-10 a", "part-10 b"]


def test_fill_reads_written_rows(spark, monkeypatch):
    written, write = [], affinity.materialize
    monkeypatch.setattr(affinity, "materialize", lambda df, name: written.append(name) or write(df, name))
    df = spark.createDataFrame([(0, "a", None), (1, "a", "x"), (2, None, None), (3, "a", None)], "row long, seq string, id string")
    out = affinity.fill_ids(df, "seq", "id", "row", block=2)
    assert {r["row"]: r["id"] for r in out.collect()} == {0: "x", 1: "x", 2: None, 3: "x"}
    assert written == ["fill-rows"]


def test_small_logs_share_tasks(spark, tmp_path):
    folder = tmp_path / "d" / "s"
    folder.mkdir(parents=True)
    for i in range(1200):
        (folder / f"run_{i}.log").write_bytes(f"Test AUC: 0.{i}\né".encode())
    logs = readers.read_run_logs(spark, str(tmp_path))
    assert logs.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {r["run_tag"]: r["log"] for r in logs.collect()} == {f"run_{i}": f"Test AUC: 0.{i}\né" for i in range(1200)}


def test_seeds_are_counted_side_by_side(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(int(a), int(b), 1 + int(a) % 3) for a, b in rng.integers(0, 9, (60, 2))], "l long, r long, n long").distinct()
    seeds = ["42", "139"]
    label = {(s, e): str(rng.choice(splits.SPLITS)) for s in seeds for e in range(9)}
    side = spark.createDataFrame([(s, e, x) for (s, e), x in label.items()], "seed string, r long, s string")
    labels = spark.createDataFrame([(s, e, "train") for s in seeds for e in range(10)], "seed string, l long, s string")
    assert coldfull._side_by_side(side, "r", seeds).count() == 9
    out = coldfull.split_counts(pairs, "l", "r", side, labels)
    # The pairs meet one row per entity, not one per entity and seed.
    known = pairs.collect()
    for r in out.collect():
        assert [r[f"n_{s}"] for s in splits.SPLITS] == [
            sum(p["n"] for p in known if p["l"] == r["l"] and label[r["seed"], p["r"]] == s) for s in splits.SPLITS
        ]
    assert out.count() == 20


def test_report_reads_checked_records(spark, monkeypatch):
    written, write = [], runs.materialize
    monkeypatch.setattr(runs, "materialize", lambda df, name: written.append(name) or write(df, name))
    assert runs.report_file(spark, "/root/testdata/sf0.001").count() == 1
    assert written == ["checked", "relation"]


def test_near_pairs_measure_a_bounded_number_at_a_time(monkeypatch):
    monkeypatch.setattr(graph, "CELLS", 1 << 14)
    x = np.random.default_rng(3).normal(size=(600, 64)) * 1e-3
    tracemalloc.start()
    n = sum(len(i) for i, _, _ in graph.near_pairs(x, x, 1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600 * 600
    assert peak < 5 << 20  # one block's differences alone were 8 MB


def test_only_nearest_edges_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELLS", 1 << 8)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 3)), 1)  # with ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    order = [F.col("dist"), F.col("dst")]
    for chunk in (None, 40):
        every = graph.eps_edges(df, 1.5, chunk=chunk)
        some = graph.eps_edges(df, 1.5, chunk=chunk, nearest=2)
        assert some.count() < every.count()
        top = [{tuple(r) for r in graph.topk(graph.symmetric(e, ["dist"]), 2, order).collect()} for e in (every, some)]
        assert top[0] == top[1]


def test_vectors_travel_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<float>")
    written, write = {}, neighbours.materialize

    def watched(frame, name):
        written[name] = write(frame, name)
        return written[name]

    monkeypatch.setattr(neighbours, "materialize", watched)
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbours.knn_exact(df, k=3).collect()}
    x = x.astype(np.float32).astype(np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        assert [got[i, r + 1] for r in range(3)] == sorted(range(300), key=lambda j: (d[i, j], j))[:3]
    # Few tiles meet, however many blocks do.
    tiles = written["knn-tiles"].select("t").distinct().count()
    assert tiles <= 2 * neighbours.TILES
    assert written["knn-blocks"].count() > tiles


def test_rows_that_come_twice_do_not_push_out_neighbours(spark):
    x = np.arange(12.0)[:, None] * [1.0, 0.5]
    once = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    twice = once.unionByName(once).unionByName(once)
    order = [F.col("dist"), F.col("dst")]
    near = [{tuple(r) for r in graph.topk(graph.symmetric(graph.eps_edges(df, 8.0, nearest=n), ["dist"]), 3, order).collect()} for df, n in ((once, None), (twice, 3))]
    assert near[0] == near[1]
    known = [{tuple(r) for r in neighbours.knn_exact(df, k=3).collect()} for df in (once, twice)]
    assert known[0] == known[1]
