"""Sums over a blocked adjacency against a dense matrix, with hubs on either end."""

from __future__ import annotations

import numpy as np
import pytest

from pairloom.operators import blocked


def graph_frames(spark, n=60, width=5, seed=3, key=lambda i: i, kind="long"):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < 0.05) * rng.normal(size=(n, n))  # a[dst, src]
    a[7, :] = rng.normal(size=n)
    a[:, 11] = rng.normal(size=n)
    x = rng.normal(size=(n, width))
    edges = [(key(int(s)), key(int(d)), float(a[d, s])) for d, s in zip(*np.nonzero(a))]
    emb = [(key(i), x[i].tolist()) for i in range(n)]
    return a, x, spark.createDataFrame(edges, f"src {kind}, dst {kind}, w double"), spark.createDataFrame(emb, f"id {kind}, emb array<double>")


def values(df):
    return {r["id"]: np.array(r["emb"]) for r in df.collect()}


@pytest.mark.parametrize(("rounds", "blocks"), [(1, 1), (1, 7), (3, 4), (2, None)])
def test_rounds_equal_matrix_powers(spark, rounds, blocks):
    a, x, edges, emb = graph_frames(spark)
    got = values(blocked.rounds_of_sums(edges, emb, rounds, blocks=blocks))
    expected = np.linalg.matrix_power(a, rounds) @ x
    assert set(got) == set(np.flatnonzero(np.abs(a).sum(1)))
    assert all(np.allclose(got[i], expected[i]) for i in got)


def test_text_ids(spark):
    a, x, edges, emb = graph_frames(spark, n=25, key=lambda i: f"n{i}", kind="string")
    got = values(blocked.rounds_of_sums(edges, emb, 2, blocks=3))
    assert all(np.allclose(got[f"n{i}"], (a @ a @ x)[i]) for i in range(25) if f"n{i}" in got) and len(got) > 20


def test_a_hub_sends_one_vector_per_block(spark):
    n, blocks = 400, 5
    star = [(0, i, 1.0) for i in range(1, n)] + [(i, 0, 1.0) for i in range(1, n)]
    edges = spark.createDataFrame(star, "src long, dst long, w double")
    held = blocked.adjacency(edges, blocks)
    rows = held.collect()
    vectors = sum(r["task"] == blocked.SEND_VECTOR for r in rows)
    sums = len({(r["block"], r["dst"]) for r in rows if r["task"] == blocked.SEND_SUM})
    assert vectors <= blocks and sums <= blocks
    assert sum(r["task"] != blocked.SEND_VECTOR for r in rows) == len(star)
    emb = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "id long, emb array<double>")
    got = values(blocked.rounds_of_sums(edges, emb, 1, blocks=blocks))
    assert got[0].tolist() == [n - 1, n * (n - 1) / 2] and all(got[i].tolist() == [1.0, 0.0] for i in range(1, n))


def test_missing_vectors_null_ends_and_empty_tables(spark):
    edges = spark.createDataFrame([(1, 2, 2.0), (9, 2, 5.0), (1, 8, 1.0), (None, 2, 1.0), (1, None, 1.0)], "src long, dst long, w double")
    emb = spark.createDataFrame([(1, [1.0, 3.0]), (2, None), (None, [1.0, 1.0])], "id long, emb array<double>")
    got = values(blocked.rounds_of_sums(edges, emb, 1, blocks=3))
    assert {k: v.tolist() for k, v in got.items()} == {2: [2.0, 6.0], 8: [1.0, 3.0]}
    assert blocked.rounds_of_sums(edges.where("src < 0"), emb, 2, blocks=3).count() == 0
    assert blocked.rounds_of_sums(edges, emb.where("id < 0"), 2).count() == 0
    assert values(blocked.rounds_of_sums(edges, emb, 0)).keys() == {1}
    with pytest.raises(ValueError):
        blocked.rounds_of_sums(edges, emb, -1)


def test_blocks_stay_small_as_nodes_grow():
    """A block's share of 64-wide vectors is bounded, and small beside what its frames take around them."""
    for n in (10_000, 1_000_000, 100_000_000):
        assert n * 64 * 8 / blocked.blocks_needed(n, 64) <= 4 << 20
