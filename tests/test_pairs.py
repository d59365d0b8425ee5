from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import linksplit, pairs


def setup(spark, m=13, n=40, seed=1, density=0.2):
    rng = random.Random(seed)
    links = {(f"d{i}", j) for i in range(m) for j in range(n) if rng.random() < (0.9 if i == 0 else density)}
    left = spark.createDataFrame([(f"d{i}",) for i in range(m)], "drug_id string")
    right = spark.createDataFrame([(j,) for j in range(n)], "prot_id long")
    return links, spark.createDataFrame(sorted(links), "drug_id string, prot_id long"), left, right


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_runs_cover_the_complement(spark, block):
    links, link_df, left, right = setup(spark)
    cells = pairs.grid(link_df, left, right)
    free = pairs.expand_runs(pairs.free_runs(cells, block))
    named = free.join(cells.left, "left_ix").join(cells.right, "right_ix")
    got = [(r["drug_id"], r["prot_id"]) for r in named.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(f"d{i}", j) for i in range(13) for j in range(40)} - links


@pytest.mark.parametrize("k", [0, 1, 50, 300, 10_000])
def test_sampled_negatives(spark, k):
    links, link_df, left, right = setup(spark)
    got = [(r["drug_id"], r["prot_id"]) for r in pairs.sample_negatives(link_df, left, right, k).collect()]
    assert len(got) == len(set(got)) == min(k, 13 * 40 - len(links))
    assert not set(got) & links


def test_samples_are_nested_and_even(spark):
    _, link_df, left, right = setup(spark, density=0.0)
    small = set(map(tuple, pairs.sample_negatives(link_df, left, right, 40).collect()))
    large = set(map(tuple, pairs.sample_negatives(link_df, left, right, 240).collect()))
    assert small < large
    per_left = {}
    for d, _ in large:
        per_left[d] = per_left.get(d, 0) + 1
    assert max(v for d, v in per_left.items() if d != "d0") <= 35


def test_link_filter_uses_the_unfiltered_links(spark):
    drugs = spark.createDataFrame([("d1", "C"), ("d2", "C"), ("d3", "C")], "drug_id string, smiles string")
    links = spark.createDataFrame([("d1", "long"), ("d2", "t")], "drug_id string, prot_id string")
    left = pairs.linked_entities(drugs, links, "drug_id")
    right = spark.createDataFrame([("t",)], "prot_id string")
    assert {r["drug_id"] for r in left.collect()} == {"d1", "d2"}
    assert pairs.positives(links, left, right).collect() == [("d2", "t")]


def test_from_links_gives_negatives_to_an_entity_without_positives(spark):
    from pairloom.plans.adapters import from_links

    drugs = spark.createDataFrame([("d1", "C"), ("d2", "C"), ("d3", "C"), ("d4", "C" * 511)], "drug_id string, smiles string")
    genes = spark.createDataFrame([("long", "A" * 701), ("t", "A"), ("u", "A")], "prot_id string, seq string")
    links = spark.createDataFrame([("d1", "long"), ("d2", "t"), ("d4", "u")], "drug_id string, prot_id string")
    for n in (None, 12):
        cells = from_links(drugs, genes, links).split("random", balanced=False, unbalanced_ratio=n)
        rows = {(r["drug_id"], r["prot_id"], r["label"]) for r in cells.collect()}
        assert rows == {("d2", "t", 1), ("d2", "u", 0), ("d1", "t", 0), ("d1", "u", 0)}


@pytest.mark.parametrize("strategy", ["random", "cold_drug", "cold_target", "cold_full"])
@pytest.mark.parametrize("per_positive", [1, 20, None])
def test_split_links_draws_from_each_splits_own_cells(spark, strategy, per_positive):
    links, link_df, left, right = setup(spark, m=30, n=20, density=0.05)
    rows = linksplit.split_links(link_df, left, right, strategy, per_positive, (0.5, 0.2, 0.3)).collect()
    cells = [(r["drug_id"], r["prot_id"]) for r in rows]
    assert len(cells) == len(set(cells))
    assert all(((r["drug_id"], r["prot_id"]) in links) == (r["label"] == 1) for r in rows)
    sides = {"cold_drug": ["drug_id"], "cold_target": ["prot_id"], "cold_full": ["drug_id", "prot_id"], "random": []}[strategy]
    for side in sides:
        assert len({(r[side], r["split"]) for r in rows}) == len({r[side] for r in rows})
    if strategy != "cold_full":
        assert sum(r["label"] for r in rows) == len(links)
    if not per_positive and strategy != "cold_full":
        assert len(rows) == 600
    free = 600 - len(links)
    for split in ("train", "val", "test"):
        n_pos = sum(r["label"] for r in rows if r["split"] == split)
        n_neg = sum(1 - r["label"] for r in rows if r["split"] == split)
        if per_positive == 1:
            assert n_neg == n_pos
        if per_positive == 20 and strategy != "random":
            assert n_neg <= 20 * n_pos
    if per_positive == 20 and strategy == "random":
        assert sum(1 - r["label"] for r in rows) == min(free, 20 * len(links))


@pytest.mark.parametrize("strategy", ["cold_drug", "cold_target", "cold_full"])
def test_all_free_cells_as_runs_are_those_written_out(spark, monkeypatch, strategy):
    links, link_df, left, right = setup(spark, m=30, n=20, density=0.2)
    rows = linksplit.split_links(link_df, left, right, strategy, None, (0.5, 0.2, 0.3)).collect()
    monkeypatch.setattr(pairs, "expand_runs", None)  # nothing is written out
    monkeypatch.setattr(pairs, "RIGHT_BLOCK", 6)
    runs = linksplit.split_runs(link_df, left, right, strategy, (0.5, 0.2, 0.3))
    listed = {s: [sum(r["split"] == s and r["label"] == y for r in rows) for y in (1, 0)] for s in ("train", "val", "test")}
    free = [(r["drug_id"], r["prot_id"], r["split"]) for r in rows if r["label"] == 0]
    # As known pairs: the links, and free cells, which are found again as often as they are given.
    known = spark.createDataFrame([(d, p) for d, p, _ in free[::3]], link_df.select("drug_id", "prot_id").schema).union(link_df.select("drug_id", "prot_id"))
    for pairs_known, hits in ((link_df, []), (known, free[::3])):
        got = {r["split"]: r for r in runs.counts(pairs_known).collect()}
        assert {s: [got[s]["positives"], got[s]["negatives"]] for s in listed} == listed
        assert {s: got[s]["linked"] for s in listed} == {s: sum(h[2] == s for h in hits) for s in listed}
    with pytest.raises(ValueError, match="single cells"):
        linksplit.split_runs(link_df, left, right, "random")


def test_cell_numbers_stay_integers(spark):
    n_right = 100_000_007
    cells = [2**57 + 12_345, 2**59 - 1, n_right * 1_441_151_879 - 1, 2**53 + 1]
    df = spark.createDataFrame([(c,) for c in cells], "cell long")
    got = df.select(*pairs.cell_index(F.col("cell"), n_right)).collect()
    assert [tuple(r) for r in got] == [divmod(c, n_right) for c in cells]


def test_unmapped(spark):
    rel = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "drug_id int, prot_id int")
    known = spark.createDataFrame([(1,)], "drug_id int")
    assert pairs.unmapped(rel, known, "drug_id").collect() == [(2, 2)]
    with pytest.raises(ValueError):
        pairs.require_mapped(rel, known, "drug_id")


def test_submatrix(spark):
    _, links, left, right = setup(spark)
    sub = pairs.submatrix(links, left, right, 4, 10).collect()
    assert len({r["drug_id"] for r in sub}) <= 4 and len({r["prot_id"] for r in sub}) <= 10
    assert sub
