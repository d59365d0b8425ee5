from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import hex_threshold, seeded_hash
from pairloom.operators import coldfull, sampling, splits, summary


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def relation(spark, n=400, drugs=30, prots=12, seed=1, positive=0.3):
    rng = random.Random(seed)
    rows = [
        (f"r{i}", 0 if rng.random() < 0.34 else rng.randrange(drugs) * 17, rng.randrange(prots) * 5, int(rng.random() < positive))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "row_key string, drug_id long, prot_id long, label int")


@pytest.mark.parametrize("n", [5, 10, 99, 100])
def test_sizes_follow_the_remainder_rule(spark, n):
    df = spark.range(n).withColumn("row_key", F.col("id").cast("string"))
    ratio = (0.65, 0.15, 0.20)
    out = splits.split_rows(df, F.col("row_key"), ratio, 7)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    n_test = math.ceil(0.2 * n)
    n_val = math.ceil(0.15 * (n - n_test))
    assert got == {k: v for k, v in {"test": n_test, "val": n_val, "train": n - n_test - n_val}.items() if v}
    order = sorted(map(str, range(n)), key=lambda k: md5(7, k))
    assert {r["row_key"] for r in out.where("split = 'test'").collect()} == set(order[:n_test])


def test_ratio_must_sum_to_one():
    with pytest.raises(ValueError):
        splits.check_ratio((0.5, 0.5, 0.5))
    with pytest.raises(ValueError):
        splits.strategy_name("warmish")
    assert splits.strategy_name("warm") == "random"
    assert hex_threshold(0.01) == "028f5c28"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("side", ["drug_id", "prot_id"])
def test_cold_split_shares_no_entity_and_loses_none(spark, seed, side):
    rel = relation(spark, seed=seed)
    out = splits.split_cold(rel, side, (0.6, 0.2, 0.2), seed).cache()
    per_entity = out.groupBy(side).agg(F.countDistinct("split").alias("n"))
    assert per_entity.where("n > 1").count() == 0
    assert out.count() == rel.count()
    assert out.where("split is null").count() == 0


def test_sparse_ids(spark):
    rel = spark.createDataFrame([("a", 3, 1, 1), ("b", 70, 1, 0), ("c", 900, 1, 0)], "row_key string, drug_id long, prot_id long, label int")
    out = splits.split_cold(rel, "drug_id", (0.4, 0.3, 0.3))
    assert sorted(r["split"] for r in out.collect()) == ["test", "train", "val"] or out.count() == 3


def naive_balance(rows, seed, ratio):
    out = set()
    for s in {r["split"] for r in rows}:
        part = [r for r in rows if r["split"] == s]
        pos = [r["row_key"] for r in part if r["label"] == 1]
        neg = sorted((r["row_key"] for r in part if r["label"] == 0), key=lambda k: md5(seed, k))
        out |= set(pos) | set(neg[: ratio * len(pos)])
    return out


@pytest.mark.parametrize("positive,ratio", [(0.3, 1), (0.3, 10), (0.8, 1), (0.05, 3), (0.0, 1), (1.0, 1)])
def test_balance_equals_naive_form(spark, positive, ratio):
    rel = splits.split_rows(relation(spark, positive=positive), F.col("row_key"), (0.6, 0.2, 0.2), 3).cache()
    kept = {r["row_key"] for r in splits.balance(rel, F.col("row_key"), ratio, 3).collect()}
    assert kept == naive_balance(rel.collect(), 3, ratio)


def test_balance_without_ratio_keeps_all(spark):
    rel = relation(spark).withColumn("split", F.when(F.col("drug_id") == 0, "unused").otherwise("train"))
    assert splits.balance(rel, F.col("row_key"), 0).count() == rel.where("split = 'train'").count()


def test_result_does_not_depend_on_partitions(spark):
    rel = relation(spark)
    expected = None
    for n in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = splits.balance(splits.split_cold(rel.repartition(n), "drug_id", (0.6, 0.2, 0.2)), F.col("row_key"))
        rows = {(r["row_key"], r["split"]) for r in out.collect()}
        expected = expected or rows
        assert rows == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_indicator_and_carving(spark):
    df = spark.createDataFrame([(str(i), 1 + i % 4) for i in range(400)], "row_key string, indicator int")
    carved = splits.carve_validation(df, F.col("row_key"), 0.2, 42)
    for r in carved.join(df.withColumnRenamed("indicator", "was"), "row_key").collect():
        low = md5(42, r["row_key"])[:8] < hex_threshold(0.2)
        assert r["indicator"] == (2 if r["was"] == 1 and low else r["was"])
    assert splits.split_by_indicator(df).groupBy("split").count().where("count = 100").count() == 3


def test_sample_positions_and_batches(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2))
    h = seeded_hash(5, "id")
    sample = sampling.sample_exact(df, 20, h, ["g"])
    naive = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(h))).where("rn <= 20")
    assert {r["id"] for r in sample.collect()} == {r["id"] for r in naive.collect()}
    pos = {r["id"]: r["pos"] for r in sampling.shuffled_position(df, h, digits=1).collect()}
    order = sorted(range(1000), key=lambda i: md5(5, i))
    assert pos == {i: n for n, i in enumerate(order)}
    b = sampling.batches(df, F.col("id"), 300, drop_last=True, total=F.lit(1000))
    assert {r["batch_id"]: r["count"] for r in b.groupBy("batch_id").count().collect()} == {0: 300, 1: 300, 2: 300}
    with pytest.raises(ValueError):
        sampling.batches(df, F.col("id"), 300, drop_last=True)


def test_sample_of_very_many_groups(spark):
    df = spark.range(200_000).select((F.col("id") % 100_000).alias("g"), "id")
    sample = sampling.sample_exact(df, 1, seeded_hash(1, "id"), ["g"])
    assert sample.count() == sample.select("g").distinct().count() == 100_000


@pytest.mark.parametrize("grouped", [False, True])
def test_sizes_are_exact_with_repeated_keys(spark, grouped):
    df = spark.range(1000).select((F.col("id") % 10).alias("key"), "id", (F.col("id") % 2).alias("g"))
    df = df.union(df.limit(0)).withColumn("row_key", F.col("key").cast("string"))
    out = splits.split_rows(df, F.col("row_key"), (0.5, 0.2, 0.3), 42, ["g"] if grouped else [])
    sizes = {(r["g"] if grouped else 0, r["split"]): r["count"] for r in out.groupBy(*(["g"] if grouped else []), "split").count().collect()}
    expected = {"test": 300, "val": 140, "train": 560}
    assert sizes == ({(g, s): n // 2 for g in (0, 1) for s, n in expected.items()} if grouped else {(0, s): n for s, n in expected.items()})
    assert out.select("id").distinct().count() == 1000


def test_balance_is_exact_with_repeated_keys(spark):
    df = spark.range(300).select(F.lit("same").alias("row_key"), (F.col("id") < 40).cast("int").alias("label"), F.lit("train").alias("split"), "id")
    out = splits.balance(df, F.col("row_key"), 2, 42)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {1: 40, 0: 80}


def test_cuts_search_deeper_where_a_bucket_is_large(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED_ROWS", 3)
    df = spark.range(500).withColumn("h", F.concat(F.lit("abcdef"), F.md5(F.col("id").cast("string"))))
    order = sorted((r["h"], r["id"]) for r in df.collect())
    kept = sampling.sample_exact(df, 123, F.col("h"))
    assert {r["id"] for r in kept.collect()} == {i for _, i in order[:123]}


def test_cold_both_error_on_empty_split(spark):
    with pytest.raises(ValueError, match="empty split"):
        splits.split_cold_both(relation(spark, n=6), "drug_id", "prot_id", (0.98, 0.01, 0.01))


@pytest.mark.parametrize("seed", [1, 2])
def test_optimised_cold_both(spark, seed):
    rel = relation(spark, n=600, seed=seed).cache()
    ratio = (0.5, 0.2, 0.3)
    plain = splits.split_cold_both(rel, "drug_id", "prot_id", ratio, seed, check=False)
    best = coldfull.optimise_cold_both(rel, ratio=ratio, seed=seed, attempts=1).cache()
    assert best.count() == 600
    used = best.where("split <> 'unused'")
    assert used.count() >= plain.where("split <> 'unused'").count()
    for side in ("drug_id", "prot_id"):
        assert used.groupBy(side).agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_swap_moves_equally_many_with_the_best_gain(spark):
    rows = [("a", "train", 0, 9, 0), ("b", "train", 0, 5, 0), ("c", "train", 3, 0, 0), ("x", "val", 4, 1, 0), ("y", "val", 0, 2, 0), ("z", "test", 0, 0, 1)]
    counts = spark.createDataFrame([("1", *r) for r in rows], "seed string, e string, s string, n_train long, n_val long, n_test long")
    out, changed = coldfull.improve_side(counts, "e")
    got = {r["e"]: r["s"] for r in out.collect()}
    assert changed and got == {"a": "val", "b": "train", "c": "train", "x": "train", "y": "val", "z": "test"}


def test_strategies(spark):
    rel = relation(spark, n=500).cache()
    for strategy in ("warm", "cold_drug", "cold_target", "cold_full"):
        out = splits.split_relation(rel, strategy, F.col("row_key"), ratio=(0.5, 0.2, 0.3), balanced=True, attempts=1)
        per = out.groupBy("split").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
        assert len(per) == 3 and all(r["n"] <= 2 * r["p"] for r in per)


@pytest.mark.parametrize("entity, other", [("prot_id", "drug_id"), ("drug_id", "prot_id")])
def test_repeats_are_profiled_as_rows_of_every_seed(spark, entity, other):
    """Missing ids and labels included; no plan repeats the rows for the seeds."""
    lines = [(None if i % 41 == 0 else i % 13, None if i % 37 == 0 else i % 7 * 3 + i % 2, None if i % 11 == 0 else i % 3 % 2) for i in range(600)]
    rel = spark.createDataFrame(lines, "drug_id int, prot_id int, label int")
    seeds = list(range(42, 60))
    each = F.explode(F.array(*[F.lit(s) for s in seeds]))
    by = {"seed": F.col("seed"), "group_cols": ["seed"], "ratio": (0.5, 0.2, 0.3)}
    want = summary.profile(splits.split_cold(rel.withColumn("seed", each), entity, **by), ["seed", "split"])
    sides = splits.split_cold(rel.select(entity).distinct().withColumn("seed", each), entity, **by)
    got = summary.profile_repeats(rel, sides, entity, other, seeds)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
