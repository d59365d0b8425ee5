from __future__ import annotations

import random

import pytest

from pairloom.operators import affinity, normalize


def brute_fill(rows):
    """Forward, then backward, inside each group in row order."""
    out = {}
    by_group = {}
    for row, group, ident in sorted(rows):
        by_group.setdefault(group, []).append((row, ident))
    for group, items in by_group.items():
        last, filled = None, []
        for row, ident in items:
            last = ident if ident is not None else last
            filled.append([row, last])
        following = None
        for pair in reversed(filled):
            if pair[1] is None:
                pair[1] = following
            following = pair[1]
        for row, ident in filled:
            out[row] = None if group is None else ident
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fill_equals_brute_force_with_a_hot_group(spark, seed):
    rng = random.Random(seed)
    rows = [
        (i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), rng.choice([None, None, f"id{i}"]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "row long, g string, ident string")
    got = {r["row"]: r["ident"] for r in affinity.fill_ids(df, "g", "ident", "row", block=16).collect()}
    assert got == brute_fill(rows)


def test_measure_mean_and_labels(spark):
    df = spark.createDataFrame(
        [("d1", "t1", ">10", None, None, "5"), ("d1", "t1", "<30", None, None, None), ("d2", "t1", "65", None, None, None),
         ("d3", "t1", "200", None, None, None), ("d4", "t1", "2e7", None, None, None), (None, "t1", "1", None, None, None),
         ("d5", "t1", None, "7", None, None)],
        "d string, t string, Kd string, Ki string, IC50 string, EC50 string",
    )
    chosen = affinity.select_measure(df, "Kd")
    assert chosen.columns == ["d", "t", "label"]
    mean = affinity.mean_affinity(chosen, ["d", "t"])
    assert {r["d"]: r["label"] for r in mean.collect()} == {"d1": 20.0, "d2": 65.0, "d3": 200.0}
    zone = affinity.to_label(mean)
    assert {r["d"]: r["label"] for r in zone.collect()} == {"d1": 1, "d3": 0}
    cut = affinity.to_label(mean, 65)
    assert {r["d"]: r["label"] for r in cut.collect()} == {"d1": 1, "d2": 1, "d3": 0}
    with pytest.raises(ValueError, match="unknown measure"):
        affinity.select_measure(df, "pKd")


def test_bad_numbers(spark):
    df = spark.createDataFrame([("a", "x1"), ("a", "4")], "k string, label string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        affinity.mean_affinity(df, ["k"]).collect()
    assert affinity.mean_affinity(df, ["k"], strict=False).collect() == [("a", 4.0)]


def test_keep_first_and_translate(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, None)], "key string, row int, v string")
    got = normalize.keep_first(df, ["key"], ["row"]).collect()
    assert sorted((r["key"], r["row"], r["v"]) for r in got) == [("k", 1, "a"), ("l", 3, None)]
    mapping = spark.createDataFrame([("k", "K!")], "s string, t string")
    out = normalize.translate_ids(df, "key", mapping, "s", "t")
    assert out.columns == df.columns
    assert sorted((r["key"] or "", r["row"]) for r in out.collect()) == [("", 3), ("K!", 1), ("K!", 2)]


def test_tables_number_in_order_of_appearance(spark):
    rows = [(i, f"s{(i * 7) % 5}", f"q{i % 3}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "source_row long, smiles string, sequence string, label int")
    tables = normalize.to_tables(df)
    seen = list(dict.fromkeys(r[1] for r in rows))
    assert {r["smiles"]: r["drug_id"] for r in tables.left.collect()} == {v: f"drug_{i:06d}" for i, v in enumerate(seen)}
    relation = {r["source_row"]: (r["drug_id"], r["prot_id"], r["label"]) for r in tables.relation.collect()}
    assert len(relation) == 40
    assert relation[3] == (f"drug_{seen.index('s1'):06d}", "protein_000000", 1)


def test_fill_moves_no_row_where_no_id_is_missing(spark):
    from pyspark.sql import functions as F

    from pairloom.operators import affinity

    rows = spark.createDataFrame([(i, f"g{i % 3}" if i % 5 else None, f"id{i}", "long text") for i in range(40)], "row long, seq string, target_id string, rest string")
    filled = affinity.fill_ids(rows, "seq", "target_id", "row")
    assert "Exchange" not in filled._jdf.queryExecution().executedPlan().toString()
    assert {r["row"]: r["target_id"] for r in filled.collect()} == {i: f"id{i}" if i % 5 else None for i in range(40)}
    some = rows.withColumn("target_id", F.when(F.col("row") % 4 != 2, F.col("target_id")))
    got = {r["row"]: (r["target_id"], r["rest"]) for r in affinity.fill_ids(some, "seq", "target_id", "row", block=8).collect()}
    for i in range(40):
        own = [j for j in range(40) if j % 3 == i % 3 and j % 5 and j % 4 != 2]
        before = [j for j in own if j <= i]
        assert got[i] == ((f"id{before[-1] if before else own[0]}") if i % 5 else None, "long text")
