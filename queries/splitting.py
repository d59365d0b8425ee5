"""Splits, balancing, batches and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.hashing import row_key, seeded_hash
from pairloom.operators import coldfull, normalize, sampling, splits, summary
from pairloom.session import materialize
from queries import query
from queries import bindings as B


PROFILE_SQL = """SELECT split, count(*) AS rows, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) AS negatives, count(DISTINCT drug_id) AS drugs, count(DISTINCT prot_id) AS targets"""


@query(f"""WITH {B.REL_SQL}, {B.split_sql('ds', 'rel', 'drug_id')},
s AS (SELECT rel.*, split FROM rel JOIN ds USING (drug_id)), {B.balance_sql('b', 's', 1)}
{PROFILE_SQL} FROM b GROUP BY split""")
def flagship_cold_drug_balanced_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = B.relation(spark, sf_dir)
    split = splits.split_cold(rel, "drug_id", seed=B.SEED)
    return summary.profile(splits.balance(split, F.col("row_key"), 1, B.SEED))


@query(f"WITH {B.REL_SQL}, {B.row_split_sql('s', 'rel')} SELECT row_key, split FROM s")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_rows(B.relation(spark, sf_dir), F.col("row_key"), seed=B.SEED).select("row_key", "split")


@query(f"WITH {B.REL_SQL}, {B.row_split_sql('s', 'rel', (0.65, 0.15, 0.2))} SELECT row_key, split FROM s")
def split_random_plain_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = B.relation(spark, sf_dir)
    return splits.split_rows(rel, F.col("row_key"), splits.RATIO_PLAIN, B.SEED).select("row_key", "split")


@query(f"WITH {B.REL_SQL}, {B.split_sql('s', 'rel', 'drug_id')} SELECT row_key, split FROM rel JOIN s USING (drug_id)")
def split_cold_drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_cold(B.relation(spark, sf_dir), "drug_id", seed=B.SEED).select("row_key", "split")


@query(f"WITH {B.REL_SQL}, {B.split_sql('s', 'rel', 'prot_id')} SELECT row_key, split FROM rel JOIN s USING (prot_id)")
def split_cold_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_cold(B.relation(spark, sf_dir), "prot_id", seed=B.SEED).select("row_key", "split")


FULL_RATIO = (0.5, 0.2, 0.3)


@query(f"""WITH {B.REL_SQL}, {B.split_sql('ds', 'rel', 'drug_id', ratio=FULL_RATIO)},
{B.split_sql('ts', 'rel', 'prot_id', seed="'42:right:'", ratio=FULL_RATIO)}
SELECT row_key, CASE WHEN ds.split = ts.split THEN ds.split ELSE 'unused' END AS split
FROM rel JOIN ds USING (drug_id) JOIN ts USING (prot_id)""")
def split_cold_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = B.relation(spark, sf_dir)
    return splits.split_cold_both(rel, "drug_id", "prot_id", FULL_RATIO, B.SEED).select("row_key", "split")


@query()
def split_cold_full_optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = B.relation(spark, sf_dir)
    split = coldfull.optimise_cold_both(rel, ratio=FULL_RATIO, seed=B.SEED)
    return summary.profile(split)


@query(f"""WITH {B.REL_SQL} SELECT row_key, CASE 1 + l_linenumber % 3 WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split
FROM rel WHERE prot_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) AND drug_id IN (SELECT p_partkey FROM part WHERE length(p_name) >= 9)""")
def split_presplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicator = (1 + F.col("l_linenumber") % 3).cast("int").alias("indicator")
    rel = B.relation(spark, sf_dir, None, indicator)
    left = B.drugs(spark, sf_dir).where(F.length("smiles") >= 9)
    right = B.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("prot_id"))
    known = splits.drop_unmapped(rel, left, right, "drug_id", "prot_id")
    return splits.split_by_indicator(known).select("row_key", "split")


@query(f"""WITH {B.REL_SQL}, r AS (SELECT row_key, CASE WHEN l_linenumber % 5 = 0 THEN 3 ELSE 1 END AS i FROM rel)
SELECT row_key, CASE WHEN i = 1 AND substr(md5('42:' || row_key), 1, 8) < '028f5c28' THEN 2 ELSE i END AS indicator FROM r""")
def val_carveout(spark: SparkSession, sf_dir: str) -> DataFrame:
    indicator = F.when(F.col("l_linenumber") % 5 == 0, 3).otherwise(1).alias("indicator")
    rel = B.relation(spark, sf_dir, None, indicator)
    return splits.carve_validation(rel, F.col("row_key"), 0.01, B.SEED).select("row_key", "indicator")


@query(f"""WITH {B.REL_SQL}, seeds AS (SELECT unnest([42, 43, 44, 45, 46]) AS seed),
e AS (SELECT seed, prot_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || prot_id)) AS r,
        count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT prot_id FROM rel) CROSS JOIN seeds),
es AS (SELECT seed, prot_id, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test'
         WHEN r <= ceil(0.2::DOUBLE * n) + ceil(0.01::DOUBLE * (n - ceil(0.2::DOUBLE * n))) THEN 'val' ELSE 'train' END AS split FROM e)
SELECT CAST(seed AS INTEGER) AS seed, split, count(*) AS rows, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) AS negatives, count(DISTINCT drug_id) AS drugs, count(DISTINCT prot_id) AS targets
FROM rel JOIN es USING (prot_id) GROUP BY seed, split""")
def split_many_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats as a column of the entities: one job splits the relation for every seed."""
    seeds = [B.SEED + i for i in range(5)]
    rel = B.relation(spark, sf_dir)
    targets = materialize(rel.select("prot_id").distinct(), "targets").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    split = splits.split_cold(targets, "prot_id", seed=F.col("seed"), group_cols=["seed"])
    return summary.profile_repeats(rel, materialize(split, "target-split"), "prot_id", "drug_id", seeds)


def _balanced(spark: SparkSession, sf_dir: str, ratio: int) -> DataFrame:
    rel = B.rare_relation(spark, sf_dir)
    split = splits.split_rows(rel, F.col("row_key"), seed=B.SEED)
    return splits.balance(split, F.col("row_key"), ratio, B.SEED).select("row_key", "split", "label")


def _balanced_sql(ratio: int) -> str:
    return f"""WITH {B.RARE_SQL}, {B.row_split_sql('s', 'rel')},
{B.balance_sql('b', 's', ratio)}
SELECT row_key, split, label FROM b"""


@query(_balanced_sql(1))
def balance_1_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balanced(spark, sf_dir, 1)


@query(_balanced_sql(10))
def balance_1_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balanced(spark, sf_dir, 10)


@query(f"""WITH {B.REL_SQL}, {B.split_sql('ts', 'rel', 'prot_id')}
SELECT split, max(label) = 1 AND min(label) = 0 AS both_classes FROM rel JOIN ts USING (prot_id) GROUP BY split""")
def both_classes_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.both_classes(splits.split_cold(B.relation(spark, sf_dir), "prot_id", seed=B.SEED))


BATCH_SQL = f"""{B.REL_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key)) - 1 AS pos FROM rel),
b AS (SELECT *, pos // 128 AS batch_id FROM p WHERE pos // 128 < (SELECT count(*) // 128 FROM rel))"""


def _batches(spark: SparkSession, sf_dir: str, drop_last: bool = True) -> DataFrame:
    rel = B.relation(spark, sf_dir)
    total = F.lit(rel.count())
    ordered = sampling.shuffled_position(rel, seeded_hash(B.SEED, "row_key"))
    return sampling.batches(ordered, F.col("pos"), 128, drop_last, total)


@query(f"WITH {BATCH_SQL} SELECT row_key, pos, batch_id FROM b")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("row_key", "pos", "batch_id")


ALL_BATCHES_SQL = f"""{B.REL_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key)) - 1 AS pos FROM rel),
b AS (SELECT *, pos // 128 AS batch_id FROM p)"""


@query(f"""WITH {ALL_BATCHES_SQL}, f AS (SELECT batch_id, drug_id, min(pos) AS p FROM b GROUP BY batch_id, drug_id)
SELECT batch_id, drug_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY p) - 1 AS INTEGER) AS code FROM f""")
def group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.group_dictionary(_batches(spark, sf_dir, drop_last=False), "batch_id", "drug_id", "pos")


@query(f"""WITH {B.RECORDS_SQL}, {B.split_sql('s', 'records', 'source_row')},
d AS (SELECT smiles, printf('drug_%06d', row_number() OVER (ORDER BY min(source_row)) - 1) AS drug_id FROM records GROUP BY smiles),
t AS (SELECT sequence, printf('protein_%06d', row_number() OVER (ORDER BY min(source_row)) - 1) AS prot_id FROM records GROUP BY sequence)
SELECT source_row, split, drug_id, prot_id, label FROM records JOIN s USING (source_row) JOIN d USING (smiles) JOIN t USING (sequence)""")
def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = normalize.to_tables(B.order_records(spark, sf_dir)).relation
    split = splits.split_rows(rel, row_key("source_row"), seed=B.SEED)
    return split.select("source_row", "split", "drug_id", "prot_id", "label")


@query("""SELECT orders.* EXCLUDE (o_orderdate) FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey)) <= 100""")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample size is the operator's parameter."""
    orders = B.table(spark, sf_dir, "orders").drop("o_orderdate")
    return sampling.sample_exact(orders, 100, seeded_hash(B.SEED, "o_orderkey"), ["o_orderpriority"])
