"""The given tables seen as interaction data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.hashing import row_key
from pairloom.session import spread

SEED = 42


# The larger tables, with a key to spread them by where they are one small file.
SPREAD = {"lineitem": "l_orderkey", "documents": "doc_id", "orders": "o_orderkey", "events": "event_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = scan(spark, sf_dir, name)
    return spread(df, SPREAD[name]) if name in SPREAD else df


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def relation(spark: SparkSession, sf_dir: str, positive: Column | None = None, *extra: Column) -> DataFrame:
    """Order lines as pairs: part and supplier, positive when returned."""
    positive = F.col("l_returnflag") == "R" if positive is None else positive
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("drug_id"),
        F.col("l_suppkey").alias("prot_id"),
        positive.cast("int").alias("label"),
        row_key(*LINE_KEY).alias("row_key"),
        *extra,
    )


def rare_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))


ROW_KEY_SQL = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
REL_SQL = f"""rel AS (
  SELECT l_partkey AS drug_id, l_suppkey AS prot_id,
         CAST(l_returnflag = 'R' AS INTEGER) AS label, {ROW_KEY_SQL} AS row_key, l_linenumber, l_orderkey
  FROM lineitem)"""
RARE_SQL = f"""rel AS (
  SELECT l_partkey AS drug_id, l_suppkey AS prot_id,
         CAST(l_returnflag = 'R' AND l_quantity > 45 AS INTEGER) AS label, {ROW_KEY_SQL} AS row_key
  FROM lineitem)"""


def split_sql(name: str, source: str, key: str, seed: str = "'42:'", ratio: tuple = (0.79, 0.01, 0.2)) -> str:
    """CTE ``name(key, split)`` over the distinct keys of ``source``."""
    _, val, test = ratio
    return f"""{name}_n AS (
  SELECT count(*) AS n, ceil({test}::DOUBLE * count(*)) AS t FROM (SELECT DISTINCT {key} FROM {source})),
{name} AS (
  SELECT {key}, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil({val}::DOUBLE * (n - t)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT {key}, row_number() OVER (ORDER BY md5({seed} || {key})) AS r
        FROM (SELECT DISTINCT {key} FROM {source})) CROSS JOIN {name}_n)"""


def row_split_sql(name: str, source: str, ratio: tuple = (0.79, 0.01, 0.2)) -> str:
    """CTE with the rows of ``source`` and their ``split``, drawn by row key."""
    _, val, test = ratio
    return f"""{name} AS (
  SELECT * EXCLUDE (r, n, t), CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil({val}::DOUBLE * (n - t)) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key)) AS r, count(*) OVER () AS n,
          ceil({test}::DOUBLE * count(*) OVER ()) AS t FROM {source}))"""


def balance_sql(name: str, source: str, ratio: int) -> str:
    """CTE with all positives and at most ``ratio`` negatives each, per split."""
    return f"""{name} AS (
  SELECT * EXCLUDE (rn, p) FROM (
    SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5('42:' || row_key)) AS rn,
           sum(label) OVER (PARTITION BY split) AS p
    FROM {source} WHERE split <> 'unused')
  WHERE label = 1 OR rn <= {ratio} * p)"""


def links(rel: DataFrame) -> DataFrame:
    return rel.where(F.col("label") == 1).select("drug_id", "prot_id").distinct()


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("drug_id"), F.col("p_name").alias("smiles"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("prot_id"), F.col("s_name").alias("seq"))


LINKS_SQL = "links AS (SELECT DISTINCT drug_id, prot_id FROM rel WHERE label = 1)"

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
NOT_RESIDUE = f"[^{RESIDUES}{RESIDUES.lower()}]"


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records: whole texts, a label only where there is one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    cleaned = F.upper(F.regexp_replace("text", NOT_RESIDUE, ""))
    return docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("doc_id").alias("source_row"),
        F.concat("source", F.lit(":"), "text").alias("smiles"),
        F.when(F.col("doc_id") % 2 == 0, cleaned).otherwise(F.col("text")).alias("sequence"),
        F.coalesce(F.col("quality").cast("string"), F.lit("?")).alias("activation"),
    )


TRIPLETS_SQL = f"""triplets AS (
  SELECT d.doc_id AS source_row, d.source || ':' || d.text AS smiles,
         CASE WHEN d.doc_id % 2 = 0 THEN upper(regexp_replace(d.text, '{NOT_RESIDUE}', '', 'g')) ELSE d.text END AS sequence,
         coalesce(CAST(l.quality AS VARCHAR), '?') AS activation
  FROM documents d LEFT JOIN labels l USING (doc_id)),
trimmed AS (
  SELECT source_row, regexp_replace(smiles, '^\\s+|\\s+$', '', 'g') AS smiles,
         regexp_replace(sequence, '^\\s+|\\s+$', '', 'g') AS sequence, activation FROM triplets),
checked AS (
  SELECT *, CASE WHEN smiles IS NULL OR smiles = '' THEN 'empty_smiles'
                 WHEN sequence IS NULL OR sequence = '' THEN 'empty_sequence'
                 WHEN activation NOT IN ('0', '1') THEN 'invalid_activation'
                 WHEN NOT regexp_full_match(sequence, '[{RESIDUES}]+') THEN 'non_canonical_sequence'
                 WHEN length(smiles) > 510 THEN 'smiles_too_long'
                 WHEN length(sequence) > 700 THEN 'sequence_too_long' END AS reason
  FROM trimmed)"""


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as accepted records; the order key is the dense row number."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_row"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("smiles"),
        F.col("o_orderpriority").alias("sequence"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )


RECORDS_SQL = """records AS (
  SELECT o_orderkey AS source_row, 'C' || o_custkey AS smiles, o_orderpriority AS sequence,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), F.col("label").alias("cluster")
    )


def entity_embeddings(spark: SparkSession, sf_dir: str, entities: DataFrame, ident: str) -> DataFrame:
    """A vector for every entity: vectors are dealt out by ``id % n``."""
    emb = embeddings(spark, sf_dir)
    slot = F.pmod(F.col(ident), F.lit(emb.count()))
    return entities.select(ident).distinct().join(emb.select("id", "emb"), slot == F.col("id")).select(ident, "emb")


EMB_SQL = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS emb, label AS cluster FROM embeddings)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: a purchase is positive, the value gives the score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("source_row"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.col("value") / (F.col("value") + 1.0)).alias("p"),
        "user_id",
        "value",
    )


SCORES_SQL = """scores AS (
  SELECT event_id AS source_row, CAST(event_type = 'purchase' AS INTEGER) AS y,
         value / (value + 1.0) AS p, user_id, value FROM events)"""
RANKED_SQL = """points AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scores GROUP BY p),
ranked AS (
  SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_above, coalesce(sum(n) OVER w, 0) AS n_above,
         sum(pos) OVER () AS n_pos, sum(n) OVER () AS n_all
  FROM points WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def long_vectors(df: DataFrame, vec: str, digits: int, *keys: str) -> DataFrame:
    """One row per vector element, rounded."""
    return df.select(*keys, F.posexplode(vec).alias("i", "x")).select(*keys, "i", F.round("x", digits).alias("x"))
