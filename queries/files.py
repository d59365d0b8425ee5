"""File formats: the given tables written in each input format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import validate
from pairloom.plans import scenarios
from pairloom.session import scratch_path
from pairloom.sources import readers, sinks
from queries import query
from queries import bindings as B
from queries.scoring import EXPORT_SQL, LOG_SQL, export, run_logs

FLAT_SQL = """flat AS (SELECT doc_id, source || ':' || lang AS smiles, regexp_replace(text, '\\s+', ' ', 'g') AS sequence,
  CAST(n_chars % 2 AS VARCHAR) AS activation FROM documents)"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as single-line records."""
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws(":", "source", "lang").alias("smiles"),
        F.regexp_replace("text", r"\s+", " ").alias("sequence"),
        (F.col("n_chars") % 2).cast("string").alias("activation"),
    )


def _ordered(df: DataFrame, key: str) -> DataFrame:
    """Sorted over files, so that file order is key order."""
    return df.orderBy(key).drop(key)


@query(f"WITH {FLAT_SQL} SELECT doc_id AS source_row, smiles, sequence, activation FROM flat")
def triplets_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "triplets") + ".csv"
    rows = _ordered(_flat(spark, sf_dir), "doc_id").toDF(" SMILES ", "Sequence", "ACTIVATION")
    sinks.write_delimited(rows, path, "|")
    return readers.read_triplets(spark, path).select("source_row", "smiles", "sequence", "activation")


@query(f"WITH {FLAT_SQL} SELECT doc_id AS source_row, smiles, sequence, activation FROM flat")
def triplets_csv_headless(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "triplets") + ".csv"
    rows = _ordered(_flat(spark, sf_dir), "doc_id")
    rows.write.csv(path, sep=";", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = readers.read_triplets(spark, path, delimiter=";", has_header=False)
    return read.select("source_row", "smiles", "sequence", "activation")


@query(f"WITH {FLAT_SQL} SELECT doc_id AS source_row, smiles, sequence, activation FROM flat")
def triplets_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "triplets") + ".json"
    _ordered(_flat(spark, sf_dir), "doc_id").write.json(path)
    read = readers.read_triplets(spark, path)
    return read.select("source_row", "smiles", "sequence", "activation")


@query("SELECT source || ':' || lang || ':' || doc_id AS smiles, text AS sequence, CAST(n_chars % 2 AS VARCHAR) AS activation FROM documents")
def triplets_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are, with line breaks inside quotes."""
    path = scratch_path(spark, "triplets") + ".csv"
    rows = B.table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "source", "lang", "doc_id").alias("smiles"), F.col("text").alias("sequence"), (F.col("n_chars") % 2).alias("activation")
    )
    sinks.write_delimited(rows, path, "|")
    return readers.read_triplets(spark, path, number_rows=False).select("smiles", "sequence", "activation")


@query(f"WITH {FLAT_SQL} SELECT doc_id AS source_row, smiles, sequence, activation FROM flat")
def triplets_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "triplets") + ".parquet"
    _ordered(_flat(spark, sf_dir), "doc_id").write.parquet(path)
    return readers.read_triplets(spark, path).select("source_row", "smiles", "sequence", "activation")


@query("""SELECT l_partkey AS compound, 'C' || l_partkey AS smiles, 'T' || l_suppkey AS target_id, CAST(l_extendedprice AS VARCHAR) AS "Kd",
  CASE WHEN l_linenumber <> 1 THEN CAST(l_quantity AS VARCHAR) END AS "EC50" FROM lineitem WHERE l_linenumber <> 7""")
def affinity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a wide file; line number 7 has a field too many, 1 an empty one."""
    line = B.table(spark, sf_dir, "lineitem")

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    values = {
        1: F.concat(F.lit("C"), text("l_partkey")),
        10: text("l_extendedprice"),
        11: F.when(F.col("l_linenumber") != 1, text("l_quantity")).otherwise(""),
        29: text("l_partkey"),
        42: F.concat(F.lit("T"), text("l_suppkey")),
    }
    fields = [values.get(i, F.lit("x")) for i in range(43)]
    rows = F.concat(F.concat_ws("\t", *fields), F.when(F.col("l_linenumber") == 7, "\textra").otherwise(""))
    header = spark.createDataFrame([("\t".join(f"h{i}" for i in range(43)),)], "value string")
    path, header_path = scratch_path(spark, "affinity"), scratch_path(spark, "affinity-header")
    header.write.text(header_path)
    line.select(rows.alias("value")).write.text(path)
    read = readers.read_affinity(spark, path, header_path=header_path)
    return read.select(
        F.col("compound_id").cast("bigint").alias("compound"), "smiles", "target_id", "Kd", "EC50"
    )


@query("SELECT CAST(p_partkey AS VARCHAR) AS drug_id, repeat(p_name || '.', 3) AS smiles FROM part WHERE length(repeat(p_name || '.', 3)) >= 30")
def sdf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(
        F.lit("mol\n  0  0\nM  END\n> <DATABASE_ID>\n"), F.col("p_partkey").cast("string"),
        F.lit("\n\n> <SMILES>\n"), F.repeat(F.concat("p_name", F.lit(".")), 3), F.lit("\n\n$$$$"),
    )
    path = scratch_path(spark, "structures")
    B.table(spark, sf_dir, "part").select(record.alias("value")).write.text(path)
    return readers.read_sdf(spark, path)


@query(r"""SELECT 'S' || s_suppkey AS prot_id, regexp_replace(s_name, '\s', '', 'g') || 'TAIL' AS seq FROM supplier""")
def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    proteins = B.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("db|S"), F.col("s_suppkey").cast("string"), F.lit("|name text")).alias("prot_id"),
        F.concat("s_name", F.lit("\nTAIL")).alias("seq"),
    )
    sinks.write_fasta(proteins, path)
    return readers.read_fasta(spark, path)


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS drug_id, CAST(l_suppkey AS VARCHAR) AS prot_id FROM lineitem")
def link_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "links")
    links = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("DrugBank ID"), F.col("l_returnflag").alias("Type"), F.col("l_suppkey").alias("UniProt ID")
    )
    sinks.write_delimited(links, path, ",")
    return readers.read_links(spark, path)


@query("""SELECT CAST(l_partkey AS VARCHAR) AS drug_id, CAST(l_suppkey AS VARCHAR) AS prot_id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  CAST(l_orderkey % 10 AS INTEGER) AS fold, CASE WHEN l_linenumber = 3 THEN 'test' ELSE 'train' END AS role FROM lineitem""")
def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "folds")
    role = F.when(F.col("l_linenumber") == 3, "test").otherwise("train")
    name = F.concat(role, F.lit("_fold_"), (F.col("l_orderkey") % 10 + 1).cast("string"), F.lit(".csv"))
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("head"), F.lit("x").alias("relation"), F.col("l_suppkey").alias("tail"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), name.alias("file"),
    )
    lines.write.partitionBy("file").csv(path, header=True)
    return readers.read_folds(spark, path)


@query("SELECT p_name AS name, p_partkey AS source_row FROM part")
def name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "names")
    _ordered(B.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").write.text(path)
    return readers.read_names(spark, path)


@query("SELECT doc_id, lang, doc_id AS source_row FROM documents")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.with_source_row(B.scan(spark, sf_dir, "documents").select("doc_id", "lang"))


@query(f"WITH {LOG_SQL} SELECT run, auc, auprc FROM parsed")
def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs as records of a table, parsed."""
    path = scratch_path(spark, "logs")
    run_logs(spark, sf_dir).select("run", "log").write.json(path)
    read = spark.read.schema("run long, log string").json(path)
    return readers.log_metrics(read, "log").select("run", "auc", "auprc")


@query("""WITH l AS (SELECT o_custkey AS g, o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS a,
  lpad(CAST(o_custkey * 104729 % 1000000 AS VARCHAR), 6, '0') AS p FROM orders),
last AS (SELECT g, arg_max(a, o_orderkey) AS a, arg_max(p, o_orderkey) AS p FROM l GROUP BY g)
SELECT 'd' || g % 2 AS dataset, 's' || g % 3 AS scenario_key, 'run_' || g AS run_tag,
  CASE WHEN g % 7 <> 0 THEN CAST('0.' || a AS DOUBLE) END AS auc, CASE WHEN g % 7 <> 0 THEN CAST('0.' || p AS DOUBLE) END AS auprc FROM last""")
def run_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file per customer with an epoch per order, in ``<dataset>/<scenario>`` folders, found and read by path."""
    root, key = scratch_path(spark, "log-files"), F.col("o_orderkey")
    orders = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("g"), "o_orderkey",
        F.concat(
            F.lit("Test AUC: 0."), F.lpad((key * 7919 % 1000000).cast("string"), 6, "0"),
            F.lit("\nTest AUPRC: 0."), F.lpad((F.col("o_custkey") * 104729 % 1000000).cast("string"), 6, "0"),
        ).alias("epoch"),
    )
    epochs = F.array_sort(F.collect_list(F.struct("o_orderkey", "epoch")))
    logs = orders.groupBy("g").agg(F.array_join(F.transform(epochs, lambda e: e["epoch"]), "\n").alias("log"))
    named = logs.select(
        F.concat(F.lit("d"), F.col("g") % 2).alias("dataset"), F.concat(F.lit("s"), F.col("g") % 3).alias("scenario_key"),
        F.concat(F.lit("run_"), "g").alias("run_tag"),
        F.when(F.col("g") % 7 == 0, "stopped early").otherwise(F.col("log")).alias("log"),
    )
    sinks.write_run_logs(spark, named, root)
    return readers.log_metrics(readers.read_run_logs(spark, root), "log").drop("log")


@query(f"WITH {EXPORT_SQL} SELECT split, excluded_reason, count(*) AS rows, count(predicted_label) AS predicted FROM export GROUP BY split, excluded_reason")
def export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.write_export(export(spark, sf_dir), scratch_path(spark, "export"), json=True)
    read = spark.read.schema("split string, excluded_reason string, predicted_label int").json(out["json"])
    return read.groupBy("split", "excluded_reason").agg(
        F.count(F.lit(1)).alias("rows"), F.count("predicted_label").alias("predicted")
    )


@query(f"WITH {B.TRIPLETS_SQL} SELECT reason, count(*) AS rows FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def rejected_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.write_rejected(validate.with_reason(B.triplets(spark, sf_dir)), scratch_path(spark, "rejected"))
    read = spark.read.schema("reasons map<string, bigint>").json(out["summary"])
    return read.select(F.explode("reasons").alias("reason", "rows"))


@query("SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed and written the first time, read the second."""
    path = scratch_path(spark, "cache")
    readers.cached(spark, path, lambda: B.embeddings(spark, sf_dir).select("id", "emb"))

    def never() -> DataFrame:
        raise AssertionError("the cache should have been used")

    return readers.cached(spark, path, never).select("id", F.size("emb").alias("width"))


@query("""SELECT o_orderpriority AS dataset, o_orderstatus AS scenario, o_orderstatus AS scenario_key, CAST(count(*) AS VARCHAR) AS runs,
  count(*) > 1 AS repeated FROM orders GROUP BY 1, 2""")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("scenario"),
        F.col("o_orderstatus").alias("scenario_key"), F.col("o_orderkey").cast("string").alias("run_tag"),
        F.lit("p.yaml").alias("best_param_name"), F.col("o_totalprice").alias("auc"), F.col("o_totalprice").alias("auprc"),
    )
    planned = runs.drop("auc", "auprc")
    summarised = scenarios.summarise(planned, runs.select("dataset", "scenario_key", "run_tag", "auc", "auprc"))
    path = sinks.write_summary(summarised, scratch_path(spark, "summary"))
    read = spark.read.csv(path, header=True)
    return read.select("dataset", "scenario", "scenario_key", "runs", (F.col("std_auc").cast("double") > 0).alias("repeated"))
