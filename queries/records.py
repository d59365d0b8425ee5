"""Checking, labelling and normalising records; positives and negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import scalars as S
from pairloom.functions.hashing import seeded_hash
from pairloom.operators import affinity, graph, normalize, pairs, similarity, summary, validate
from queries import query
from queries import bindings as B


@query(f"WITH {B.TRIPLETS_SQL} SELECT source_row, coalesce(reason, 'accepted') AS reason FROM checked")
def validate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.with_reason(B.triplets(spark, sf_dir))
    return checked.select("source_row", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query(f"WITH {B.TRIPLETS_SQL} SELECT reason, count(*) AS rows FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def validate_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reason_counts(validate.with_reason(B.triplets(spark, sf_dir)))


@query(f"""WITH {B.TRIPLETS_SQL}
SELECT source_row, smiles, sequence, CAST(activation AS INTEGER) AS label FROM checked WHERE reason IS NULL""")
def accepted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = validate.accepted(validate.with_reason(B.triplets(spark, sf_dir)))
    return good.select("source_row", "smiles", "sequence", "label")


@query(f"""WITH {B.RECORDS_SQL}, first AS (SELECT smiles, min(source_row) AS f FROM records GROUP BY smiles)
SELECT printf('drug_%06d', row_number() OVER (ORDER BY f) - 1) AS drug_id, smiles FROM first""")
def entity_ids_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = B.order_records(spark, sf_dir)
    return normalize.entity_table(records, "smiles", "source_row", "drug_id", "drug").select("drug_id", "smiles")


@query(f"""WITH {B.RECORDS_SQL},
d AS (SELECT smiles, printf('drug_%06d', row_number() OVER (ORDER BY min(source_row)) - 1) AS drug_id FROM records GROUP BY smiles),
t AS (SELECT sequence, printf('protein_%06d', row_number() OVER (ORDER BY min(source_row)) - 1) AS prot_id FROM records GROUP BY sequence)
SELECT drug_id, prot_id, label, source_row FROM records JOIN d USING (smiles) JOIN t USING (sequence)""")
def relation_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.to_tables(B.order_records(spark, sf_dir)).relation


MEASURE_SQL = f"""measured AS (
  SELECT l_partkey AS drug_id, 'P' || l_partkey AS smiles, l_suppkey AS prot_id, 'S' || l_suppkey AS seq,
         CASE WHEN l_linestatus = 'O' THEN '>' ELSE '<' END || CAST(l_extendedprice AS VARCHAR) AS "Kd",
         CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS VARCHAR) END AS "Ki", {B.ROW_KEY_SQL} AS row_key
  FROM lineitem),
means AS (
  SELECT drug_id, prot_id, avg(CAST(replace(replace("Kd", '<', ''), '>', '') AS DOUBLE)) AS label
  FROM measured GROUP BY drug_id, smiles, prot_id, seq HAVING label <= 1e7)"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("l_linestatus") == "O", ">").otherwise("<")
    return B.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("drug_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("smiles"),
        F.col("l_suppkey").alias("prot_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("seq"),
        F.concat(mark, F.col("l_extendedprice").cast("string")).alias("Kd"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("string")).alias("Ki"),
        F.lit(None).cast("string").alias("IC50"),
        F.lit(None).cast("string").alias("EC50"),
        B.row_key(*B.LINE_KEY).alias("row_key"),
    )


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = affinity.select_measure(_measured(spark, sf_dir), "Kd")
    return affinity.mean_affinity(chosen, ["drug_id", "smiles", "prot_id", "seq"])


@query(f"""WITH {MEASURE_SQL} SELECT drug_id, prot_id, CAST(label < 26881 AS INTEGER) AS label FROM means
WHERE label < 26881 OR label > 79194""")
def affinity_mean_deadzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.to_label(_means(spark, sf_dir), (26881, 79194)).select("drug_id", "prot_id", "label")


@query(f"WITH {MEASURE_SQL} SELECT drug_id, prot_id, CAST(label <= 53029 AS INTEGER) AS label FROM means")
def affinity_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.to_label(_means(spark, sf_dir), 53029).select("drug_id", "prot_id", "label")


@query(f"""WITH {MEASURE_SQL} SELECT drug_id, prot_id, round(-log10(label * 1e-9::DOUBLE), 5) AS p,
round(pow(10::DOUBLE, log10(label * 1e-9::DOUBLE)) / 1e-9::DOUBLE, 4) AS back FROM means""")
def affinity_plog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = affinity.to_label(_means(spark, sf_dir), None)
    return p.select(
        "drug_id", "prot_id", F.round("label", 5).alias("p"), F.round(S.p_to_nm(F.col("label")), 4).alias("back")
    )


@query(f"""WITH {MEASURE_SQL} SELECT row_key, "Ki" AS label FROM measured WHERE "Ki" IS NOT NULL""")
def affinity_select_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.select_measure(_measured(spark, sf_dir), "Ki").select("row_key", "label")


@query("""WITH x AS (SELECT d.doc_id, d.text, CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id END AS ident
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(
  last_value(ident IGNORE NULLS) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ident IGNORE NULLS) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) AS ident FROM x""")
def impute_ids_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = B.table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("ident"))
    return affinity.fill_ids(docs.join(known, "doc_id", "left"), "text", "ident", "doc_id").select("doc_id", "ident")


@query("""SELECT doc_id, lang, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def keep_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return normalize.keep_first(docs, ["text"], ["doc_id"]).select("doc_id", "lang", "source")


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text, ' '), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'custom' ELSE t END AS slug FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


# --- links, positives, negatives -------------------------------------------

ENTITIES_SQL = """d AS (SELECT p_partkey AS drug_id FROM part WHERE length(p_name) >= 9),
t AS (SELECT s_suppkey AS prot_id FROM supplier WHERE s_acctbal >= 0)"""


@query(f"""WITH {B.REL_SQL}, {B.LINKS_SQL}, {ENTITIES_SQL}
SELECT drug_id, prot_id FROM links WHERE drug_id IN (SELECT drug_id FROM d) AND prot_id IN (SELECT prot_id FROM t)""")
def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = B.drugs(spark, sf_dir).where(F.length("smiles") >= 9)
    right = B.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("prot_id"))
    return pairs.positives(B.links(B.relation(spark, sf_dir)), left, right)


@query(f"""WITH {B.RARE_SQL}, {B.LINKS_SQL}
SELECT p_partkey AS drug_id, p_name AS smiles FROM part WHERE p_partkey IN (SELECT drug_id FROM links)""")
def linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = B.links(B.rare_relation(spark, sf_dir))
    return pairs.linked_entities(B.drugs(spark, sf_dir), known, "drug_id").select("drug_id", "smiles")


@query(f"""WITH {B.REL_SQL}, {ENTITIES_SQL}
SELECT prot_id, count(*) AS rows FROM rel WHERE prot_id NOT IN (SELECT prot_id FROM t) GROUP BY prot_id""")
def unmapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = B.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("prot_id"))
    return pairs.unmapped(B.relation(spark, sf_dir), right, "prot_id")


@query(f"""WITH {B.REL_SQL}, {ENTITIES_SQL}
SELECT row_key, label FROM rel WHERE prot_id IN (SELECT prot_id FROM t)""")
def relation_known_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = B.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("prot_id"))
    return pairs.known_targets(B.relation(spark, sf_dir), right).select("row_key", "label")


GRID_SQL = f"""{B.REL_SQL}, {B.LINKS_SQL},
d AS (SELECT p_partkey AS drug_id, row_number() OVER (ORDER BY md5('42:' || p_partkey)) - 1 AS li FROM part),
t AS (SELECT s_suppkey AS prot_id, row_number() OVER (ORDER BY md5('42:right:' || s_suppkey)) - 1 AS ri FROM supplier),
known AS (SELECT li, ri FROM links JOIN d USING (drug_id) JOIN t USING (prot_id)),
free AS (SELECT li, ri, drug_id, prot_id FROM d CROSS JOIN t WHERE NOT EXISTS (
  SELECT 1 FROM known k WHERE k.li = d.li AND k.ri = t.ri))"""


@query(f"""WITH {GRID_SQL},
islands AS (SELECT drug_id, ri, ri - row_number() OVER (PARTITION BY drug_id ORDER BY ri) AS g FROM free)
SELECT drug_id, min(ri) AS lo, max(ri) AS hi FROM islands GROUP BY drug_id, g""")
def negatives_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = B.drugs(spark, sf_dir), B.targets(spark, sf_dir)
    cells = pairs.grid(B.links(B.relation(spark, sf_dir)), left, right, seed=B.SEED)
    return pairs.free_runs(cells).join(cells.left, "left_ix").select("drug_id", "lo", "hi")


@query(f"""WITH {GRID_SQL}, n AS (SELECT (SELECT count(*) FROM part) AS m, (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM links) AS k),
draws AS (SELECT range AS j FROM range(0, (SELECT 20 * k + 1000 FROM n))),
cells AS (SELECT ('0x' || substr(md5('42:' || j), 1, 15))::BIGINT % (m * n) AS c, min(j) AS j, any_value(n) AS w FROM draws CROSS JOIN n GROUP BY 1),
hits AS (SELECT drug_id, prot_id, row_number() OVER (ORDER BY j) AS r FROM cells JOIN free ON li = c // w AND ri = c % w)
SELECT drug_id, prot_id FROM hits WHERE r <= (SELECT k FROM n) AND (SELECT k FROM n) < (SELECT count(*) FROM free)
UNION ALL SELECT drug_id, prot_id FROM free WHERE (SELECT k FROM n) >= (SELECT count(*) FROM free)""")
def negatives_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = B.drugs(spark, sf_dir), B.targets(spark, sf_dir)
    return pairs.sample_negatives(B.links(B.relation(spark, sf_dir)), left, right, seed=B.SEED)


@query(f"""WITH {B.REL_SQL}, {B.LINKS_SQL},
d AS (SELECT p_partkey AS drug_id FROM part ORDER BY md5('42:' || p_partkey) LIMIT 64),
t AS (SELECT s_suppkey AS prot_id FROM supplier ORDER BY md5('42:right:' || s_suppkey) LIMIT 8)
SELECT drug_id, prot_id FROM links WHERE drug_id IN (SELECT drug_id FROM d) AND prot_id IN (SELECT prot_id FROM t)""")
def submatrix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample size is the operator's parameter."""
    known = B.links(B.relation(spark, sf_dir))
    return pairs.submatrix(known, B.drugs(spark, sf_dir), B.targets(spark, sf_dir), 64, 8, seed=B.SEED)


# --- counts ----------------------------------------------------------------


@query(f"WITH {B.REL_SQL} SELECT label, count(*) AS rows FROM rel GROUP BY label")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.class_histogram(B.relation(spark, sf_dir))


@query(f"""WITH {B.REL_SQL}, s AS (SELECT count(DISTINCT drug_id) AS drugs, count(DISTINCT prot_id) AS targets,
  count(*) FILTER (label = 1) AS interactions FROM rel)
SELECT drugs, targets, interactions, round(interactions / (drugs::DOUBLE * targets), 6) AS density FROM s""")
def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = summary.entity_stats(B.relation(spark, sf_dir))
    return stats.withColumn("density", F.round("density", 6))


@query(f"WITH {B.REL_SQL} SELECT drug_id, prot_id, count(*) AS n FROM rel GROUP BY drug_id, prot_id")
def pair_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.contingency(B.relation(spark, sf_dir))


@query("""SELECT l_partkey AS drug_id, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey""")
def contingency_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("drug_id"), "l_returnflag")
    wide = summary.contingency_wide(lines, "drug_id", "l_returnflag", ["A", "N", "R"])
    return wide.select("drug_id", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


# --- tokens ----------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents),
g AS (SELECT token, count(*) AS n, min(doc_id * 1000000000 + pos) AS f FROM c WHERE token <> '' GROUP BY token)
SELECT token, n, CAST(row_number() OVER (ORDER BY f) + 1 AS INTEGER) AS ix FROM g""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.vocabulary(B.table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS token, generate_subscripts(string_split(p_name, ''), 1) AS pos FROM part),
g AS (SELECT token, min(p_partkey * 1000 + pos) AS f FROM c GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY f) + 1 AS ix FROM g)
SELECT p_partkey AS drug_id, string_agg(CAST(ix AS VARCHAR), ' ' ORDER BY pos) AS codes FROM c JOIN v USING (token) GROUP BY p_partkey""")
def token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = B.drugs(spark, sf_dir)
    vocab = similarity.vocabulary(parts, "smiles", "drug_id")
    return similarity.encode_tokens(parts, "drug_id", "smiles", vocab)


@query(f"""WITH {B.RARE_SQL}, {B.LINKS_SQL},
picked AS (SELECT *, md5('42:' || drug_id || ':' || prot_id) AS o,
             row_number() OVER (PARTITION BY prot_id ORDER BY md5('42:' || drug_id || ':' || prot_id)) AS rn FROM links),
tokens AS (SELECT prot_id, o, string_split(p_name, ' ') AS tokens FROM picked JOIN part ON p_partkey = drug_id WHERE rn <= 5),
lists AS (SELECT prot_id, list(tokens ORDER BY o) AS l FROM tokens GROUP BY prot_id)
SELECT prot_id, array_to_string(flatten(l), ' ') AS tokens FROM lists WHERE len(flatten(l)) > 1 AND len(flatten(l)) < 100""")
def capped_neighbour_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = B.links(B.rare_relation(spark, sf_dir))
    tokens = B.drugs(spark, sf_dir).select("drug_id", F.split("smiles", " ").alias("tokens"))
    order = seeded_hash(B.SEED, B.row_key("drug_id", "prot_id"))
    lists = graph.capped_neighbour_lists(known, tokens, "prot_id", "drug_id", 5, order, min_len=1, max_len=100)
    return lists.select("prot_id", F.array_join("tokens", " ").alias("tokens"))
