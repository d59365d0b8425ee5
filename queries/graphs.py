"""Vectors, similarity graphs and aggregation over neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import banded, graph, neighbours, similarity, splits
from queries import query
from queries import bindings as B

BATCH = 128
DIM = 64


def batch_edges(spark: SparkSession, sf_dir: str, tau: float) -> DataFrame:
    emb = B.embeddings(spark, sf_dir).withColumn("batch_id", F.floor(F.col("id") / BATCH))
    return graph.eps_edges(emb, tau, ["batch_id"])


def _edges_sql(tau: float) -> str:
    return f"""{B.EMB_SQL},
edges AS (SELECT a.id // {BATCH} AS batch_id, a.id AS src, b.id AS dst, array_distance(a.emb, b.emb) AS dist
  FROM emb a JOIN emb b ON a.id // {BATCH} = b.id // {BATCH} AND a.id < b.id WHERE array_distance(a.emb, b.emb) < {tau}),
both_ways AS (SELECT src, dst, dist FROM edges UNION ALL SELECT dst, src, dist FROM edges)"""


@query(f"WITH {_edges_sql(1.2)} SELECT batch_id, src, dst, round(dist, 5) AS dist FROM edges")
def eps_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_edges(spark, sf_dir, 1.2).withColumn("dist", F.round("dist", 5))


@query(f"""WITH {B.EMB_SQL} SELECT a.id AS src, b.id AS dst, round(array_distance(a.emb, b.emb), 5) AS dist
FROM emb a JOIN emb b ON a.id < b.id WHERE array_distance(a.emb, b.emb) < 1.1""")
def eps_graph_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.eps_edges(B.embeddings(spark, sf_dir), 1.1)
    return edges.withColumn("dist", F.round("dist", 5))


@query(f"""WITH {_edges_sql(1.25)} SELECT src, dst, round(dist, 5) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM both_ways) WHERE rn <= 5""")
def topk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.symmetric(batch_edges(spark, sf_dir, 1.25), ["dist"])
    return graph.topk(edges, 5, [F.col("dist"), F.col("dst")]).withColumn("dist", F.round("dist", 5))


@query(f"""WITH {B.EMB_SQL}, near AS (SELECT a.id AS src, b.id AS dst, array_distance(a.emb, b.emb) AS dist
  FROM emb a JOIN emb b ON a.id <> b.id WHERE array_distance(a.emb, b.emb) < 1.15)
SELECT src, dst, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM near) WHERE rn <= 5""")
def topk_neighbours_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours over the whole table."""
    edges = graph.symmetric(graph.eps_edges(B.embeddings(spark, sf_dir), 1.15, nearest=5), ["dist"])
    return graph.topk(edges, 5, [F.col("dist"), F.col("dst")]).withColumn("dist", F.round("dist", 5))


@query(f"""WITH {_edges_sql(1.2)} SELECT emb.id, count(src) AS degree FROM emb LEFT JOIN both_ways ON src = emb.id GROUP BY emb.id""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(batch_edges(spark, sf_dir, 1.2), B.embeddings(spark, sf_dir))


@query(f"""WITH {_edges_sql(1.25)}, full_edges AS (SELECT src, dst FROM both_ways UNION ALL SELECT id, id FROM emb),
deg AS (SELECT dst AS node, count(*) AS d FROM full_edges GROUP BY dst),
w AS (SELECT src, dst, 1 / sqrt(a.d::DOUBLE * b.d) AS w FROM full_edges JOIN deg a ON a.node = src JOIN deg b ON b.node = dst),
one AS (SELECT dst AS id, i, sum(w * emb[i]) AS x FROM w JOIN emb ON emb.id = src CROSS JOIN range(1, {DIM + 1}) r(i) GROUP BY dst, i),
two AS (SELECT dst AS id, i, sum(w * x) AS x FROM w JOIN one ON one.id = src GROUP BY dst, i)
SELECT id, CAST(i - 1 AS INTEGER) AS i, round(x, 5) AS x FROM two""")
def neighbour_mean_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.normalised_sum(batch_edges(spark, sf_dir, 1.25), B.embeddings(spark, sf_dir), rounds=2)
    return B.long_vectors(out, "emb", 5, "id")


SOFTMAX_SQL = f"""{_edges_sql(1.25)}, w AS (SELECT src, dst, exp(-dist - max(-dist) OVER (PARTITION BY dst)) AS e FROM both_ways),
weights AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY dst) AS weight FROM w)"""


def _softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.symmetric(batch_edges(spark, sf_dir, 1.25), ["dist"])
    return graph.softmax_weights(edges.withColumn("score", -F.col("dist")), "score")


@query(f"WITH {SOFTMAX_SQL} SELECT src, dst, round(weight, 6) AS weight FROM weights")
def softmax_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _softmax(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""WITH {SOFTMAX_SQL} SELECT dst AS id, CAST(i - 1 AS INTEGER) AS i, round(sum(weight * emb[i]), 5) AS x
FROM weights JOIN emb ON emb.id = src CROSS JOIN range(1, {DIM + 1}) r(i) GROUP BY dst, i""")
def softmax_weighted_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.weighted_sum(_softmax(spark, sf_dir), B.embeddings(spark, sf_dir), "weight")
    return B.long_vectors(out, "emb", 5, "id")


@query(f"""WITH {B.REL_SQL}, {B.EMB_SQL}, {B.row_split_sql('s', 'rel')}, n AS (SELECT count(*) AS n FROM emb),
known AS (SELECT DISTINCT drug_id, prot_id FROM s WHERE label = 1 AND split = 'train'),
x AS (SELECT drug_id, i, avg(emb[i]) AS x FROM known JOIN emb ON emb.id = prot_id % (SELECT n FROM n) CROSS JOIN range(1, {DIM + 1}) r(i) GROUP BY drug_id, i),
q AS (SELECT drug_id, sum(x * x) AS q, max(x) FILTER (i = 1) AS x0 FROM x GROUP BY drug_id)
SELECT p_partkey AS drug_id, round(coalesce(sqrt(q), 0), 5) AS norm, round(coalesce(x0, 0), 5) AS x0 FROM part LEFT JOIN q ON drug_id = p_partkey""")
def cross_side_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = splits.split_rows(B.relation(spark, sf_dir), F.col("row_key"), seed=B.SEED)
    right = B.entity_embeddings(spark, sf_dir, B.targets(spark, sf_dir), "prot_id")
    out = graph.cross_side_mean(rel, B.drugs(spark, sf_dir), right, "drug_id", "prot_id", DIM)
    profile = F.col("profile")
    return out.select(
        "drug_id", F.round(V.l2_norm(profile), 5).alias("norm"), F.round(profile[0], 5).alias("x0")
    )


# --- vector expressions ----------------------------------------------------


@query(f"""WITH {B.REL_SQL}, {B.EMB_SQL}, n AS (SELECT count(*) AS n FROM emb)
SELECT row_key, label, CAST(len(a.emb) + len(b.emb) AS INTEGER) AS width, round(array_distance(a.emb, b.emb), 5) AS dist
FROM rel JOIN emb a ON a.id = drug_id % (SELECT n FROM n) JOIN emb b ON b.id = prot_id % (SELECT n FROM n)""")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_vectors(spark, sf_dir)
    return pairs.select(
        "row_key", "label", F.size("features").alias("width"),
        F.round(V.l2_distance(F.col("left_emb"), F.col("right_emb")), 5).alias("dist"),
    )


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = B.entity_embeddings(spark, sf_dir, B.drugs(spark, sf_dir), "drug_id")
    right = B.entity_embeddings(spark, sf_dir, B.targets(spark, sf_dir), "prot_id")
    return graph.pair_vectors(B.relation(spark, sf_dir), left, right)


@query(f"""WITH {B.EMB_SQL} SELECT a.id, CAST(i - 1 AS INTEGER) AS i, round(a.emb[i] + 10 * b.emb[i], 5) AS x
FROM emb a JOIN emb b ON b.id = a.id + 1 CROSS JOIN range(1, {DIM + 1}) r(i)""")
def residual_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = B.embeddings(spark, sf_dir)
    following = emb.select((F.col("id") - 1).alias("id"), F.col("emb").alias("origin"))
    both = emb.join(following, "id").withColumn("x", V.residual(F.col("emb"), F.col("origin")))
    return B.long_vectors(both.select("id", "x"), "x", 5, "id")


@query(f"""WITH {B.EMB_SQL}, s AS (SELECT id, list_transform(emb::DOUBLE[], lambda x: x * (id + 1)) AS v FROM emb)
SELECT id, CAST(i - 1 AS INTEGER) AS i, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS x FROM s CROSS JOIN range(1, {DIM + 1}) r(i)""")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform(V.as_double(F.col("emb")), lambda x: x * (F.col("id") + 1))
    out = B.embeddings(spark, sf_dir).select("id", V.l2_normalise(scaled).alias("v"))
    return B.long_vectors(out, "v", 5, "id")


@query(f"""WITH {B.EMB_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM emb)
SELECT cluster, CAST(i - 1 AS INTEGER) AS i, round(avg(emb[i]), 5) AS x FROM t CROSS JOIN range(1, {DIM + 1}) u(i) WHERE r > 1 AND r < n GROUP BY cluster, i""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = graph.mean_pool(B.embeddings(spark, sf_dir), "cluster", "id", "emb")
    return B.long_vectors(pooled, "pooled", 5, "cluster")


# --- edge lists and set similarity -----------------------------------------


@query(f"""WITH e AS (SELECT DISTINCT user_id AS a, event_id % 100 AS b FROM events), k AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b)
SELECT a AS src, b AS dst FROM k WHERE a % 2 = 0 AND b % 2 = 0""")
def known_symmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between users and numbers; even ones are the known entities."""
    events = B.table(spark, sf_dir, "events")
    edges = events.select(F.col("user_id").alias("src"), (F.col("event_id") % 100).alias("dst")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).where(F.col("id") % 2 == 0).distinct()
    return graph.symmetric(graph.known_edges(edges, nodes)).select("src", "dst")


@query("""WITH w AS (SELECT user_id AS id, sum(value) AS weight FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT u.id, round(coalesce(w.weight, 0), 4) AS weight FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN w USING (id)""")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events")
    nodes = events.select(F.col("user_id").alias("id")).distinct()
    edges = events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("src"), F.col("event_id").alias("dst"), "value"
    )
    sums = graph.with_isolated(edges.withColumnRenamed("value", "weight"), nodes, "weight")
    return sums.withColumn("weight", F.round("weight", 4))


SHINGLE_SQL = """items AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5)))) AS items
  FROM documents WHERE length(text) >= 5),
sets AS (SELECT min(doc_id) AS rep, count(*) AS n, items, len(items) AS size FROM items GROUP BY items),
postings AS (SELECT rep, size, unnest(items) AS item FROM sets),
overlap AS (SELECT a.rep AS a, b.rep AS b, any_value(a.size) AS na, any_value(b.size) AS nb, count(*) AS both_n
  FROM postings a JOIN postings b ON a.item = b.item AND a.rep < b.rep AND least(a.size, b.size) >= 0.8 * greatest(a.size, b.size) GROUP BY a.rep, b.rep),
similar_sets AS (SELECT a, b, both_n / (na + nb - both_n)::DOUBLE AS sim FROM overlap WHERE both_n / (na + nb - both_n)::DOUBLE >= 0.8)"""


def _similar(spark: SparkSession, sf_dir: str) -> similarity.SimilarSets:
    docs = B.table(spark, sf_dir, "documents")
    return similarity.similar_sets(similarity.text_sets(docs, "doc_id", "text"), "doc_id", 0.8)


@query(f"WITH {SHINGLE_SQL} SELECT a, b, round(sim, 6) AS sim FROM similar_sets")
def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).edges.withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SHINGLE_SQL} SELECT round((coalesce((SELECT sum(2 * sim * x.n * y.n) FROM similar_sets JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b), 0)
  + (SELECT sum(n * (n - 1)) FROM sets)) / pow((SELECT count(*) FROM documents)::DOUBLE, 2), 8) AS mean_similarity""")
def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "documents").count()
    out = similarity.mean_similarity(_similar(spark, sf_dir), n)
    return out.select(F.round("mean_similarity", 8).alias("mean_similarity"))


LOW = 0.3


def _shingled(spark: SparkSession, sf_dir: str) -> similarity.Sets:
    return similarity.text_sets(B.table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def shingle_jaccard_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between different texts down to a similarity where a prefix filter leaves everything over."""
    return banded.similar_sets_banded(_shingled(spark, sf_dir), "doc_id", LOW).edges.withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SHINGLE_SQL.split('overlap AS')[0]}
overlap AS (SELECT a.rep AS q, b.rep AS o, any_value(a.size) AS nq, any_value(b.size) AS n_o, count(*) AS both_n
  FROM postings a JOIN postings b ON a.item = b.item AND a.rep <> b.rep AND a.rep % 20 = 0 GROUP BY a.rep, b.rep)
SELECT count(DISTINCT (least(q, o), greatest(q, o))) AS links, true AS recall_reached
FROM overlap WHERE both_n / (nq + n_o - both_n)::DOUBLE >= {LOW}""")
def shingle_recall_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every text whose id is divisible by 20, by brute force, and whether nine tenths of them are found."""
    sets = _shingled(spark, sf_dir)
    found = banded.similar_sets_banded(sets, "doc_id", LOW)
    reps = sets.among(found.members)
    exact = banded.links_of_queries(reps, reps.where(F.col("rep") % 20 == 0), "doc_id", LOW)
    return banded.measured_recall(found, exact).select("links", (F.col("recall") >= 0.9).alias("recall_reached"))


@query()
def mean_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all pairs of documents, however unlike, with its standard error."""
    docs = B.table(spark, sf_dir, "documents")
    return similarity.mean_similarity_all(similarity.text_sets(docs, "doc_id", "text"))


@query(f"""WITH {B.EMB_SQL}, d AS (SELECT a.id AS src, b.id AS dst, list_distance(a.emb, b.emb) AS distance
  FROM emb a JOIN emb b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d)
SELECT src, dst, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector, without a distance limit."""
    out = neighbours.knn_exact(B.embeddings(spark, sf_dir), k=5)
    return out.withColumn("distance", F.round("distance", 6))
