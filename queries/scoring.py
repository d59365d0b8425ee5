"""Metrics, repeated runs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import scalars as S
from pairloom.functions.hashing import row_key
from pairloom.operators import metrics, splits, summary, validate
from pairloom.plans import scenarios
from pairloom.session import materialize
from pairloom.sources.readers import log_metrics
from queries import query
from queries import bindings as B


@query(f"""WITH {B.SCORES_SQL}, {B.RANKED_SQL}
SELECT round(sum(pos * ((n_all - n_pos) - (n_above - pos_above) - (n - pos) + 0.5 * (n - pos))) / (max(n_pos) * max(n_all - n_pos)), 6) AS auroc
FROM ranked""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(B.scores(spark, sf_dir), "y", "p").select(F.round("auroc", 6).alias("auroc"))


@query(f"""WITH {B.SCORES_SQL}, {B.RANKED_SQL}
SELECT round(sum(pos * (pos_above + pos) / (n_above + n)) / max(n_pos), 6) AS average_precision FROM ranked""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.average_precision(B.scores(spark, sf_dir), "y", "p")
    return out.select(F.round("average_precision", 6).alias("average_precision"))


@query(f"""WITH {B.SCORES_SQL}, c AS (SELECT count(*) FILTER (p >= 0.98 AND y = 1) AS tp, count(*) FILTER (p >= 0.98 AND y = 0) AS fp,
  count(*) FILTER (p < 0.98 AND y = 1) AS fn, count(*) FILTER (p < 0.98 AND y = 0) AS tn FROM scores)
SELECT *, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def f1_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.confusion(B.scores(spark, sf_dir), "y", "p", threshold=0.98)
    return counts.withColumn("f1", F.round("f1", 6))


@query("""SELECT event_type, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 5) AS loss
FROM (SELECT event_type, value / 100.0 - 1.0 AS z, CAST(event_type = 'purchase' AS DOUBLE) AS y FROM events) GROUP BY event_type""")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events").select(
        "event_type",
        (F.col("value") / 100.0 - 1.0).alias("z"),
        (F.col("event_type") == "purchase").cast("double").alias("y"),
    )
    out = metrics.mean_loss(events, S.logit_loss(F.col("z"), F.col("y")), ["event_type"])
    return out.withColumn("loss", F.round("loss", 5))


FOLD_SCORES_SQL = """scores AS (
  SELECT l_orderkey % 10 AS fold, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice / 105000.0 AS p FROM lineitem),
points AS (SELECT fold, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scores GROUP BY fold, p),
ranked AS (
  SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_above, coalesce(sum(n) OVER w, 0) AS n_above,
         sum(pos) OVER (PARTITION BY fold) AS n_pos, sum(n) OVER (PARTITION BY fold) AS n_all
  FROM points WINDOW w AS (PARTITION BY fold ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
folds AS (SELECT fold, sum(pos * ((n_all - n_pos) - (n_above - pos_above) - (n - pos) + 0.5 * (n - pos))) / (max(n_pos) * max(n_all - n_pos)) AS auc,
  sum(pos * (pos_above + pos) / (n_above + n)) / max(n_pos) AS auprc FROM ranked GROUP BY fold)"""


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 10).alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_extendedprice") / 105000.0).alias("p"),
    )
    return metrics.ranking_metrics(rows, "y", "p", ["fold"]).drop("note")


@query(f"WITH {FOLD_SCORES_SQL} SELECT fold, round(auc, 6) AS auc, round(auprc, 6) AS auprc FROM folds")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fold_metrics(spark, sf_dir)
    return found.select("fold", F.round("auc", 6).alias("auc"), F.round("auprc", 6).alias("auprc"))


@query(f"WITH {FOLD_SCORES_SQL} SELECT round(avg(auc), 6) AS mean_auc, round(avg(auprc), 6) AS mean_auprc FROM folds")
def fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fold_metrics(spark, sf_dir)
    return found.agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.avg("auprc"), 6).alias("mean_auprc"))


@query(f"""WITH {B.SCORES_SQL}, {B.RANKED_SQL}, f AS (SELECT unnest([0.005, 0.01, 0.02])::DOUBLE AS fraction),
t AS (SELECT fraction, ceil(fraction * n_all) AS top, ranked.* FROM ranked CROSS JOIN f)
SELECT fraction, round((sum(pos * greatest(0, least(n, top - n_above)) / n) / max(top)) / (max(n_pos) / max(n_all)), 6) AS enrichment
FROM t GROUP BY fraction""")
def enrichment_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.enrichment(B.scores(spark, sf_dir), "y", "p")
    return out.withColumn("enrichment", F.round("enrichment", 6))


@query(f"""WITH {B.SCORES_SQL}, {B.RANKED_SQL},
s AS (SELECT sum(pos * exp(-80.5::DOUBLE / n_all * (n_above + 1)) * (1 - exp(-80.5::DOUBLE / n_all * n)) / (1 - exp(-80.5::DOUBLE / n_all)) / n) AS s,
  max(n_pos) AS k, max(n_all) AS n FROM ranked)
SELECT round(s / (k / n * (1 - exp(-80.5::DOUBLE)) / (exp(80.5::DOUBLE / n) - 1))
  * (k / n * sinh(40.25::DOUBLE) / (cosh(40.25::DOUBLE) - cosh(40.25 - 80.5 * k / n))) + 1 / (1 - exp(80.5 * (1 - k / n))), 6) AS bedroc FROM s""")
def bedroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bedroc(B.scores(spark, sf_dir), "y", "p").select(F.round("bedroc", 6).alias("bedroc"))


@query("""WITH r AS (SELECT o_orderpriority AS dataset, CAST(o_orderstatus = 'F' AS INTEGER) AS x,
  rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rk
  FROM orders WHERE o_orderstatus IN ('F', 'O') WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice)),
s AS (SELECT dataset, sum(rk) FILTER (x = 1)::DOUBLE AS w, count(*) FILTER (x = 1)::DOUBLE AS n1, count(*) FILTER (x = 0)::DOUBLE AS n2 FROM r GROUP BY dataset),
z AS (SELECT *, (w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM s),
t AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z)
SELECT dataset, round(w, 1) AS w, round(z, 5) AS z, round(((((1.061405429::DOUBLE * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x), 5) AS p_value FROM t""")
def rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = B.table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_orderpriority").alias("dataset"),
        (F.col("o_orderstatus") == "F").cast("int").alias("x"),
        F.col("o_totalprice").alias("metric"),
    )
    out = metrics.rank_sum(runs, "x", "metric", ["dataset"])
    return out.select(
        "dataset", F.round("w", 1).alias("w"), F.round("z", 5).alias("z"), F.round("p_value", 5).alias("p_value")
    )


@query("""SELECT user_id, count(*) AS contexts, min(value) AS low, max(value) AS high, round(coalesce(stddev_samp(value), 0), 4) AS std,
  round(quantile_cont(value, 0.25), 4) AS q_25, round(quantile_cont(value, 0.5), 4) AS q_50, round(quantile_cont(value, 0.75), 4) AS q_75
FROM events GROUP BY user_id""")
def score_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.stability(B.scores(spark, sf_dir).select("user_id", "value"), "user_id", "value")
    return out.withColumns({c: F.round(c, 4) for c in ("std", "q_25", "q_50", "q_75")})


@query("""SELECT o_orderpriority AS dataset, o_orderstatus AS scenario, count(*) AS runs,
  round(avg(o_totalprice), 4) AS mean_auc, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS std_auc FROM orders GROUP BY 1, 2""")
def repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("scenario"),
        F.col("o_totalprice").alias("auc"),
    )
    return summary.repeats(runs, ["auc"], digits=4)


@query("""SELECT o_custkey AS dataset, o_orderkey AS run, CAST(o_totalprice AS DOUBLE) AS auc, strftime(o_orderdate, '%Y-%m-%d') AS mtime FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("auc"),
        F.col("o_orderdate").alias("mtime"), (F.col("o_orderkey") % 3 == 0).alias("is_last"),
    )
    best = summary.best_run(runs, ["dataset"], "run", "auc", "mtime", "is_last")
    return best.withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd"))


# Each order becomes one run log: the metric lines appear twice and the last
# counts; every fifth log lacks them.
LOG_SQL = """logs AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 0 THEN 'stopped early' ELSE
  'epoch 1' || chr(10) || 'Test AUC: 0.1' || chr(10) || 'Test AUPRC: 0.2' || chr(10) || 'epoch 2' || chr(10) ||
  'Test AUC:  0.' || lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0') || chr(10) ||
  'Test AUPRC: 0.' || lpad(CAST(o_custkey * 104729 % 1000000 AS VARCHAR), 6, '0') END AS log FROM orders),
parsed AS (SELECT run, CAST(regexp_extract_all(log, 'Test AUC:\\s*([0-9]*\\.?[0-9]+)', 1)[-1] AS DOUBLE) AS auc,
  CAST(regexp_extract_all(log, 'Test AUPRC:\\s*([0-9]*\\.?[0-9]+)', 1)[-1] AS DOUBLE) AS auprc FROM logs)"""


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digits(key: str, factor: int) -> Column:
        return F.lpad((F.col(key) * factor % 1000000).cast("string"), 6, "0")

    text = F.concat(
        F.lit("epoch 1\nTest AUC: 0.1\nTest AUPRC: 0.2\nepoch 2\nTest AUC:  0."), digits("o_orderkey", 7919),
        F.lit("\nTest AUPRC: 0."), digits("o_custkey", 104729),
    )
    log = F.when(F.col("o_orderkey") % 5 == 0, "stopped early").otherwise(text)
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), "o_custkey", log.alias("log"))


@query(f"WITH {LOG_SQL} SELECT run, auc, auprc FROM parsed")
def log_metrics_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_metrics(run_logs(spark, sf_dir), "log").select("run", "auc", "auprc")


@query(f"WITH {LOG_SQL} SELECT run FROM parsed WHERE auc IS NULL OR auprc IS NULL")
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = run_logs(spark, sf_dir)
    done = log_metrics(logs, "log")
    return summary.pending_runs(logs.select("run"), done, ["run"], ["auc", "auprc"])


def _catalogue_sql() -> str:
    rows = ", ".join(
        f"({i}, '{s.dataset}', '{s.scenario}', '{s.scenario_key}', '{s.best_param_name}', {str(s.dataset in scenarios.ENTITY_DATASETS).lower()})"
        for i, s in enumerate(scenarios.SCENARIOS)
    )
    return f"catalogue AS (SELECT * FROM (VALUES {rows}) AS t(i, dataset, scenario, scenario_key, best_param_name, by_seed))"


@query(f"""WITH {LOG_SQL}, {_catalogue_sql()},
m AS (SELECT c.*, run // 24 AS tag, auc, auprc FROM parsed JOIN catalogue c ON c.i = run % 24 WHERE auc IS NOT NULL AND auprc IS NOT NULL)
SELECT dataset, scenario, scenario_key, count(*) AS runs, round(avg(auc), 9) AS mean_auc, round(coalesce(stddev_samp(auc), 0), 9) AS std_auc,
  round(avg(auprc), 9) AS mean_auprc, round(coalesce(stddev_samp(auprc), 0), 9) AS std_auprc, best_param_name
FROM m GROUP BY dataset, scenario, scenario_key, best_param_name""")
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs dealt out over the scenario catalogue, then summarised."""
    listed = spark.createDataFrame(
        [(i, s.dataset, s.scenario_key, s.scenario, s.best_param_name) for i, s in enumerate(scenarios.SCENARIOS)],
        "i long, dataset string, scenario_key string, scenario string, best_param_name string",
    )
    runs = log_metrics(run_logs(spark, sf_dir), "log").select(
        (F.col("run") % 24).alias("i"), F.floor(F.col("run") / 24).cast("string").alias("run_tag"), "auc", "auprc"
    )
    tagged = runs.join(listed, "i")
    planned = tagged.select("dataset", "scenario", "scenario_key", "best_param_name", "run_tag")
    return scenarios.summarise(planned, tagged.select("dataset", "scenario_key", "run_tag", "auc", "auprc"), 9)


# --- export ----------------------------------------------------------------

EXPORT_SQL = f"""{B.TRIPLETS_SQL}, good AS (SELECT * FROM checked WHERE reason IS NULL),
{B.split_sql('gs', 'good', 'source_row', ratio=(0.5, 0.2, 0.3))},
p AS (SELECT source_row, 1 / (1 + exp((length(sequence) - 200) / 50.0::DOUBLE)) AS pa FROM good),
export AS (
  SELECT c.source_row, c.smiles, c.sequence, c.activation AS activity, coalesce(c.reason, '') AS excluded_reason,
    CASE WHEN pa >= 0.5 THEN 1 WHEN pa < 0.5 THEN 0 END AS predicted_label, round(pa, 6) AS probability_active,
    round(1 - pa, 6) AS probability_inactive, CASE WHEN pa IS NULL THEN 'excluded' ELSE coalesce(split, 'unused') END AS split
  FROM checked c LEFT JOIN p USING (source_row) LEFT JOIN gs USING (source_row))"""


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = materialize(validate.with_reason(B.triplets(spark, sf_dir)), "checked-rows")
    good = validate.accepted(checked)
    split = splits.split_rows(good, row_key("source_row"), (0.5, 0.2, 0.3), B.SEED)
    p = S.sigmoid((F.lit(200) - F.length("sequence")) / 50.0)
    predictions = good.select("source_row", p.alias("probability_active")).withColumns({
        "predicted_label": S.decide(F.col("probability_active")),
        "probability_inactive": 1 - F.col("probability_active"),
    })
    return summary.export_rows(checked, predictions, split).withColumns(
        {c: F.round(c, 6) for c in ("probability_active", "probability_inactive")}
    )


@query(f"WITH {EXPORT_SQL} SELECT * FROM export")
def export_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir)


@query(f"WITH {EXPORT_SQL} SELECT source_row, predicted_label, coalesce(printf('%.6f', probability_active), 'n/a') AS p FROM export")
def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export(spark, sf_dir)
    return rows.select("source_row", "predicted_label", S.metric_text(F.col("probability_active")).alias("p"))


@query("""WITH i AS (SELECT l_orderkey AS g, CAST(l_returnflag = 'R' AS INTEGER) AS x,
  2 * rank() OVER w + count(*) OVER (PARTITION BY l_orderkey, l_extendedprice) - 1 AS t, row_number() OVER w - 1 AS i,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice)),
s AS (SELECT g, n, sum(x) AS n1, sum(t * x) AS w FROM i GROUP BY g, n),
m AS (SELECT *, unnest(range(CAST(pow(2, n) AS BIGINT))) AS m FROM s WHERE n1 BETWEEN 1 AND n - 1),
c AS (SELECT m.g, m.m, any_value(m.n1) AS n1, any_value(m.n) AS n, any_value(m.w) AS w, sum(t) AS v, count(*) AS k
  FROM m JOIN i ON i.g = m.g AND (m.m >> i.i) & 1 = 1 GROUP BY m.g, m.m),
p AS (SELECT g, (count(*) FILTER (abs(v - n1 * (n + 1)) >= abs(w - n1 * (n + 1))))::DOUBLE / count(*) AS p FROM c WHERE k = n1 GROUP BY g)
SELECT g AS l_orderkey, (w / 2.0)::DOUBLE AS w, CAST(n1 AS INTEGER) AS n1, CAST(n - n1 AS INTEGER) AS n2, round(p, 9) AS p_value FROM s LEFT JOIN p USING (g)""")
def rank_sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned against other lines of each order by price, by the exact law of the rank sum."""
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("x"), "l_extendedprice")
    return metrics.rank_sum_exact(lines, "x", "l_extendedprice", ["l_orderkey"]).withColumn("p_value", F.round("p_value", 9))
