"""Queries on evaluation: labels as gold, a plain rule over documents as prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import evaluate as E
from lexiloom.sources.tables import table

from .base import query

_PRED = "p AS (SELECT doc_id, lang, source, length(text) > 1500 AS said, (length(text) % 1000) / 1000.0::DOUBLE AS conf FROM documents)"
_OUT = f"""{_PRED}, o AS (SELECT source AS rule_id, lang AS doc_type, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS severity,
CASE WHEN said AND toxic = 1 THEN 'tp' WHEN said THEN 'fp' WHEN toxic = 1 THEN 'fn' END AS outcome FROM p JOIN labels USING (doc_id))"""
_SCORED = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall"


def _outcomes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("rule_id"), F.col("lang").alias("doc_type"), (F.length("text") > 1500).alias("said"), ((F.length("text") % 1000) / 1000.0).alias("conf"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").withColumn("severity", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return rows.withColumn("outcome", F.when(F.col("said") & (F.col("toxic") == 1), "tp").when(F.col("said"), "fp").when(F.col("toxic") == 1, "fn"))


@query(
    "agg_confusion",
    f"""WITH {_OUT}, g AS (SELECT rule_id, doc_type, severity, grouping_id(rule_id, doc_type, severity)::BIGINT AS level,
count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn
FROM o GROUP BY GROUPING SETS ((rule_id, doc_type, severity), (severity), ())), s AS (SELECT *, {_SCORED} FROM g)
SELECT rule_id, doc_type, severity, level, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM s""",
)
def agg_confusion(spark, d):
    out = E.confusion(_outcomes(spark, d), ["rule_id", "doc_type", "severity"])
    return out.select("rule_id", "doc_type", "severity", "level", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "agg_calibration",
    f"""WITH {_PRED}, r AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'n/a' ELSE conf::VARCHAR END AS c, toxic FROM p JOIN labels USING (doc_id)), x AS (SELECT try_cast(c AS DOUBLE) AS c, toxic FROM r)
SELECT CASE WHEN c IS NULL THEN 'missing' WHEN c < 0.5 THEN '0.00-0.50' WHEN c < 0.7 THEN '0.50-0.70' WHEN c < 0.85 THEN '0.70-0.85' WHEN c < 0.95 THEN '0.85-0.95' ELSE '0.95-1.00' END AS bin,
count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(toxic), 6) AS actual_precision FROM x GROUP BY 1""",
)
def agg_calibration(spark, d):
    rows = _outcomes(spark, d).withColumn("c", F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise(F.col("conf").cast("string")))
    return E.calibration(rows, "c", "toxic").select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("actual_precision", 6).alias("actual_precision"))


@query(
    "agg_coverage",
    """WITH r AS (SELECT o_custkey AS doc_id, list_distinct(list(o_orderpriority)) AS enabled, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS executed FROM orders GROUP BY 1),
c AS (SELECT doc_id, len(enabled) AS total, len(list_intersect(enabled, coalesce(executed, []))) AS done, list_sort(list_filter(enabled, lambda x: NOT list_contains(coalesce(executed, []), x))) AS miss FROM r)
SELECT doc_id, done, total, array_to_string(miss, ',') AS missing, round(CASE WHEN total = 0 THEN 1 ELSE done / total END, 6) AS coverage, CASE WHEN done = total THEN 'complete' ELSE 'complete_degraded' END AS state FROM c""",
)
def agg_coverage(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "doc_id")
    gold = orders.groupBy("doc_id").agg(F.collect_set("o_orderpriority").alias("enabled"))
    runs = orders.where("o_orderstatus = 'F'").groupBy("doc_id").agg(F.collect_set("o_orderpriority").alias("executed"))
    out = E.coverage(gold, runs)
    return out.select("doc_id", "done", "total", F.concat_ws(",", "missing").alias("missing"), F.round("coverage", 6).alias("coverage"), "state")


@query(
    "agg_refusal",
    """WITH q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality = 0 END AS ex, toxic = 0 AS answerable FROM labels), a AS (SELECT doc_id, n_chars < 900 AS refused FROM documents WHERE doc_id % 5 <> 0),
j AS (SELECT coalesce(ex, NOT answerable) AS e, coalesce(refused, false) AS r FROM q LEFT JOIN a USING (doc_id))
SELECT count(*) AS questions, count(*) FILTER (WHERE e) AS expected, count(*) FILTER (WHERE e AND r) AS correct, count(*) FILTER (WHERE e AND NOT r) AS missed, count(*) FILTER (WHERE NOT e AND r) AS false_refusals,
round(count(*) FILTER (WHERE e AND r) / count(*) FILTER (WHERE e), 6) AS refusal_accuracy, round(count(*) FILTER (WHERE e = r) / count(*), 6) AS answerability_accuracy FROM j""",
)
def agg_refusal(spark, d):
    questions = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 != 0, F.col("quality") == 0).alias("expected_refusal"), (F.col("toxic") == 0).alias("answerable"))
    answers = table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("question_id"), (F.col("n_chars") < 900).alias("refused"))
    out = E.refusals(questions, answers)
    return out.select("questions", "expected", "correct", "missed", "false_refusals", F.round("refusal_accuracy", 6).alias("refusal_accuracy"), F.round("answerability_accuracy", 6).alias("answerability_accuracy"))


@query(
    "agg_regression_gate",
    f"""WITH {_OUT.replace("SELECT source AS rule_id", "SELECT doc_id, source AS rule_id")}, x AS (SELECT *, 'overall' AS series FROM o UNION ALL SELECT *, 'by_severity.high' FROM o WHERE severity = 'high'),
m AS (SELECT series, k, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM x, (VALUES (0), (1)) v(k) WHERE k = 1 OR doc_id % 2 = 0 GROUP BY ALL),
u AS (SELECT series || '.precision' AS metric, k, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS v FROM m UNION ALL SELECT series || '.recall', k, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END FROM m)
SELECT metric, round(b.v - c.v, 6) AS "drop", b.v - c.v > 0.02 AS blocked FROM u b JOIN u c USING (metric) WHERE b.k = 0 AND c.k = 1""",
)
def agg_regression_gate(spark, d):
    rows = _outcomes(spark, d)
    metrics = lambda df: E.gated_metrics(E.confusion(df, ["rule_id", "doc_type", "severity"]), 3)
    return E.regression_gate(metrics(rows.where("doc_id % 2 = 0")), metrics(rows)).select("metric", F.round("drop", 6).alias("drop"), "blocked")


@query("anti_fp_fn", f"WITH {_OUT.replace('SELECT source AS rule_id', 'SELECT doc_id, source AS rule_id')} SELECT doc_id, outcome FROM o WHERE outcome IN ('fp', 'fn')")
def anti_fp_fn(spark, d):
    gold = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    judged = table(spark, d, "labels").select("doc_id")
    said = table(spark, d, "documents").where(F.length("text") > 1500).select("doc_id").join(judged, "doc_id", "left_semi")
    docs = table(spark, d, "documents").select("doc_id")
    fp = said.join(gold, "doc_id", "left_anti").withColumn("outcome", F.lit("fp"))
    return fp.unionByName(gold.join(docs, "doc_id", "left_semi").join(said, "doc_id", "left_anti").withColumn("outcome", F.lit("fn")))


@query(
    "join_doctype",
    "SELECT l.doc_id, coalesce(lower(d.lang), 'unknown') AS doc_type, CASE WHEN quality = 1 THEN 'high' ELSE 'unknown' END AS severity FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.doc_id % 2 = 0",
)
def join_doctype(spark, d):
    gold = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "lang")
    return table(spark, d, "labels").join(gold, "doc_id", "left").select("doc_id", F.coalesce(F.lower("lang"), F.lit("unknown")).alias("doc_type"), F.when(F.col("quality") == 1, "high").otherwise("unknown").alias("severity"))


@query("join_gold_pred", "SELECT item_id AS gold_id, item_id AS prediction_id, round(greatest(0.8, g / (g + 2)), 6) AS score FROM (SELECT item_id, length(regexp_replace(text, '\\s+', '', 'g')) AS g FROM benchmark)")
def join_gold_pred(spark, d):
    items = table(spark, d, "benchmark")
    key = F.floor(F.col("item_id") / 4)
    side = lambda text: items.select(key.alias("doc_id"), (F.col("item_id") % 2).cast("string").alias("rule_id"), F.lit("high").alias("severity"), F.lit("x").alias("doc_type"), F.col("item_id").alias("id"), text.alias("text"), F.lit(None).cast("string").alias("issue_id"))
    out = E.associated(side(F.col("text")), side(F.concat(F.lit("so "), "text")))
    return out.select("gold_id", "prediction_id", F.round("score", 6).alias("score"))
