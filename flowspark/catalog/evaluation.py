"""Verdicts, metrics and score comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import CLASSES, FLOWS, SCORED, query, scored_flows
from flowspark.flows import flows
from flowspark.functions.verdict import max_score_alert, score_health, verdict
from flowspark.operators import evaluate, stats

FIELDS = [
    "task_type", "predicted_class", "predicted_label", "confidence", "max_probability", "is_attack",
    "attack_type", "attack_probability",
]


def unpack(df, v):
    out = df.select("flow_id", v.alias("v"))
    rounded = ("confidence", "max_probability", "attack_probability")
    return out.select(
        "flow_id", *[(F.round(f"v.{f}", 6) if f in rounded else F.col(f"v.{f}")).alias(f) for f in FIELDS]
    )


SINGLE = f"""SELECT flow_id, CASE WHEN flow_id % 31 = 0 THEN 'NaN'::DOUBLE WHEN flow_id % 37 = 0 THEN 'Infinity'::DOUBLE
 ELSE CAST(OUT_BYTES % 3000 AS DOUBLE) / 1000.0 - 0.5 END AS x FROM ({FLOWS}) q"""


@query(
    "m5_verdict_one_score",
    f"""SELECT flow_id, 'binary' AS task_type, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted_class,
    CASE WHEN p >= 0.5 THEN 'Attack' ELSE 'Benign' END AS predicted_label, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS confidence,
    round(greatest(p, 1 - p), 6) AS max_probability, p >= 0.5 AS is_attack, CASE WHEN p >= 0.5 THEN 'Attack' END AS attack_type,
    round(p, 6) AS attack_probability
    FROM (SELECT flow_id, CASE WHEN isnan(x) OR isinf(x) THEN 0.0 WHEN x < 0 OR x > 1 THEN 1 / (1 + exp(-x)) ELSE x END AS p FROM ({SINGLE}) s) t""",
)
def _verdict_one_score(spark, sf_dir):
    i = F.col("flow_id")
    x = (
        F.when(i % 31 == 0, F.lit(float("nan"))).when(i % 37 == 0, F.lit(float("inf")))
        .otherwise((F.col("OUT_BYTES") % 3000) / 1000.0 - 0.5)
    )
    return unpack(flows(spark, sf_dir), verdict(F.array(x), CLASSES))


ARGMAX = "CASE WHEN isnan(p1) THEN 1 WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
NAN_SCORED = f"SELECT flow_id, Attack, p0, CASE WHEN flow_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE p1 END AS p1, p2 FROM ({SCORED}) n"
MULTI = f"SELECT *, {ARGMAX} AS c, CASE WHEN isnan(p1) THEN greatest(p0, p2) ELSE greatest(p0, p1, p2) END AS top FROM ({NAN_SCORED}) a"


def nan_scored(spark, sf_dir):
    s = F.col("scores")
    with_nan = F.array(s[0], F.when(F.col("flow_id") % 50 == 0, F.lit(float("nan"))).otherwise(s[1]), s[2])
    return scored_flows(spark, sf_dir).withColumn("scores", with_nan)


@query(
    "m6_verdict_many_scores",
    f"""SELECT flow_id, 'multiclass' AS task_type, c AS predicted_class, l AS predicted_label, round(conf, 6) AS confidence,
    round(top, 6) AS max_probability, c <> 0 AS is_attack, CASE WHEN c <> 0 THEN l END AS attack_type, round(conf, 6) AS attack_probability
    FROM (SELECT *, CASE c WHEN 0 THEN 'Benign' WHEN 1 THEN 'Dos_TCP_Flood' ELSE 'Dos_UDP_flood' END AS l,
     CASE WHEN isnan(p1) THEN 0.0 ELSE top END AS conf FROM ({MULTI}) m) r""",
)
def _verdict_many_scores(spark, sf_dir):
    return unpack(nan_scored(spark, sf_dir), verdict(F.col("scores"), CLASSES, benign_class_index=0))


@query(
    "m6_verdict_without_labels",
    f"""SELECT flow_id, 'multiclass' AS task_type, c AS predicted_class, CAST(NULL AS VARCHAR) AS predicted_label,
    round(CASE WHEN isnan(p1) THEN 0.0 ELSE top END, 6) AS confidence, round(top, 6) AS max_probability, top >= 0.6 AS is_attack,
    CASE WHEN top >= 0.6 THEN CAST(c AS VARCHAR) END AS attack_type,
    round(CASE WHEN isnan(p1) THEN 0.0 ELSE top END, 6) AS attack_probability FROM ({MULTI}) m""",
)
def _verdict_without_labels(spark, sf_dir):
    return unpack(nan_scored(spark, sf_dir), verdict(F.col("scores"), [], threshold=0.6))


@query(
    "m6_m7_verdict_mixed_sizes",
    f"""SELECT flow_id, CASE WHEN flow_id % 3 = 0 THEN 'unknown' ELSE 'binary-2class' END AS task_type,
    CASE WHEN flow_id % 3 = 0 OR p0 >= p1 THEN 0 ELSE 1 END AS predicted_class, CAST(NULL AS VARCHAR) AS predicted_label,
    CASE WHEN flow_id % 3 = 0 THEN 0.0 ELSE round(greatest(p0, p1), 6) END AS confidence,
    CASE WHEN flow_id % 3 = 0 THEN 0.0 ELSE round(greatest(p0, p1), 6) END AS max_probability,
    flow_id % 3 <> 0 AND p1 > p0 AS is_attack, CASE WHEN flow_id % 3 <> 0 AND p1 > p0 THEN '1' END AS attack_type,
    CASE WHEN flow_id % 3 = 0 THEN 0.0 ELSE round(greatest(p0, p1), 6) END AS attack_probability FROM ({SCORED}) m""",
)
def _verdict_mixed_sizes(spark, sf_dir):
    some = F.when(F.col("flow_id") % 3 == 0, F.slice("scores", 1, 0)).otherwise(F.slice("scores", 1, 2))
    return unpack(scored_flows(spark, sf_dir), verdict(some, CLASSES))


@query("m8_max_score_alert", f"SELECT flow_id, greatest(p0, p1, p2) > 0.5 AS alert FROM ({SCORED}) s")
def _max_score_alert(spark, sf_dir):
    return scored_flows(spark, sf_dir).select("flow_id", max_score_alert(F.col("scores")).alias("alert"))


@query(
    "g9_score_health",
    f"""SELECT flow_id, flow_id % 50 = 0 AS has_non_finite, flow_id % 50 <> 0 AND sd < 1e-7 AS near_uniform,
    CASE WHEN flow_id % 50 <> 0 THEN round(sd, 6) END AS output_std
    FROM (SELECT flow_id, CASE WHEN flow_id % 40 = 0 THEN 0.0
     ELSE sqrt((power(p0 - 1 / 3.0, 2) + power(p1 - 1 / 3.0, 2) + power(p2 - 1 / 3.0, 2)) / 3) END AS sd FROM ({SCORED}) s) h""",
)
def _score_health(spark, sf_dir):
    third = F.lit(1 / 3.0)
    df = nan_scored(spark, sf_dir)
    even = (F.col("flow_id") % 40 == 0) & (F.col("flow_id") % 50 != 0)
    h = score_health(F.when(even, F.array(third, third, third)).otherwise(F.col("scores")))
    out = df.select("flow_id", h.alias("h"))
    std = F.when(~F.col("h.has_non_finite"), F.round("h.output_std", 6) + 0.0)
    return out.select("flow_id", "h.has_non_finite", "h.near_uniform", std.alias("output_std"))


COUNTED = f"""SELECT count(*) FILTER (WHERE t) AS "P", count(*) FILTER (WHERE NOT t) AS "N", count(*) FILTER (WHERE g) AS "pred_P",
 count(*) FILTER (WHERE NOT g) AS "pred_N", count(*) FILTER (WHERE g AND t) AS "TP", count(*) FILTER (WHERE g AND NOT t) AS "FP",
 count(*) FILTER (WHERE NOT g AND NOT t) AS "TN", count(*) FILTER (WHERE NOT g AND t) AS "FN"
 FROM (SELECT Attack <> 'Benign' AS t, 1 - p1 > 0.5 AS g FROM ({SCORED}) s) u"""


@query(
    "v1_binary_evaluation",
    f"""SELECT "P", "N", "pred_P", "pred_N", "TP", "FP", "TN", "FN", round(se, 6) AS sensitivity, round(sp, 6) AS specificity,
    round(pr, 6) AS precision, round(se, 6) AS recall, round((se + sp) / 2, 6) AS bal_acc,
    round(CASE WHEN pr + se > 0 THEN 2 * pr * se / (pr + se) ELSE 0 END, 6) AS f1
    FROM (SELECT *, "TP" / nullif("TP" + "FN", 0) AS se, "TN" / nullif("TN" + "FP", 0) AS sp, "TP" / nullif("TP" + "FP", 0) AS pr
     FROM ({COUNTED}) c) d""",
)
def _binary_evaluation(spark, sf_dir):
    df = scored_flows(spark, sf_dir).withColumn("score", 1 - F.col("scores")[1])
    out = evaluate.binary_evaluation(df)
    rates = ["sensitivity", "specificity", "precision", "recall", "bal_acc", "f1"]
    return out.withColumns({c: F.round(c, 6) for c in rates})


PREDICTED = f"""SELECT Attack AS truth, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Benign' WHEN p1 >= p2 THEN 'Dos_TCP_Flood'
 ELSE 'Dos_UDP_flood' END AS predicted FROM ({SCORED}) s"""


def predicted_flows(spark, sf_dir):
    v = verdict(F.col("scores"), CLASSES)
    return scored_flows(spark, sf_dir).select("flow_id", "Attack", v["predicted_label"].alias("predicted"))


@query(
    "v2_class_report",
    f"""WITH s AS ({PREDICTED}), k AS (SELECT DISTINCT truth AS class FROM s UNION SELECT DISTINCT predicted FROM s),
    c AS (SELECT class, (SELECT count(*) FROM s WHERE truth = class AND predicted = class) AS tp, (SELECT count(*) FROM s WHERE truth = class) AS support,
     (SELECT count(*) FROM s WHERE predicted = class) AS guessed FROM k),
    r AS (SELECT class, coalesce(tp / nullif(guessed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, support, tp FROM c),
    f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM r)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
     round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
def _class_report(spark, sf_dir):
    out = evaluate.class_report(predicted_flows(spark, sf_dir), "Attack", "predicted")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "v3_confusion_matrix",
    f"""SELECT truth, count(*) FILTER (WHERE predicted = 'Benign') AS "Benign", count(*) FILTER (WHERE predicted = 'Dos_TCP_Flood') AS "Dos_TCP_Flood",
    count(*) FILTER (WHERE predicted = 'Dos_UDP_flood') AS "Dos_UDP_flood" FROM ({PREDICTED}) s GROUP BY truth""",
)
def _confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predicted_flows(spark, sf_dir), "Attack", "predicted")


def score_sets(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("scores"))
    noisy = F.transform("scores", lambda v: F.round(v.cast("double") * 100) / 100.0)
    return left, left.select("vec_id", noisy.alias("scores"))


ELEMENTS = """SELECT vec_id, x, round(x * 100) / 100.0 AS y FROM
 (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e"""
METRICS = """round(avg(abs(x - y)), 5) AS mae, round(max(abs(x - y)), 5) AS max_abs, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 5) AS cosine,
 round(stddev_pop(x), 5) AS std_left, round(stddev_pop(y), 5) AS std_right, 'both sides vary' AS diagnosis"""
METRIC_COLUMNS = ["mae", "max_abs", "cosine", "std_left", "std_right"]


@query("v4_compare_scores", f"SELECT vec_id, 'compared' AS status, {METRICS} FROM ({ELEMENTS}) e GROUP BY vec_id")
def _compare_scores(spark, sf_dir):
    out = evaluate.compare_scores(*score_sets(spark, sf_dir), on="vec_id")
    return out.withColumns({c: F.round(c, 5) for c in METRIC_COLUMNS})


@query("v4_compare_score_sets", f"SELECT true AS same_size, true AS all_finite, {METRICS} FROM ({ELEMENTS}) e")
def _compare_score_sets(spark, sf_dir):
    out = evaluate.compare_score_sets(*score_sets(spark, sf_dir), on="vec_id")
    return out.withColumns({c: F.round(c, 5) for c in METRIC_COLUMNS})


@query("v5_positives", f"SELECT flow_id, Attack <> 'Benign' AS positive FROM ({FLOWS}) q")
def _positives(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", stats.is_positive(F.col("Attack")).alias("positive"))
