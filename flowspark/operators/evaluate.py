"""Evaluation of predictions and comparison of score sets. Data is touched once per operator, by a
partially aggregated count; everything after works on class-sized tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.functions.verdict import array_std, is_finite
from flowspark.operators.stats import is_positive
from flowspark.session import fetch_small, small_table

# Labels that may become columns of a confusion matrix.
MAX_LABELS = 300


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_evaluation(
    df: DataFrame, score: str = "score", label: str = "Attack", benign: str = "Benign",
    threshold: float = 0.5,
) -> DataFrame:
    """One row of counts and rates; positive means not benign, predicted positive score > threshold."""
    pos = is_positive(quoted(label), benign)
    pred = F.coalesce(~F.isnan(quoted(score)) & (quoted(score) > threshold), F.lit(False))
    counts = df.agg(
        F.count_if(pos).alias("P"), F.count_if(~pos).alias("N"),
        F.count_if(pred).alias("pred_P"), F.count_if(~pred).alias("pred_N"),
        F.count_if(pred & pos).alias("TP"), F.count_if(pred & ~pos).alias("FP"),
        F.count_if(~pred & ~pos).alias("TN"), F.count_if(~pred & pos).alias("FN"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    rates = counts.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
    })
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumns({
        "bal_acc": (F.col("sensitivity") + F.col("specificity")) / 2.0, "f1": ratio(2.0 * p * r, p + r),
    })


def prediction_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n); a missing label counts as the label 'null'."""

    def text(name: str) -> Column:
        return F.coalesce(quoted(name).cast("string"), F.lit("null"))

    return df.groupBy(text(truth).alias("truth"), text(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages. The counts are
    fetched once; a label column with very many values stays distributed."""
    cells = prediction_counts(df, truth, predicted)
    small = fetch_small(cells)
    cells = cells if small is None else small
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("truth").alias("class"),
                    F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                    F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"),
                ),
                F.struct(
                    F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed")
    )
    per_class = sums.select(
        "class", ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"), "support", "tp",
    )
    p, r = F.col("precision"), F.col("recall")
    per_class = per_class.withColumn("f1", ratio(2.0 * p * r, p + r))

    def weighted(x: str) -> Column:
        return ratio(F.sum(F.col(x) * F.col("support")), F.sum("support"))

    s = F.sum("support")
    totals = per_class.agg(
        ratio(F.sum("tp"), s).alias("acc"), s.alias("support"),
        *[F.avg(x).alias(f"m_{x}") for x in ("precision", "recall", "f1")],
        *[weighted(x).alias(f"w_{x}") for x in ("precision", "recall", "f1")],
    )
    acc = F.col("acc")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.col("support").alias("support")),
        *[
            F.struct(
                F.lit(name).alias("class"), F.col(f"{k}_precision").alias("precision"),
                F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_f1").alias("f1"),
                F.col("support").alias("support"),
            )
            for name, k in (("macro avg", "m"), ("weighted avg", "w"))
        ],
    )
    summary = totals.select(F.inline(rows))
    columns = ["class", "precision", "recall", "f1", "support"]
    return per_class.select(*columns).unionByName(summary.select(*columns))


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, labels: list[str] | None = None
) -> DataFrame:
    """Rows true, columns predicted labels in sorted order (found from the counts when not given; more than
    ``MAX_LABELS`` are an error, as they become columns). One scan: the counts are fetched once."""
    cells = prediction_counts(df, truth, predicted)
    small = fetch_small(cells, MAX_LABELS * MAX_LABELS)
    if small is None:
        raise ValueError(f"a confusion matrix holds at most {MAX_LABELS} labels")
    cells = small
    if labels is None:
        found = cells.select(F.inline(F.array(F.struct(F.col("truth").alias("l")), F.struct(F.col("predicted").alias("l"))))).distinct()
        labels = sorted(r["l"] for r in found.limit(MAX_LABELS + 1).collect())
        if len(labels) > MAX_LABELS:
            raise ValueError(f"a confusion matrix holds at most {MAX_LABELS} labels")
    labels = [str(v) for v in labels]
    wide = cells.groupBy("truth").pivot("predicted", labels).agg(F.sum("n"))
    names = small_table(df.sparkSession, [(v,) for v in labels], "truth STRING")
    full = names.join(wide, "truth", "left")
    return full.select("truth", *[F.coalesce(quoted(v), F.lit(0).cast("bigint")).alias(v) for v in labels])


def _diagnosis(std_a: Column, std_b: Column) -> Column:
    return (
        F.when((std_a > 1e-6) & (std_b < 1e-7), "second side collapsed")
        .when((std_a < 1e-7) & (std_b < 1e-7), "both sides near-constant")
        .otherwise("both sides vary")
    )


def compare_scores(
    left: DataFrame, right: DataFrame, on: str, scores: str = "scores"
) -> DataFrame:
    """Per id: status, MAE, largest difference, cosine, spread of each side, diagnosis.

    An id present on one side only has status 'missing'.
    """
    a = left.select(on, F.transform(quoted(scores), lambda v: v.cast("double")).alias("a"))
    b = right.select(on, F.transform(quoted(scores), lambda v: v.cast("double")).alias("b"))
    both = a.join(b, on, "full_outer")

    def finite(v: str) -> Column:
        return ~F.exists(v, lambda x: ~is_finite(x))

    status = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "missing")
        .when(~finite("a") | ~finite("b"), "non-finite")
        .when(F.size("a") != F.size("b"), "sizes differ")
        .otherwise("compared")
    )
    ok = F.col("status") == "compared"
    diff = F.zip_with("a", "b", lambda x, y: F.abs(x - y))

    def total(v) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    dot = total(F.zip_with("a", "b", lambda x, y: x * y))
    norms = F.sqrt(total(F.transform("a", lambda x: x * x))) * F.sqrt(total(F.transform("b", lambda x: x * x)))
    out = both.withColumn("status", status).select(
        on, "status",
        F.when(ok, total(diff) / F.nullif(F.size("a"), F.lit(0))).alias("mae"),
        F.when(ok, F.array_max(diff)).alias("max_abs"),
        F.when(ok, F.when(norms > 0, F.try_divide(dot, norms)).otherwise(F.lit(0.0))).alias("cosine"),
        F.when(ok, array_std(F.col("a"))).alias("std_left"),
        F.when(ok, array_std(F.col("b"))).alias("std_right"),
    )
    return out.withColumn("diagnosis", F.when(ok, _diagnosis(F.col("std_left"), F.col("std_right"))))


def compare_score_sets(
    left: DataFrame, right: DataFrame, on: str, scores: str = "scores"
) -> DataFrame:
    """The same metrics over all elements of all pairs as one row."""
    a = left.select(on, F.transform(quoted(scores), lambda v: v.cast("double")).alias("a"))
    b = right.select(on, F.transform(quoted(scores), lambda v: v.cast("double")).alias("b"))
    pairs = a.join(b, on, "full_outer")
    same = F.coalesce(F.size("a") == F.size("b"), F.lit(False))
    cells = pairs.select(
        same.alias("same"),
        F.explode_outer(F.arrays_zip(F.col("a"), F.col("b"))).alias("z"),
    ).select("same", F.col("z.a").alias("x"), F.col("z.b").alias("y"))
    fin = is_finite(F.col("x")) & is_finite(F.col("y"))
    sums = cells.agg(
        F.coalesce(F.bool_and("same"), F.lit(False)).alias("same_size"),
        F.coalesce(F.bool_and(~F.col("same") | fin), F.lit(True)).alias("all_finite"),
        F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"),
        F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs"),
        F.sum(F.col("x") * F.col("y")).alias("dot"),
        F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"),
    )
    norms = F.sqrt("xx") * F.sqrt("yy")
    ok = F.col("same_size") & F.col("all_finite")
    return sums.select(
        "same_size", "all_finite",
        F.when(ok, F.col("mae")).alias("mae"), F.when(ok, F.col("max_abs")).alias("max_abs"),
        F.when(ok, F.when(norms > 0, F.try_divide(F.col("dot"), norms)).otherwise(F.lit(0.0))).alias("cosine"),
        F.when(ok, F.col("sx")).alias("std_left"), F.when(ok, F.col("sy")).alias("std_right"),
        F.when(ok, _diagnosis(F.col("sx"), F.col("sy"))).alias("diagnosis"),
    )
