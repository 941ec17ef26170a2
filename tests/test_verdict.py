import math

import pytest
from pyspark.sql import functions as F

from flowspark.functions.verdict import max_score_alert, score_health, verdict
from flowspark.operators import evaluate

LABELS = ["Benign", "Dos_TCP_Flood", "Dos_UDP_flood"]
NAN = float("nan")


def judge(spark, scores, **kw):
    kw.setdefault("labels", LABELS)
    kw.setdefault("benign_class_index", 0)
    df = spark.createDataFrame([(scores,)], "s ARRAY<DOUBLE>")
    return df.select(verdict(F.col("s"), **kw).alias("v")).first()["v"]


@pytest.mark.parametrize("scores,task,cls,label,attack,confidence", [
    ([0.7, 0.2, 0.1], "multiclass", 0, "Benign", False, 0.7),
    ([0.1, 0.8, 0.1], "multiclass", 1, "Dos_TCP_Flood", True, 0.8),
    ([0.4, 0.4, 0.2], "multiclass", 0, "Benign", False, 0.4),
    ([0.3, 0.7], "binary-2class", 1, None, True, 0.7),
    ([0.5], "binary", 1, "Attack", True, 0.5),
    ([0.2], "binary", 0, "Benign", False, 0.8),
    ([2.0], "binary", 1, "Attack", True, 0.880797),
    ([NAN], "binary", 0, "Benign", False, 1.0),
    ([], "unknown", 0, None, False, 0.0),
    (None, "unknown", 0, None, False, 0.0),
])
def test_worked_verdicts(spark, scores, task, cls, label, attack, confidence):
    v = judge(spark, scores)
    assert (v["task_type"], v["predicted_class"], v["predicted_label"], v["is_attack"]) == (task, cls, label, attack)
    assert round(v["confidence"], 6) == confidence
    if scores == [0.3, 0.7]:
        assert v["attack_type"] == "1"


def test_nan_wins_the_argmax_with_no_confidence(spark):
    v = judge(spark, [0.9, NAN, 0.05])
    assert v["predicted_class"] == 1 and v["confidence"] == 0 and v["max_probability"] == 0.9 and v["is_attack"]
    v = judge(spark, [NAN, NAN])
    assert v["predicted_class"] == 0 and v["max_probability"] == 0
    v = judge(spark, [0.1, math.inf, 0.2])
    assert v["predicted_class"] == 1 and v["confidence"] == 0 and v["max_probability"] == 0


def test_benign_index_resolution(spark):
    assert judge(spark, [0.1, 0.9, 0.0], labels=["a", " BENIGN ", "c"], benign_class_index=None)["is_attack"] is False
    assert judge(spark, [0.1, 0.9, 0.0], labels=["a", "b", "c"], benign_class_index=None, threshold=0.95)["is_attack"] is False
    assert judge(spark, [0.1, 0.9, 0.0], labels=["a", "b", "c"], benign_class_index=None)["is_attack"] is True
    assert judge(spark, [0.9, 0.1], labels=[], benign_class_index=7)["is_attack"] is False  # out of range: 0 of 2
    v = judge(spark, [0.4], labels=["ok", "bad"], threshold=0.3)
    assert v["predicted_label"] == "bad" and v["max_probability"] == 0.6


def test_strict_alert_rule(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.51, 0.1],), ([],)], "s ARRAY<DOUBLE>")
    assert [r[0] for r in df.select(max_score_alert(F.col("s"))).collect()] == [False, True, False]


def test_score_health(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, NAN],), ([0.3],), ([0.1, 0.9],)], "s ARRAY<DOUBLE>")
    got = [(r["h"]["has_non_finite"], r["h"]["near_uniform"]) for r in df.select(score_health(F.col("s")).alias("h")).collect()]
    assert got == [(False, True), (True, False), (False, False), (False, False)]


def test_binary_evaluation_with_empty_sides(spark):
    df = spark.createDataFrame([(0.9, "Benign"), (0.5, "Benign")], "score DOUBLE, Attack STRING")
    r = evaluate.binary_evaluation(df).first()
    assert (r["TP"], r["FP"], r["TN"], r["FN"]) == (0, 1, 1, 0)
    assert r["sensitivity"] == 0 and r["specificity"] == 0.5 and r["f1"] == 0


def test_class_report_and_matrix(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2 + [("c", "a")]
    df = spark.createDataFrame(rows, "t STRING, p STRING")
    got = {r["class"]: r for r in evaluate.class_report(df, "t", "p").collect()}
    assert got["a"]["precision"] == 0.5 and got["a"]["recall"] == 0.75 and got["a"]["support"] == 4
    assert got["c"]["precision"] == 0 and got["c"]["recall"] == 0 and got["c"]["f1"] == 0
    assert round(got["accuracy"]["precision"], 6) == round(5 / 9, 6) and got["accuracy"]["support"] == 9
    m = {r["truth"]: (r["a"], r["b"], r["c"]) for r in evaluate.confusion_matrix(df, "t", "p").collect()}
    assert m == {"a": (3, 1, 0), "b": (2, 2, 0), "c": (1, 0, 0)}
    assert sum(sum(v) for v in m.values()) == len(rows)


def test_score_comparison_statuses(spark):
    left = spark.createDataFrame(
        [(1, [0.1, 0.9]), (2, [0.1, NAN]), (3, [0.1, 0.2, 0.7]), (4, [0.0, 0.0]), (5, [0.2, 0.8]), (7, [0.1, 0.9])],
        "id INT, scores ARRAY<DOUBLE>")
    right = spark.createDataFrame(
        [(1, [0.2, 0.8]), (2, [0.1, 0.9]), (3, [0.1, 0.9]), (4, [0.0, 0.0]), (5, [0.5, 0.5]), (6, [0.1])],
        "id INT, scores ARRAY<DOUBLE>")
    got = {r["id"]: r for r in evaluate.compare_scores(left, right, "id").collect()}
    assert [got[i]["status"] for i in range(1, 8)] == [
        "compared", "non-finite", "sizes differ", "compared", "compared", "missing", "missing"]
    assert round(got[1]["mae"], 9) == 0.1 and got[1]["diagnosis"] == "both sides vary"
    assert got[4]["cosine"] == 0 and got[4]["diagnosis"] == "both sides near-constant"
    assert got[5]["diagnosis"] == "second side collapsed"
    whole = evaluate.compare_score_sets(left, right, "id").first()
    assert whole["same_size"] is False and whole["mae"] is None
    one = evaluate.compare_score_sets(left.filter("id = 1"), right.filter("id = 1"), "id").first()
    assert round(one["mae"], 9) == 0.1 and round(one["cosine"], 6) == round(0.74 / (0.82 ** 0.5 * 0.68 ** 0.5), 6)


def test_missing_predictions_are_counted(spark):
    df = spark.createDataFrame([("a", None), ("a", "a")], "t STRING, p STRING")
    m = {r["truth"]: (r["a"], r["null"]) for r in evaluate.confusion_matrix(df, "t", "p").collect()}
    assert m == {"a": (1, 1), "null": (0, 0)}
    assert {r["class"]: r["recall"] for r in evaluate.class_report(df, "t", "p").collect()}["a"] == 0.5
