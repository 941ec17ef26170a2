"""Column expressions that turn a score vector into a verdict."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.numeric import binary_probability

VERDICT_TYPE = (
    "struct<task_type:string,predicted_class:int,predicted_label:string,confidence:double,"
    "max_probability:double,is_attack:boolean,attack_type:string,attack_probability:double>"
)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def arg_max(scores: Column) -> Column:
    """0-based position of the first maximum; a NaN counts as the maximum (NaN sorts highest)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def max_ignoring_nan(scores: Column) -> Column:
    """Maximum without NaN; 0 if nothing finite is found."""
    top = F.array_max(scores)
    # the per-element filter runs only where there is a NaN
    best = F.when(F.isnan(top), F.array_max(F.filter(scores, lambda v: ~F.isnan(v)))).otherwise(top)
    return F.when(is_finite(best), best).otherwise(F.lit(0.0))


def benign_index(
    n_classes: Column, labels: list[str], benign_label: str = "Benign", index: int | None = None
) -> Column:
    """The given index if in range, else the label match, else 0 for two classes, else NULL."""
    target = benign_label.strip().lower()
    named = next((i for i, v in enumerate(labels) if str(v).strip().lower() == target), None)
    out = F.when(n_classes == 2, F.lit(0))
    if named is not None:
        out = F.when(n_classes == len(labels), F.lit(named)).otherwise(out)
    if index is not None and index >= 0:
        out = F.when(n_classes > index, F.lit(index)).otherwise(out)
    return out.cast("int")


def verdict(
    scores: Column, labels: list[str] | None = None, benign_label: str = "Benign",
    benign_class_index: int | None = None, threshold: float = 0.5,
) -> Column:
    """A struct of eight fields for an ARRAY<DOUBLE> of scores of any size.

    Empty: unknown. One score: attack probability against ``threshold``. Several: the first
    maximum; attack unless it is the benign class.
    """
    labels = list(labels or [])
    threshold = min(max(float(threshold), 0.0), 1.0)
    vec = F.coalesce(scores.cast("array<double>"), F.array().cast("array<double>"))
    size = F.size(vec)
    none = F.lit(None).cast("string")

    p = binary_probability(F.get(vec, F.lit(0)))
    two = labels if len(labels) == 2 else [benign_label, "Attack"]
    hit = p >= threshold

    cls = arg_max(vec)
    top = F.array_max(vec)
    confidence = F.when(is_finite(top), top).otherwise(F.lit(0.0))
    best = max_ignoring_nan(vec)
    name = none
    if labels:
        name = F.when(size == len(labels), F.get(F.array(*[F.lit(str(v)) for v in labels]), cls))
    benign = benign_index(size, labels, benign_label, benign_class_index)
    attack = F.when(benign.isNull(), best >= threshold).otherwise(cls != benign)
    zero = F.lit(0.0)
    # one CASE per field, so that fields nobody reads are not computed
    fields = {
        "task_type": (F.lit("unknown"), F.lit("binary"), F.when(size > 2, "multiclass").otherwise("binary-2class")),
        "predicted_class": (F.lit(0), hit.cast("int"), cls),
        "predicted_label": (none, F.when(hit, two[1]).otherwise(two[0]), name),
        "confidence": (zero, F.when(hit, p).otherwise(1.0 - p), confidence),
        "max_probability": (zero, F.greatest(p, 1.0 - p), best),
        "is_attack": (F.lit(False), hit, attack),
        "attack_type": (none, F.when(hit, two[1]), F.when(attack, F.coalesce(name, cls.cast("string")))),
        "attack_probability": (zero, p, confidence),
    }
    types = dict(f.split(":") for f in VERDICT_TYPE[len("struct<") : -1].split(","))
    return F.struct(*[
        F.when(size == 0, empty).when(size == 1, single).otherwise(several).cast(types[n]).alias(n)
        for n, (empty, single, several) in fields.items()
    ])


def max_score_alert(scores: Column, threshold: float = 0.5) -> Column:
    """The plain rule: highest score strictly above the threshold."""
    return F.coalesce(F.array_max(scores.cast("array<double>")) > threshold, F.lit(False))


def score_health(scores: Column) -> Column:
    """Struct: any non-finite score; near-uniform (population std < 1e-7 with several scores)."""
    vec = scores.cast("array<double>")
    bad = F.coalesce(F.exists(vec, lambda v: ~is_finite(v)), F.lit(False))
    std = array_std(vec)
    uniform = (F.size(vec) > 1) & F.coalesce(std < 1e-7, F.lit(False))  # NaN is above any number
    return F.struct(bad.alias("has_non_finite"), uniform.alias("near_uniform"), std.alias("output_std"))


def array_std(vec: Column) -> Column:
    """Population standard deviation of the elements in one pass; 0 for fewer than two."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, v: Column) -> Column:
        n = acc["n"] + 1.0
        mean = acc["mean"] + (v - acc["mean"]) / n
        m2 = acc["m2"] + (v - acc["mean"]) * (v - mean)
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    return F.aggregate(
        vec, start, add, lambda acc: F.when(acc["n"] < 2, F.lit(0.0)).otherwise(F.sqrt(acc["m2"] / acc["n"]))
    )
