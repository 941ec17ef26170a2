"""Counts, fitted parameters and statistics. Every operator is one partially aggregated pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from flowspark.functions.categorical import FIXED_LEVEL_CAPS
from flowspark.functions.numeric import NUMERIC_FILTER, clean_numeric, quoted
from flowspark.operators.order import rank_rows
from flowspark.schemas import (
    CategoricalParams, FittedParams, ModelInputSpec, NumericParams, level_type_of_column,
    require_columns,
)
from flowspark.session import lookup_join
from flowspark.specs import DatasetSpec


def label_distribution(df: DataFrame, label: str = "Attack") -> DataFrame:
    """Rows and percent per label, most frequent first."""
    require_columns(df, [label])
    counts = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    shares = df.sparkSession.sql(
        "SELECT *, n_rows * 100.0D / (SELECT sum(n_rows) FROM {counts}) AS percent FROM {counts}",
        counts=counts,
    )
    return shares.orderBy(F.desc("n_rows"), F.asc(label))


def fit_numeric(
    df: DataFrame, features: list[str], where: Column | None = None,
    limit: float = NUMERIC_FILTER,
) -> DataFrame:
    """(feature, min, range) after cleaning, over the rows satisfying ``where``, in one pass."""
    require_columns(df, features)
    src = df if where is None else df.filter(where)
    aggs = []
    for i, f in enumerate(features):
        x = clean_numeric(quoted(f), limit)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    one = src.agg(*aggs)
    entries = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f"lo{i}").alias("min"),
            (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("range"),
        )
        for i, f in enumerate(features)
    ]
    return one.select(F.inline(F.array(*entries)))


def count_levels(
    df: DataFrame, features: list[str], where: Column | None = None, among: DataFrame | None = None
) -> DataFrame:
    """(feature, level, n, sort keys) for all features in one pass; NULL is not a level. ``among`` (feature, text, as_int)
    names the levels to count, if not all."""
    require_columns(df, features)
    src = df if where is None else df.filter(where)
    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {f: level_type_of_column(types[f]) for f in features}
    entries = []
    for f, kind in kinds.items():
        x = quoted(f)
        entries.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(kind).alias("level_type"),
                # whole numbers are counted as such; only the counted levels become text
                (F.lit(None) if kind == "int" else x).cast("string").alias("text"),
                (x if kind == "int" else F.lit(None)).cast("bigint").alias("as_int"),
                (x if kind == "float" else F.lit(None)).cast("double").alias("as_float"),
            )
        )
    stacked = src.select(F.inline(F.array(*entries))).filter("text IS NOT NULL OR as_int IS NOT NULL")
    if among is not None:
        wanted = among.select(*[F.col(c).alias(f"_w_{c}") for c in ("feature", "text", "as_int")])
        same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in ("feature", "text", "as_int")]
        stacked = stacked.join(wanted, same[0] & same[1] & same[2], "left_semi")
    counted = stacked.groupBy("feature", "level_type", "text", "as_int", "as_float").agg(F.count("*").alias("n"))
    level = F.coalesce("text", F.col("as_int").cast("string")).alias("level")
    return counted.select("feature", "level_type", level, "as_int", "as_float", "n")


def rank_levels(levels: DataFrame, caps: dict[str, int], default_cap: int) -> DataFrame:
    """Top levels per feature by count descending, then level ascending (numbers as numbers).

    The rank filter is applied before the shuffle as well (partial top-k per task), so a feature
    with very many levels does not meet in one task.
    """
    by_count = W.Window.partitionBy("feature").orderBy(
        F.desc("n"), F.asc("as_int"), F.asc("as_float"), F.asc("level")
    )
    widest = max([default_cap, *caps.values()])
    top = levels.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= widest)
    cap = F.lit(default_cap)
    for f, k in caps.items():
        cap = F.when(F.col("feature") == f, F.lit(k)).otherwise(cap)
    return top.filter(F.col("rank") <= cap).select("feature", "level_type", "level", "n", "rank")


def fit_categorical(
    df: DataFrame, features: list[str], top_k: int = 32, where: Column | None = None,
    caps: dict[str, int] | None = None,
) -> DataFrame:
    """(feature, level_type, level, n, rank): the ``top_k`` most frequent levels per feature.

    ``caps`` sets another bound for single features (``FIXED_LEVEL_CAPS`` for the fixed sizes).
    """
    wanted = {f: k for f, k in (caps or {}).items() if f in features}
    return rank_levels(count_levels(df, features, where), wanted, top_k)


def fit_params(
    df: DataFrame, numerical: list[str], categorical: list[str], top_k: int = 32,
    where: Column | None = None, limit: float = NUMERIC_FILTER, caps: dict[str, int] | None = None,
) -> DataFrame:
    """One row per feature in the parameter schema."""
    return params_rows(fit_numeric(df, numerical, where, limit), fit_categorical(df, categorical, top_k, where, caps))


def params_rows(ranges: DataFrame, ranked: DataFrame) -> DataFrame:
    """Fitted ranges and ranked levels in the parameter schema."""
    num = ranges.select(
        "feature", F.lit("numerical").alias("kind"), "min", "range",
        F.lit(None).cast("array<string>").alias("levels"),
        F.lit(None).cast("string").alias("level_type"), F.lit(None).cast("int").alias("n_levels"),
    )
    cat = (
        ranked.groupBy("feature", "level_type")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "level"))).alias("l"))
        .select(
            "feature", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("min"),
            F.lit(None).cast("double").alias("range"), F.col("l.level").alias("levels"),
            "level_type", F.size("l").alias("n_levels"),
        )
    )
    return num.unionByName(cat)


def collect_params(
    df: DataFrame, spec: DatasetSpec, top_k: int = 32, where: Column | None = None,
    limit: float = NUMERIC_FILTER, caps: dict[str, int] | None = None, **settings,
) -> FittedParams:
    """Fit and fetch: at most features x ``top_k`` values come to the driver."""
    rows = fit_params(df, spec.numerical, spec.categorical, top_k, where, limit, caps).collect()
    found = FittedParams.from_rows(rows, top_k=top_k, **settings)
    num = {}
    for f in spec.numerical:
        p = found.numerical[f]
        num[f] = p if p.min is not None else NumericParams(0.0, 0.0)
    cat = {f: found.categorical.get(f, CategoricalParams((), 0)) for f in spec.categorical}
    return FittedParams(num, cat, found.window_size, top_k, found.clip_numerical)


def class_lists(
    df: DataFrame, label: str = "Attack", benign: str = "Benign", idx: str = "idx"
) -> DataFrame:
    """Classes with their order of first appearance; ``is_attack`` marks the non-benign ones."""
    firsts = df.groupBy(F.col(label).alias("class")).agg(F.min(idx).alias("first_idx"))
    return rank_rows(firsts, ["first_idx"], "position").select(
        "class", "first_idx", F.col("position").cast("int").alias("position"),
        is_positive(F.col("class"), benign).alias("is_attack"),
    )


def is_positive(label: Column, benign: str = "Benign") -> Column:
    """True for every label other than the benign one, compared as text."""
    return F.coalesce(label.cast("string") != F.lit(str(benign)), F.lit(True))


def class_codes(df: DataFrame, label: str = "Attack") -> DataFrame:
    """(class, code): distinct classes numbered 0.. in ascending order."""
    distinct = df.select(F.col(label).alias("class")).filter("class IS NOT NULL").distinct()
    return rank_rows(distinct, ["class"], "code").select("class", F.col("code").cast("int").alias("code"))


def encode_labels(df: DataFrame, label: str = "Attack", out: str = "y") -> DataFrame:
    table = class_codes(df, label).select(F.col("class").alias(label), F.col("code").alias(out))
    return lookup_join(df, table, [label])


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: n, min, max, mean, population std and non-zero count, in one pass.

    Array features count every element.
    """
    require_columns(df, features)
    types = {f.name: f.dataType for f in df.schema.fields}
    plain = [f for f in features if not isinstance(types[f], T.ArrayType)]
    arrays = [f for f in features if f not in plain]

    def measures(x: Column) -> dict[str, Column]:
        return {
            "n_values": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x),
            "std": F.stddev_pop(x), "non_zero": F.count_if(x != 0),
        }

    out = None
    if plain:
        # one row with all aggregates, then one row per feature
        wide = df.agg(*[
            v.alias(f"{m}_{i}") for i, f in enumerate(plain) for m, v in measures(quoted(f).cast("double")).items()
        ])
        entries = [
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{m}_{i}").alias(m) for m in measures(F.lit(0.0))])
            for i, f in enumerate(plain)
        ]
        out = wide.select(F.inline(F.array(*entries)))
    if arrays:
        entries = []
        for f in arrays:
            flat = F.flatten(quoted(f)) if isinstance(types[f].elementType, T.ArrayType) else quoted(f)
            vals = F.transform(flat, lambda v: v.cast("double"))
            entries.append(F.struct(F.lit(f).alias("feature"), vals.alias("vals")))
        rows = df.select(F.inline(F.array(*entries))).select("feature", F.explode("vals").alias("x"))
        found = rows.groupBy("feature").agg(*[v.alias(m) for m, v in measures(F.col("x")).items()])
        out = found if out is None else out.unionByName(found)
    return out


def levels_per_feature(codes: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n_codes): distinct integer codes that occur."""
    require_columns(codes, features)
    entries = [
        F.struct(F.lit(f).alias("feature"), quoted(f).cast("int").alias("code")) for f in features
    ]
    pairs = codes.select(F.inline(F.array(*entries))).distinct()
    return pairs.groupBy("feature").agg(F.count("code").alias("n_codes"))


def observed_codes(codes: DataFrame, features: list[str]) -> dict[str, list[int]]:
    """The codes that occur per feature, sorted (at most levels + 1 each)."""
    entries = [
        F.struct(F.lit(f).alias("feature"), quoted(f).cast("int").alias("code")) for f in features
    ]
    rows = codes.select(F.inline(F.array(*entries))).distinct().collect()
    out: dict[str, list[int]] = {f: [] for f in features}
    for r in rows:
        out[r["feature"]].append(r["code"])
    return {f: sorted(v) for f, v in out.items()}


def eval_sizes(df: DataFrame, role: str = "role", label: str = "Attack") -> DataFrame:
    """Evaluation rows per class."""
    return df.filter(F.col(role) == "eval").groupBy(label).agg(F.count("*").alias("n_eval"))


def input_spec(
    params: FittedParams, categorical_format: str, widths: dict[str, int],
    classes: list[str] = (), benign: str = "Benign",
) -> ModelInputSpec:
    return ModelInputSpec(
        tuple(params.features), len(params.numerical),
        tuple(widths[f] for f in params.categorical), categorical_format,
        tuple(classes), tuple(c for c in classes if c != benign),
    )


__all__ = [
    "FIXED_LEVEL_CAPS", "class_codes", "class_lists", "collect_params", "count_levels",
    "encode_labels", "eval_sizes", "feature_statistics", "fit_categorical", "fit_numeric",
    "fit_params", "input_spec", "is_positive", "label_distribution", "levels_per_feature",
    "observed_codes", "params_rows", "rank_levels",
]
