"""Training and evaluation: a flow table to an encoded, split table, a model and its report."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.categorical import UNKNOWN_FIRST, UNKNOWN_ZERO
from flowspark.operators import evaluate, score, split, stats, windows
from flowspark.operators.encode import Encoder, encode_codes
from flowspark.operators.order import order_rows
from flowspark.operators.prepare import project_spec
from flowspark.schemas import FittedParams, ModelInputSpec
from flowspark.session import lookup_join, materialize
from flowspark.sources.cache import cache_key, cached
from flowspark.specs import NFV1, DatasetSpec

# Classes a model may have.
MAX_CLASSES = 10_000

LAST_ROWS, RANDOM_ROWS, FILTER_COLUMN = "last_rows", "random_rows", "filter_column"


@dataclass(frozen=True)
class Preprocessing:
    """The built-in ``Encoder``: cleaned numbers, log min-max scaling, top-K level codes.

    ``unknown`` and ``floor`` default to the serving behaviour; "first" and False give the training
    variant. ``caps`` bounds the levels of single features.
    """

    top_k: int = 32
    clip_numerical: bool = False
    floor: bool = True
    unknown: str = UNKNOWN_ZERO
    limit: float = 1e9
    caps: tuple[tuple[str, int], ...] = ()

    def fit(self, df: DataFrame, spec: DatasetSpec, where: Column | None = None) -> FittedParams:
        found = stats.collect_params(df, spec, self.top_k, where, self.limit, dict(self.caps))
        return replace(found, clip_numerical=self.clip_numerical)

    def transform(self, df: DataFrame, params: FittedParams, keep: list[str]) -> DataFrame:
        return encode_codes(df, params, keep, self.floor, self.unknown, self.limit)

    @classmethod
    def as_in_training(cls, top_k: int = 32) -> Preprocessing:
        return cls(top_k=top_k, floor=False, unknown=UNKNOWN_FIRST)


@dataclass(frozen=True)
class EncodedDataset:
    """``table``: idx, training, label, y and the encoded features. ``class_map`` holds the class of each
    code y, as text; a row without class has no code. ``spec.classes`` lists the classes of the whole
    input in order of first appearance, also those beyond the row limit."""

    table: DataFrame
    params: FittedParams
    spec: ModelInputSpec
    n_rows: int
    eval_percent: float
    class_map: tuple[str, ...]


def load_dataset(
    df: DataFrame, order: list[str], spec: DatasetSpec = NFV1, sampling: str = LAST_ROWS,
    eval_percent: float = 0.2, n_rows: int = 0, window: int = 8, seed: int = 42,
    prep: Encoder = Preprocessing(), categorical_format: str = "onehot",
) -> EncodedDataset:
    """Index, split, encode labels, clean, fit on the training rows, encode all rows.

    Classes are listed before the row limit applies. The only shuffle of all rows is the index.
    """
    cls = spec.class_column
    extra = [spec.test_column] if sampling == FILTER_COLUMN and spec.test_column else []
    keep = list(dict.fromkeys([*order, *extra]))
    ordered = order_rows(project_spec(df, spec, keep), order)
    full = ordered.indexed().drop("_part", "_pos")
    classes = [
        r["class"] for r in
        stats.class_lists(full, cls, spec.benign_label).orderBy("position").collect()
        if r["class"] is not None
    ]
    n = ordered.n if not 0 < n_rows < ordered.n else n_rows
    rows = full if n == ordered.n else full.filter(F.col("idx") < n)
    if sampling == LAST_ROWS:
        rows = split.split_last_rows(rows, eval_percent, n)
    elif sampling == RANDOM_ROWS:
        rows = split.split_random_rows(rows, eval_percent, seed, window, n)
    elif sampling == FILTER_COLUMN:
        last = [c for c in rows.columns if c not in (spec.test_column, "idx")]
        rows = split.split_filter_column(rows.select(*[f"`{c}`" for c in last], spec.test_column, "idx"), spec.test_column, window)
    else:
        raise ValueError(f"unknown sampling {sampling!r}")
    codes = stats.class_codes(rows, cls)
    found = codes.orderBy("code").limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    class_map = tuple(str(r["class"]) for r in found)
    rows = lookup_join(rows, codes.select(F.col("class").alias(cls), F.col("code").alias("y")), [cls])
    params = replace(prep.fit(rows, spec, F.col("training")), window_size=window)
    table = prep.transform(rows, params, ["idx", "training", cls, "y"])
    table = materialize(table, "encoded")
    ordered.release()
    if categorical_format == "integers":
        widths = {r["feature"]: r["n_codes"] for r in stats.levels_per_feature(table, spec.categorical).collect()}
    else:
        widths = {f: p.n_levels for f, p in params.categorical.items()}
    spec_out = stats.input_spec(params, categorical_format, widths, [str(c) for c in classes], spec.benign_label)
    return EncodedDataset(table, params, spec_out, n, eval_percent, class_map)


def load_cached(
    spark: SparkSession, folder: str, name: str, df: DataFrame, order: list[str], **options
) -> EncodedDataset:
    """``load_dataset`` through the preprocess cache."""
    prep: Preprocessing = options.get("prep", Preprocessing())
    n_rows = options.get("n_rows", 0)
    local = {k: str(v) for k, v in sorted(options.items()) if k != "prep"}
    local["order"] = str(order)
    key = cache_key(name, n_rows, {k: str(v) for k, v in vars(prep).items()}, local)

    def build() -> tuple[DataFrame, str]:
        made = load_dataset(df, order, **options)
        doc = {
            "params": made.params.to_json(), "spec": made.spec.to_json(), "n_rows": made.n_rows,
            "eval_percent": made.eval_percent, "class_map": list(made.class_map),
        }
        return made.table, json.dumps(doc)

    table, text = cached(spark, folder, key, build)
    doc = json.loads(text)
    return EncodedDataset(
        table, FittedParams.from_json(doc["params"]), ModelInputSpec.from_json(doc["spec"]),
        doc["n_rows"], doc["eval_percent"], tuple(doc["class_map"]),
    )


def window_roles(data: EncodedDataset, window: int = 8) -> DataFrame:
    """The table with ``role``; rows without a class are neither trained on nor evaluated."""
    selectable = split.selectable_multiclass(data.n_rows, data.eval_percent, window)
    return split.index_sets(data.table, selectable & F.col("y").isNotNull())


def window_sets(
    data: EncodedDataset, label: str = "Attack", pooling: str = "flatten", window: int = 8, role: str | None = None
) -> DataFrame:
    """(idx, role, label, y, features) for every training and evaluation window, or those of one role."""
    wanted = F.col("role") != "none" if role is None else F.col("role") == role
    found = windows.sliding_windows(
        window_roles(data, window), list(data.spec.feature_names), window, keep=["role", label, "y"], ends=wanted
    )
    return score.window_vectors(found, data.params, pooling, keep=["idx", "role", label, "y"], window=window)


def training_batches(
    data: EncodedDataset, label: str = "Attack", pooling: str = "flatten", window: int = 8, batch: int = 128,
    steps: int = 64, seed: int = 42,
) -> DataFrame:
    """(step, slot, y, features): balanced batches of training windows, ``batch`` * ``steps`` rows whatever
    the size of the table.

    Classes take turns in order of first appearance; a class with too few rows for the cursor of a
    sequential plan is drawn with replacement, as are then all others. Windows are built at the
    planned rows only.
    """
    roles = window_roles(data, window)
    sizes = {str(r[0]): r[1] for r in roles.filter("role = 'train'").groupBy(label).count().limit(MAX_CLASSES).collect()}
    shares = split.batch_shares([c for c in data.spec.classes if sizes.get(c)], batch)
    mode = "sequential" if all(sizes[c] > m for c, m in shares.items()) else "replace"
    plan = materialize(split.plan_batches(split.class_rows(roles, label), shares, steps, mode, seed), "plan")
    names = list(data.spec.feature_names)
    found = windows.windows_at(roles, plan.select("idx"), names, window, keep=["y"])
    vectors = score.window_vectors(found, data.params, pooling, keep=["idx", "y"], window=window)
    return plan.select("step", "slot", "idx").join(vectors, "idx").select("step", "slot", "y", "features")


def binary_batches(
    data: EncodedDataset, label: str = "Attack", pooling: str = "flatten", window: int = 8, batch: int = 128,
    steps: int = 64, seed: int = 42,
) -> DataFrame:
    """(step, slot, Attack, features): the same for attack against benign, half of each batch, drawn
    without replacement inside a batch where the classes allow it."""
    roles = window_roles(data, window).withColumn("_side", split.binary_class(F.col(label)))
    shares = split.binary_shares(batch)
    sizes = {r[0]: r[1] for r in roles.filter("role = 'train'").groupBy("_side").count().collect()}
    mode = "distinct" if all(sizes.get(c, 0) >= m for c, m in shares.items()) else "replace"
    plan = materialize(split.plan_batches(split.class_rows(roles, "_side"), shares, steps, mode, seed), "plan")
    found = windows.windows_at(roles, plan.select("idx"), list(data.spec.feature_names), window, keep=[label])
    vectors = score.window_vectors(found, data.params, pooling, keep=["idx", label], window=window)
    return plan.select("step", "slot", "idx").join(vectors, "idx").select("step", "slot", label, "features")


def train_and_evaluate(
    data: EncodedDataset, label: str = "Attack", pooling: str = "flatten", window: int = 8,
    hidden: tuple[int, ...] = (128,), max_iter: int = 50, seed: int = 42, batch: int = 128, steps: int = 64,
) -> tuple[object, DataFrame, DataFrame]:
    """Fit on the balanced training batches; class report and scored evaluation windows.

    The fitted rows are bounded by ``batch`` * ``steps``; every evaluation window is scored.
    """
    batches = materialize(training_batches(data, label, pooling, window, batch, steps, seed), "batches")
    width = score.record_width(data.params) * (window if pooling == "flatten" else 1)
    model = score.fit_window_classifier(batches, width, max(len(data.class_map), 2), "y", hidden, max_iter, seed)
    scored = score.score(window_sets(data, label, pooling, window, "eval"), model)
    names = F.array(*[F.lit(c) for c in data.class_map])
    best = F.array_position("scores", F.array_max("scores")).cast("int")
    # a task of one class has a second, empty output
    judged = scored.drop("features").withColumn("predicted", F.get(names, best - 1))
    judged = materialize(judged, "judged")
    return model, evaluate.class_report(judged, label, "predicted"), judged
