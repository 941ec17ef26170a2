"""Fitting and applying window classifiers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.operators.stats import is_positive
from flowspark.operators.windows import pool_window, record_vector
from flowspark.schemas import FittedParams


class Scorer(Protocol):
    """Scores a batch: one array per input, in order, to one row of scores per sample."""

    def __call__(self, inputs: list[np.ndarray]) -> np.ndarray: ...


def record_width(params: FittedParams, dims: dict[str, int] | None = None) -> int:
    wide = sum((dims or {}).get(f, p.n_levels) for f, p in params.categorical.items())
    return len(params.numerical) + wide


def window_vectors(
    windows: DataFrame, params: FittedParams, pooling: str = "flatten",
    dims: dict[str, int] | None = None, keep: list[str] | None = None, window: int | None = None,
) -> DataFrame:
    """Encoded windows to one feature array per window: record vectors, then pooling."""
    if pooling == "last":
        vectors = F.array(record_vector(F.element_at("win", -1), params, dims))
    else:
        vectors = F.transform("win", lambda row: record_vector(row, params, dims))
    features = pool_window(vectors, pooling, record_width(params, dims), window or params.window_size)
    return windows.select(*(keep or []), features.alias("features"))


def flow_vectors(
    codes: DataFrame, params: FittedParams, dims: dict[str, int] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The same for single flows (windows of one)."""
    row = F.struct(*[F.col(f"`{f}`").alias(f) for f in params.features])
    one = codes.select(*(keep or []), row.alias("_row"))
    return one.select(*(keep or []), record_vector(F.col("_row"), params, dims).alias("features"))


def _as_training(df: DataFrame, label: str) -> DataFrame:
    return df.select(
        array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label")
    )


def fit_window_classifier(
    df: DataFrame, n_features: int, n_classes: int, label: str = "y", hidden: tuple[int, ...] = (128,),
    max_iter: int = 50, seed: int = 42,
):
    """Softmax classifier over all classes, a multilayer perceptron on the window vectors.

    The optimiser makes many passes and keeps its own blocks of the data; write ``df`` to a table
    first if it is costly to compute.
    """
    return MultilayerPerceptronClassifier(
        layers=[n_features, *hidden, n_classes], maxIter=max_iter, seed=seed
    ).fit(_as_training(df, label))


def fit_binary_classifier(
    df: DataFrame, label: str = "Attack", benign: str = "Benign", max_iter: int = 50
):
    """Sigmoid classifier: attack against benign."""
    flagged = df.withColumn("_y", is_positive(F.col(label), benign).cast("double"))
    return LogisticRegression(maxIter=max_iter, regParam=1e-4).fit(_as_training(flagged, "_y"))


def stored_logistic(coefficients: list[float], intercept: float) -> LogisticRegressionModel:
    """A binary model from stored weights, in the order of ``record_vector``."""
    sc = SparkContext.getOrCreate()
    weights = _py2java(sc, Vectors.dense(coefficients))
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("stored", weights, float(intercept))
    return LogisticRegressionModel(java)


def model_score(
    model, params: FittedParams, pooling: str = "flatten", dims: dict[str, int] | None = None,
    window: int | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """A score function for detection: a fitted model applied to encoded windows."""

    def apply(windows: DataFrame) -> DataFrame:
        names = [c for c in windows.columns]
        return score(window_vectors(windows, params, pooling, dims, names, window), model).drop("features")

    return apply


def score(df: DataFrame, model, out: str = "scores") -> DataFrame:
    """Class probabilities of a fitted model as ARRAY<DOUBLE>."""
    ready = df.withColumn("_vec", array_to_vector("features"))
    applied = model.copy({model.getParam("featuresCol"): "_vec"}).transform(ready)
    scored = applied.withColumn(out, vector_to_array("probability"))
    return scored.drop("_vec", "rawPrediction", "probability", "prediction")


def score_positive(df: DataFrame, model, out: str = "score") -> DataFrame:
    """The attack probability of a binary model."""
    return score(df, model, "_p").withColumn(out, F.get("_p", F.lit(1))).drop("_p")


def score_with(
    df: DataFrame, make_scorer: Callable[[], Scorer], inputs: list[str], keep: list[str],
    out: str = "scores",
) -> DataFrame:
    """Score with any batch scorer (such as a model file): one scorer per task, Arrow batches.

    Input columns hold arrays of arrays of equal shape per column. Spark flattens them, so a batch
    becomes an array of shape (rows, steps, width) without a loop over its cells.
    """
    shapes = [f"_shape_{i}" for i in range(len(inputs))]
    ready = df.select(
        *[quoted(c) for c in keep],
        *[F.flatten(quoted(c)).cast("array<float>").alias(f"_in_{i}") for i, c in enumerate(inputs)],
        *[F.size(F.get(quoted(c), F.lit(0))).alias(shapes[i]) for i, c in enumerate(inputs)],
    )
    kept = df.select(*[quoted(c) for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            scorer = scorer or make_scorer()
            arrays = []
            for i in range(len(inputs)):
                cells = batch.column(f"_in_{i}")
                flat = cells.flatten().to_numpy(zero_copy_only=False)
                arrays.append(flat.reshape(batch.num_rows, -1, batch.column(shapes[i])[0].as_py()))
            result = np.ascontiguousarray(scorer(arrays), dtype=np.float64).reshape(batch.num_rows, -1)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * result.shape[1]
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(result.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], names=[*keep, out])

    return ready.mapInArrow(run, f"{schema}, `{out}` array<double>")


def onnx_scorer(path: str, output: int = 0) -> Callable[[], Scorer]:
    """Scorer for an ONNX file that executors can read, or that was shipped by
    ``SparkContext.addFile``; needs ``onnxruntime`` on the workers. Inputs come in model order."""

    def make() -> Scorer:
        import onnxruntime

        local = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        session = onnxruntime.InferenceSession(local, providers=["CPUExecutionProvider"])
        names = [i.name for i in session.get_inputs()]
        return lambda arrays: session.run(None, dict(zip(names, arrays)))[output]

    return make
