"""Whole-table encoding: one map-only projection per table."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.categorical import (
    UNKNOWN_ZERO, fixed_width_of, level_code, one_hot, one_hot_fitted, one_hot_over,
)
from flowspark.functions.numeric import clean_numeric, log_minmax, quoted
from flowspark.schemas import FittedParams, require_columns
from flowspark.session import lookup_join, small_table
from flowspark.specs import DatasetSpec

class Encoder(Protocol):
    """How a table is fitted and encoded; implement it to replace the built-in encoding."""

    def fit(self, df: DataFrame, spec: DatasetSpec, where: Column | None = None) -> FittedParams: ...

    def transform(self, df: DataFrame, params: FittedParams, keep: list[str]) -> DataFrame: ...


# Levels up to this number are matched inside the projection, more by a lookup join.
MAX_INLINE_LEVELS = 256


def scaled_columns(
    params: FittedParams, floor: bool = True, limit: float | None = None
) -> dict[str, Column]:
    """Scaled value per numeric feature; ``limit`` also applies the out-of-range filter."""
    out = {}
    for f, p in params.numerical.items():
        x = quoted(f) if limit is None else clean_numeric(quoted(f), limit)
        out[f] = log_minmax(x, p, params.clip_numerical, floor)
    return out


def encode_codes(
    df: DataFrame, params: FittedParams, keep: list[str] | None = None, floor: bool = True,
    unknown: str = UNKNOWN_ZERO, limit: float | None = None,
) -> DataFrame:
    """Kept columns, scaled numbers and integer level codes under the features' own names.

    This is the form that travels through shuffles; one-hot vectors are built after them.
    """
    require_columns(df, params.features)
    types = {f.name: f.dataType for f in df.schema.fields}
    # a level beyond the one-hot width cannot be represented and counts as unknown
    levels = {f: p.levels[: p.n_levels] for f, p in params.categorical.items()}
    long_lists = [f for f, v in levels.items() if len(v) > MAX_INLINE_LEVELS]
    joined = df
    for f in long_lists:
        joined = _join_codes(joined, f, levels[f], unknown)
    cols = [quoted(c) for c in keep or []]
    cols += [x.alias(f) for f, x in scaled_columns(params, floor, limit).items()]
    for f in params.categorical:
        code = (
            F.col(f"_code_{f}") if f in long_lists
            else level_code(quoted(f), types[f], levels[f], unknown)
        )
        cols.append(code.alias(f))
    return joined.select(*cols)


def _join_codes(df: DataFrame, feature: str, levels, unknown: str) -> DataFrame:
    dtype = df.schema[feature].dataType
    text = dtype.simpleString() == "string"
    if text != isinstance(levels[0], str):
        return df.withColumn(f"_code_{feature}", F.lit(0 if unknown == UNKNOWN_ZERO else 1))
    rows = [(str(v), i + 1) for i, v in enumerate(levels)]
    table = small_table(df.sparkSession, rows, "_level STRING, _code INT").withColumn(
        "_level", F.col("_level").cast(dtype)
    )
    out = lookup_join(df.withColumn("_level", quoted(feature)), table, ["_level"])
    other = 0 if unknown == UNKNOWN_ZERO else 1
    return out.withColumn(f"_code_{feature}", F.coalesce("_code", F.lit(other))).drop("_level", "_code")


def one_hot_columns(
    params: FittedParams, dims: dict[str, int] | None = None, unknown_flag: bool = True
) -> dict[str, Column]:
    """One-hot vector per categorical feature of an ``encode_codes`` table, fitted to ``dims``."""
    out = {}
    for f, p in params.categorical.items():
        expected = (dims or {}).get(f, p.n_levels)
        out[f] = one_hot_fitted(quoted(f), p.n_levels, expected, unknown_flag)
    return out


def encode_vectors(
    df: DataFrame, params: FittedParams, keep: list[str] | None = None,
    dims: dict[str, int] | None = None, unknown_flag: bool = True, floor: bool = True,
    limit: float | None = None,
) -> DataFrame:
    """Scaled numbers as FLOAT and one-hot vectors as ARRAY<FLOAT>."""
    codes = encode_codes(df, params, keep, floor, limit=limit)
    cols = [quoted(c) for c in keep or []]
    cols += [quoted(f).cast("float").alias(f) for f in params.numerical]
    cols += [v.alias(f) for f, v in one_hot_columns(params, dims, unknown_flag).items()]
    return codes.select(*cols)


def one_hot_observed(codes: DataFrame, observed: dict[str, list[int]]) -> DataFrame:
    """Wide 0/1 columns ``{feature}_{code}`` for the codes that occur; other columns are kept."""
    out = [quoted(c) for c in codes.columns if c not in observed]
    for f, values in observed.items():
        for code in values:
            hit = F.when(quoted(f) == code, F.lit(1.0)).otherwise(F.lit(0.0))
            out.append(hit.cast("float").alias(f"{f}_{code}"))
    return codes.select(*out)


def observed_vectors(codes: DataFrame, observed: dict[str, list[int]]) -> DataFrame:
    """The same as one vector per feature."""
    return codes.withColumns({f: one_hot_over(quoted(f), v) for f, v in observed.items()})


def one_hot_fixed(codes: DataFrame, params: FittedParams) -> DataFrame:
    """Vectors of fixed width whose position is the code itself, so position 0 stays empty."""
    return codes.withColumns({
        f: one_hot(quoted(f), fixed_width_of(f, len(p.levels)), first_code=0)
        for f, p in params.categorical.items()
    })


def preprocess_table(
    df: DataFrame, params: FittedParams, drop_original: bool = False, keep_other: bool = True
) -> DataFrame:
    """Wide output: ``F_preprocessed`` and ``F_onehot_i``, or ``F`` and ``F_i`` when the originals
    are dropped. Columns outside the parameters are kept on demand."""
    require_columns(df, params.features)
    features = set(params.features)
    types = {f.name: f.dataType for f in df.schema.fields}
    if keep_other:
        cols = [quoted(c) for c in df.columns if not (drop_original and c in features)]
    else:
        cols = []
    for f, x in scaled_columns(params).items():
        cols.append(x.cast("float").alias(f if drop_original else f"{f}_preprocessed"))
    for f, p in params.categorical.items():
        stem = f if drop_original else f"{f}_onehot"
        code = level_code(quoted(f), types[f], p.levels)
        for i in range(p.n_levels):
            hit = F.when(code == i + 1, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")
            cols.append(hit.alias(f"{stem}_{i}"))
    return df.select(*cols)
