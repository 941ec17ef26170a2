"""Scaling, level codes, one-hot vectors and width fitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.catalog.base import (
    FLOWS, bits, encoded_sql, params_sql, query, rounded_features, rounded_features_sql,
)
from flowspark.flows import flows
from flowspark.functions.categorical import FIXED_LEVEL_CAPS, UNKNOWN_FIRST, fit_width, one_hot
from flowspark.functions.numeric import log_minmax, quoted
from flowspark.operators import encode, stats
from flowspark.schemas import NumericParams
from flowspark.specs import NFV1

ENCODED = f"WITH f AS ({FLOWS}), {params_sql('f')}, e AS ({encoded_sql('f', ['flow_id', 'Attack'])})"


def fitted(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f, stats.collect_params(f, NFV1)


@query("e1_e4_encode_flows", f"{ENCODED} SELECT flow_id, Attack, {rounded_features_sql()} FROM e")
def _encode_flows(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    codes = encode.encode_codes(f, params, keep=["flow_id", "Attack"])
    return codes.select("flow_id", "Attack", *rounded_features())


@query(
    "e2_scale_without_floor",
    f"""SELECT flow_id, CASE WHEN OUT_BYTES - 200 + 1 > 0 THEN round(ln(OUT_BYTES - 200 + 1) / ln(1001), 6) END AS scaled,
    OUT_BYTES - 200 + 1 < 0 AS below FROM ({FLOWS}) q""",
)
def _scale_without_floor(spark, sf_dir):
    y = log_minmax(F.col("OUT_BYTES"), NumericParams(200.0, 1000.0), floor=False)
    out = flows(spark, sf_dir).select("flow_id", y.alias("y"))
    finite = ~F.isnan("y") & (F.col("y") != float("-inf"))
    return out.select("flow_id", F.when(finite, F.round("y", 6)).alias("scaled"), F.isnan("y").alias("below"))


@query(
    "e3_scale_clipped",
    f"SELECT flow_id, round(least(greatest(ln(greatest(OUT_BYTES - 200 + 1, 1)) / ln(1001), 0), 1), 6) AS scaled FROM ({FLOWS}) q",
)
def _scale_clipped(spark, sf_dir):
    y = log_minmax(F.col("OUT_BYTES"), NumericParams(200.0, 1000.0), clip=True)
    return flows(spark, sf_dir).select("flow_id", F.round(y, 6).alias("scaled"))


@query(
    "e5_codes_unknown_first",
    f"WITH f AS ({FLOWS}), {params_sql('f')}, e AS ({encoded_sql('f', ['flow_id'], 1)}) "
    f"SELECT flow_id, {', '.join(NFV1.categorical)} FROM e",
)
def _codes_unknown_first(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    codes = encode.encode_codes(f, params, keep=["flow_id"], unknown=UNKNOWN_FIRST)
    return codes.select("flow_id", *NFV1.categorical)


def one_hot_sql(code: str, width: str) -> str:
    return (
        f"CASE WHEN {code} BETWEEN 1 AND {width} THEN repeat('0', {code} - 1) || '1' || repeat('0', CAST({width} - {code} AS INT)) "
        f"ELSE repeat('0', CAST({width} AS INT)) END"
    )


WIDTHS = ", ".join(f"(SELECT max(c) FROM c_{f}) AS n_{f}" for f in NFV1.categorical)


@query(
    "e6_one_hot",
    f"{ENCODED}, n AS (SELECT {WIDTHS}) SELECT flow_id, "
    + ", ".join(f"{one_hot_sql(f, f'n_{f}')} AS {f}" for f in NFV1.categorical)
    + " FROM e CROSS JOIN n",
)
def _one_hot(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    vec = encode.encode_vectors(f, params, keep=["flow_id"])
    return vec.select("flow_id", *[bits(quoted(c)).alias(c) for c in NFV1.categorical])


def digits(feature: str, codes) -> Column:
    """The 0/1 columns of a feature, in order of code, as one text; their number depends on the data."""
    return F.concat(*[quoted(f"{feature}_{c}").cast("int").cast("string") for c in codes]).alias(feature)


def digits_sql(code: str) -> str:
    return ", ".join(f"{one_hot_sql(code.format(f), f'n_{f}')} AS {f}" for f in NFV1.categorical)


@query("e7_one_hot_observed", f"{ENCODED}, n AS (SELECT {WIDTHS}) SELECT flow_id, {digits_sql('greatest({}, 1)')} FROM e CROSS JOIN n")
def _one_hot_observed(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    codes = encode.encode_codes(f, params, keep=["flow_id"], unknown=UNKNOWN_FIRST)
    codes = codes.select("flow_id", *NFV1.categorical)
    observed = stats.observed_codes(codes, NFV1.categorical)
    wide = encode.one_hot_observed(codes, observed)
    return wide.select("flow_id", *[digits(c, observed[c]) for c in NFV1.categorical])


def fixed_hot_sql(f: str, cap: int, width: int) -> str:
    """Position = code; unknown takes the code of the top level."""
    code = f"(CASE WHEN {f} BETWEEN 1 AND {cap} THEN {f} ELSE 1 END)"
    return f"repeat('0', {code}) || '1' || repeat('0', {width - 1} - {code}) AS {f}"


@query(
    "e8_one_hot_fixed",
    f"{ENCODED} SELECT flow_id, "
    + ", ".join(fixed_hot_sql(f, k, k + 1) for f, k in FIXED_LEVEL_CAPS.items())
    + " FROM e",
)
def _one_hot_fixed(spark, sf_dir):
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1, caps=FIXED_LEVEL_CAPS)
    codes = encode.encode_codes(f, params, keep=["flow_id"], unknown=UNKNOWN_FIRST)
    fixed = encode.one_hot_fixed(codes, params)
    return fixed.select("flow_id", *[bits(quoted(c)).alias(c) for c in FIXED_LEVEL_CAPS])


@query(
    "e9_preprocess_table",
    f"{ENCODED}, n AS (SELECT {WIDTHS}) SELECT flow_id, {', '.join(f'round({f}, 4) AS {f}' for f in NFV1.numerical)}, {digits_sql('{}')} "
    "FROM e CROSS JOIN n",
)
def _preprocess_table(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    wide = encode.preprocess_table(f, params, drop_original=True)
    numbers = [F.round(F.col(c).cast("double"), 4).alias(c) for c in NFV1.numerical]
    hot = [digits(c, range(p.n_levels)) for c, p in params.categorical.items()]
    return wide.select("flow_id", *numbers, *hot)


DIMS = {"L4_SRC_PORT": 40, "L4_DST_PORT": 32, "PROTOCOL": 4, "L7_PROTO": 16, "TCP_FLAGS": 10}


def fitted_code_sql(f: str, row: str = "r") -> str:
    """Position (from 1) of a code of ``row`` in a vector of width DIMS, 0 for none; needs ``WIDTHS``."""
    n, x = f"n.n_{f}", f"{row}.{f}"
    return (
        f"(CASE WHEN {x} BETWEEN 1 AND least({n}, {DIMS[f]}) THEN {x} "
        f"WHEN {x} = 0 AND {n} < {DIMS[f]} THEN {n} + 1 ELSE 0 END)"
    )


def fitted_sql(f: str, expected: int, flag: bool) -> str:
    n = f"n_{f}"
    at = f"CASE WHEN {f} BETWEEN 1 AND least({n}, {expected}) THEN {f} "
    at += f"WHEN {f} = 0 AND {n} < {expected} THEN {n} + 1 ELSE 0 END" if flag else "ELSE 0 END"
    return f"{one_hot_sql(f'CAST(({at}) AS INT)', str(expected))} AS {f}"


@query(
    "e10_fit_width",
    f"{ENCODED}, n AS (SELECT {WIDTHS}) SELECT flow_id, "
    + ", ".join(fitted_sql(f, d, True) for f, d in DIMS.items()) + " FROM e CROSS JOIN n",
)
def _fit_width(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    vec = encode.encode_vectors(f, params, keep=["flow_id"], dims=DIMS)
    return vec.select("flow_id", *[bits(quoted(c)).alias(c) for c in DIMS])


@query(
    "e11_fit_width_plain",
    f"{ENCODED}, n AS (SELECT {WIDTHS}) SELECT flow_id, "
    + ", ".join(fitted_sql(f, d, False) for f, d in DIMS.items()) + " FROM e CROSS JOIN n",
)
def _fit_width_plain(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    codes = encode.encode_codes(f, params, keep=["flow_id"])
    vecs = {
        c: fit_width(one_hot(quoted(c), params.categorical[c].n_levels), params.categorical[c].n_levels, d, False)
        for c, d in DIMS.items()
    }
    return codes.select("flow_id", *[bits(v).alias(c) for c, v in vecs.items()])


@query(
    "g8_levels_per_feature",
    f"{ENCODED} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS n_codes FROM e" for f in NFV1.categorical
    ),
)
def _levels_per_feature(spark, sf_dir):
    f, params = fitted(spark, sf_dir)
    return stats.levels_per_feature(encode.encode_codes(f, params), NFV1.categorical)
