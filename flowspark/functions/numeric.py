"""Column expressions for numeric features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.schemas import NumericParams

NUMERIC_FILTER = 1e9


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def int_div(x: Column, n: int | Column) -> Column:
    """Integer division, exact for any BIGINT."""
    return F.call_function("div", x, F.lit(n) if isinstance(n, int) else n)


def finite_or_zero(x: Column) -> Column:
    x = x.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return F.when(ok, x).otherwise(F.lit(0.0))


def clean_numeric(x: Column, limit: float = NUMERIC_FILTER) -> Column:
    """Missing, non-finite or out-of-range values become 0; the bounds themselves are kept.

    NaN and infinity sort above every number in Spark, so one comparison rejects them too.
    """
    x = x.cast("double")
    return F.when(F.abs(x) <= F.lit(float(limit)), x).otherwise(F.lit(0.0))


def log_minmax(
    x: Column, params: NumericParams, clip: bool = False, floor: bool = True
) -> Column:
    """Logarithmic min-max scaling, about 0..1 over the fitted range.

    With ``floor`` values below the fitted minimum give 0. Without it the raw logarithm is kept:
    NaN for a negative argument, minus infinity for zero.
    """
    if params.range == 0:
        return F.lit(0.0)
    arg = finite_or_zero(x) - F.lit(float(params.min)) + F.lit(1.0)
    unit = F.lit(1.0 / math.log(params.range + 1.0))
    if floor:
        y = F.log(F.greatest(arg, F.lit(1.0))) * unit
    else:
        y = (
            F.when(arg > 0, F.log(arg) * unit)
            .when(arg == 0, F.lit(-math.inf))
            .otherwise(F.lit(math.nan))
        )
    if clip:
        # NaN stays NaN
        y = F.when(F.isnan(y), y).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))
    return y


def binary_probability(x: Column) -> Column:
    """A raw score as probability: non-finite is 0, outside 0..1 goes through the sigmoid."""
    x = x.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return (
        F.when(~finite, F.lit(0.0))
        .when((x < 0.0) | (x > 1.0), F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))
        .otherwise(x)
    )
