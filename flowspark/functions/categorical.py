"""Column expressions for categorical features: level codes, one-hot vectors, width fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.schemas import level_type_of, level_type_of_column

UNKNOWN_ZERO = "zero"
UNKNOWN_FIRST = "first"

# Level caps and one-hot widths of the fixed-size encoding.
FIXED_LEVEL_CAPS = {
    "PROTOCOL": 2, "L7_PROTO": 18, "TCP_FLAGS": 8, "L4_SRC_PORT": 31, "L4_DST_PORT": 31,
}
FIXED_WIDTHS = {
    "PROTOCOL": 3, "L7_PROTO": 19, "TCP_FLAGS": 9, "L4_SRC_PORT": 32, "L4_DST_PORT": 32,
}


def level_array(levels, dtype: T.DataType) -> Column | None:
    """Levels as a literal array comparable with a column of type ``dtype``.

    None if the kinds differ: text levels never match a number column, nor the reverse.
    """
    levels = list(levels)
    if not levels:
        return None
    kinds = {level_type_of(levels) == "string", level_type_of_column(dtype) == "string"}
    if len(kinds) > 1:
        return None
    if level_type_of_column(dtype) == "string":
        return F.array(*[F.lit(str(v)) for v in levels])
    wide = "double" if isinstance(dtype, T.FractionalType) or level_type_of(levels) == "float" else "bigint"
    return F.array(*[F.lit(v).cast(wide) for v in levels])


def level_code(x: Column, dtype: T.DataType, levels, unknown: str = UNKNOWN_ZERO) -> Column:
    """1-based code of a known level; an unknown or missing value gives 0, or 1 with
    ``unknown="first"`` (the code of the most frequent level)."""
    other = F.lit(0 if unknown == UNKNOWN_ZERO else 1)
    arr = level_array(levels, dtype)
    if arr is None:
        return other
    if level_type_of_column(dtype) == "string":
        x = x.cast("string")
    else:
        wide = isinstance(dtype, T.FractionalType) or level_type_of(levels) == "float"
        x = x.cast("double" if wide else "bigint")
    found = F.coalesce(F.array_position(arr, x).cast("int"), F.lit(0))
    return found if unknown == UNKNOWN_ZERO else F.greatest(found, other)


# Most entries of a table of one-hot vectors; a wider vector is cut out of a constant when it is needed.
TABLE_ENTRIES = 1 << 16


def one_hot(
    code: Column, width: int, first_code: int = 1, max_code: int | None = None, dtype: str = "float"
) -> Column:
    """Vector of ``width`` numbers, 1 where the position's code equals ``code``, else all zeros.

    ``code`` lies in 0..``max_code`` (default: the last position's code). The vector is looked up in a constant
    table with one per code; past ``TABLE_ENTRIES`` it is a slice of the constant ``0..0 1 0..0``, which costs a
    copy of it. Either way no per-element function runs and ``code`` is evaluated once.
    """
    if width <= 0:
        return F.array().cast(f"array<{dtype}>")
    last = max(width + first_code - 1, max_code or 0)
    ridge = np.zeros(last + width + 1, dtype={"float": np.float32, "double": np.float64}[dtype])
    ridge[last] = 1.0
    if (last + 1) * width > TABLE_ENTRIES:
        return F.slice(F.lit(ridge), F.lit(last + 1 + first_code) - code, F.lit(width))
    starts = [last + first_code - c for c in range(last + 1)]
    return F.get(F.array(*[F.lit(ridge[start : start + width]) for start in starts]), code)


def one_hot_over(code: Column, codes: list[int]) -> Column:
    """One position per listed code (the codes that occur in the training encoding)."""
    if not codes:
        return F.array().cast("array<float>")
    return F.transform(
        F.array(*[F.lit(int(c)) for c in codes]),
        lambda c: F.when(c == code, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"),
    )


def fixed_width_of(feature: str, n_levels: int) -> int:
    return FIXED_WIDTHS.get(feature, n_levels + 1)


def fit_width(vec: Column, width: int, expected: int, unknown_flag: bool = True) -> Column:
    """Cut or zero-pad a one-hot vector to the width a model expects.

    With ``unknown_flag`` the first added position is 1 for an all-zero vector.
    """
    if width == expected:
        return vec
    if width > expected:
        return F.slice(vec, 1, expected)
    zero = F.lit(0.0).cast("float")
    pad = F.array_repeat(zero, expected - width)
    if unknown_flag:
        is_unknown = ~F.exists(vec, lambda v: v != 0) if width else F.lit(True)
        head = F.array(F.when(is_unknown, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))
        pad = F.concat(head, F.array_repeat(zero, expected - width - 1))
    return F.concat(vec, pad)


def one_hot_fitted(
    code: Column, width: int, expected: int, unknown_flag: bool = True, dtype: str = "float"
) -> Column:
    """``fit_width(one_hot(code))`` in one step, for codes in 0..``width``."""
    if unknown_flag and expected > width:
        # 0 moves to width + 1, the first added position; other codes stay
        code = F.pmod(code + F.lit(width), F.lit(width + 1)) + F.lit(1)
        return one_hot(code, expected, max_code=width + 1, dtype=dtype)
    return one_hot(code, expected, max_code=width, dtype=dtype)
