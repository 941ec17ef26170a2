"""Join of spans of time that overlap, by equality joins on cells.

A span belongs to a level by its length: the cells of level L are ``cell * 2**L`` long and at least as long
as the span, which therefore touches two of them at most, however long it is. Two spans meet in the cells of the
higher of their levels, and are reported in the cell that holds the later of their starts. Copies of a span are
bounded by twice the number of levels of the other side.

Cells with very many spans are split: one side is dealt to several tasks, the other is copied to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.operators.timeline import micros
from flowspark.schemas import require_columns
from flowspark.session import lookup_join

CELL_S = 60.0
HOT_ROWS = 100_000  # spans of a cell that one task takes


def _spans(df: DataFrame, on: list[str], span: tuple[str, str], cell_us: int, side: str) -> DataFrame:
    """Key columns, start, end, level and the whole row of every span that can overlap something."""
    begin, end = (micros(c) for c in span)
    length = F.expr(f"(_{side}1 - _{side}0) div {cell_us}")
    rows = df.select(
        *[quoted(c).alias(f"_k{k}") for k, c in enumerate(on)], begin.alias(f"_{side}0"), end.alias(f"_{side}1"),
        F.struct(*[quoted(c) for c in df.columns]).alias(f"_{side}"),
    )
    usable = F.col(f"_{side}0") <= F.col(f"_{side}1")  # not for nulls
    for k in range(len(on)):
        usable = usable & F.col(f"_k{k}").isNotNull()
    level = F.when(length > 0, F.length(F.bin(length))).otherwise(0)
    return rows.filter(usable).withColumn(f"_{side}level", level)


def _size(cell_us: int) -> Column:
    return F.expr(f"shiftleft({cell_us}L, greatest(_llevel, _rlevel))")


def _entries(spans: DataFrame, side: str, other: str, levels: list[int], cell_us: int) -> DataFrame:
    """A row for every cell in which the span may meet one of the other side."""
    met = spans.withColumn(f"_{other}level", F.explode(F.array(*[F.lit(x) for x in levels])))
    first, last = (F.floor(F.col(f"_{side}{e}") / _size(cell_us)) for e in (0, 1))
    cells = F.when(first == last, F.array(first)).otherwise(F.array(first, last))
    return met.withColumn("_cell", F.explode(cells))


def interval_join(
    left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
    cell_s: float = CELL_S, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All pairs of rows with equal ``on`` whose spans share a moment (both ends belong to a span): the columns
    of ``left``, then those of ``right`` other than ``on``.

    Rows with a null key or time, or that end before they start, have no partner. ``cell_s`` changes the speed,
    never the result.
    """
    require_columns(left, [*on, *left_span])
    require_columns(right, [*on, *right_span])
    rest = [c for c in right.columns if c not in on]
    clash = set(rest) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    cell_us = max(1, int(round(cell_s * 1_000_000)))
    lefts, rights = _spans(left, on, left_span, cell_us, "l"), _spans(right, on, right_span, cell_us, "r")
    # at most 64 levels a side
    left_levels, right_levels = (
        sorted(r[0] for r in spans.select(level).distinct().collect()) for spans, level in ((lefts, "_llevel"), (rights, "_rlevel"))
    )
    if not left_levels or not right_levels:
        left_levels = right_levels = [0]
    keys = [*[f"_k{k}" for k in range(len(on))], "_llevel", "_rlevel", "_cell"]
    asked = _entries(lefts, "l", "r", right_levels, cell_us)
    given = _entries(rights, "r", "l", left_levels, cell_us)
    hot = (
        asked.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows)
        .select(*keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_shares"))
    )
    shares = F.coalesce("_shares", F.lit(1))
    asked = lookup_join(asked, hot, keys).withColumn("_share", F.pmod(F.xxhash64("_l"), shares).cast("int"))
    given = lookup_join(given, hot, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    met = asked.drop("_shares").join(given.drop("_shares"), [*keys, "_share"])
    overlap = (F.col("_l0") <= F.col("_r1")) & (F.col("_r0") <= F.col("_l1"))
    once = F.col("_cell") == F.floor(F.greatest("_l0", "_r0") / _size(cell_us))
    return met.filter(overlap & once).select(
        *[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_r")[c].alias(c) for c in rest]
    )
