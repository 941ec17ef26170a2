"""Operators along a time line per key: as-of join, neighbours in time, frames of a fixed duration.

All rows are range-sorted by (key, time) into parts of equal size, so a key with a third of the rows spans
many parts. What a part needs from those before it (the last row, a running sum) is one row per part, taken
along a window over the parts; no task ever sees a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from flowspark.functions.numeric import quoted
from flowspark.operators.order import PART, POS, order_rows
from flowspark.schemas import require_columns


def micros(at: str) -> Column:
    """A time or timestamp column in microseconds; numbers count as seconds."""
    return F.unix_micros(quoted(at).cast("timestamp"))


def _in_part() -> W.WindowSpec:
    return W.Window.partitionBy(PART).orderBy(POS)


def _over_parts() -> W.WindowSpec:
    # one row per part
    return W.Window.orderBy(PART)


def asof_join(
    left: DataFrame, right: DataFrame, key: str, at: str, right_at: str | None = None,
    values: list[str] | None = None, tie: list[str] | None = None, strict: bool = False,
    tolerance_s: float | None = None, partitions: int | None = None,
) -> DataFrame:
    """``left`` with ``values`` of the newest row of ``right`` that has the same key and is not later (with
    ``strict``: earlier), and at most ``tolerance_s`` seconds older.

    Of right rows with equal key and time the greatest by ``tie`` counts, by default by all values. Left rows
    without key, time or partner stay, with nulls; right rows without key or time have no partner.
    """
    right_at = right_at or at
    values = values or [c for c in right.columns if c not in (key, right_at)]
    require_columns(left, [key, at])
    require_columns(right, [key, right_at, *values, *(tie or [])])
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    last = F.struct(*[quoted(c) for c in tie or values])
    candidates = right.filter(quoted(key).isNotNull() & quoted(right_at).isNotNull()).select(
        quoted(key).alias("_key"), micros(right_at).alias("_us"), F.lit(1 if strict else 0).alias("_side"),
        last.alias("_tie"), F.struct(quoted(key).alias("k"), micros(right_at).alias("us"), *[quoted(c) for c in values]).alias("_right"),
    )
    asking = left.select(
        quoted(key).alias("_key"), micros(at).alias("_us"), F.lit(0 if strict else 1).alias("_side"),
        F.struct(*[quoted(c) for c in left.columns]).alias("_left"),
    ).withColumn("_any", F.xxhash64("_left"))  # many left rows of one time spread over parts
    both = asking.unionByName(candidates, allowMissingColumns=True)
    rows = order_rows(both, ["_key", "_us", "_side", "_tie", "_any"], partitions).rows
    place = F.when(F.col("_right").isNotNull(), F.col(POS))
    ends = rows.groupBy(PART).agg(F.max_by("_right", place).alias("_end"))
    before = _over_parts().rowsBetween(W.Window.unboundedPreceding, -1)
    carried = ends.select(PART, F.last("_end", True).over(before).alias("_carried"))
    upto = _in_part().rowsBetween(W.Window.unboundedPreceding, 0)
    # the last right row of any key: that of the row's own key, if it has one at all
    newest = F.coalesce(F.last("_right", True).over(upto), F.col("_carried"))
    found = rows.join(F.broadcast(carried), PART).withColumn("_newest", newest).filter("_left IS NOT NULL")
    near = (F.col("_newest.k") == F.col("_key")) & F.col("_us").isNotNull()
    if tolerance_s is not None:
        near = near & (F.col("_us") - F.col("_newest.us") <= int(round(tolerance_s * 1_000_000)))
    return found.select(
        *[F.col("_left")[c].alias(c) for c in left.columns],
        *[F.when(near, F.col("_newest")[c]).alias(c) for c in values],
    )


def with_neighbour_times(
    df: DataFrame, group: list[str], us: str, partitions: int | None = None
) -> DataFrame:
    """``df`` with ``prev_us`` and ``next_us``: the times of the rows before and after in the group; nulls are
    a group as well. A group may span any number of tasks."""
    rows = order_rows(df, [*group, us], partitions).rows
    row = F.struct(*group, us)
    edges = rows.groupBy(PART).agg(F.min_by(row, POS).alias("_first"), F.max_by(row, POS).alias("_last"))
    edges = edges.select(
        PART, F.lag("_last").over(_over_parts()).alias("_before"), F.lead("_first").over(_over_parts()).alias("_after")
    )
    placed = rows.join(F.broadcast(edges), PART).withColumns({
        "_p": F.coalesce(F.lag(row).over(_in_part()), F.col("_before")),
        "_n": F.coalesce(F.lead(row).over(_in_part()), F.col("_after")),
    })

    def time_of(other: str) -> Column:
        same = F.lit(True)
        for g in group:
            same = same & F.col(other)[g].eqNullSafe(F.col(g))
        return F.when(F.col(other).isNotNull() & same, F.col(other)[us])

    return placed.withColumns({"prev_us": time_of("_p"), "next_us": time_of("_n")}).drop(
        PART, POS, "_before", "_after", "_p", "_n"
    )


def range_frames(
    df: DataFrame, key: str, at: str, width_s: float, sums: dict[str, Column] | None = None,
    distinct: dict[str, str] | None = None, partitions: int | None = None,
) -> DataFrame:
    """``df`` with sums and distinct counts over the rows of the same key in the ``width_s`` seconds up to each
    row, both ends included (``RANGE BETWEEN width PRECEDING AND CURRENT ROW``).

    A row adds its values at its time and takes them back ``width_s`` later, after the rows that still see
    them; what a row sees is the running sum. Values must be whole numbers or decimals, so that nothing is left
    of a key at its end, and one running sum over all keys serves every key. A distinct value counts from
    an occurrence whose previous one is more than ``width_s`` older until ``width_s`` after one whose next is
    more than ``width_s`` newer, so each stretch of occurrences adds one row at either end.

    Nulls add nothing to sums and are no distinct value; a frame without values has sum 0. Rows without time see
    and are seen by nothing: their sums are null. Rows without key are a group of their own.
    """
    sums, distinct = sums or {}, distinct or {}
    require_columns(df, [key, at, *distinct.values()])
    clash = (set(sums) | set(distinct)) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    width = int(round(width_s * 1_000_000))
    names = [*sums, *distinct]
    source = df.select(
        F.struct(*[quoted(c) for c in df.columns]).alias("_row"), quoted(key).alias("_key"), micros(at).alias("_us"),
        *[F.coalesce(v, F.lit(0)).alias(f"_v{k}") for k, v in enumerate(sums.values())],
        *[quoted(c).alias(f"_d{k}") for k, c in enumerate(distinct.values())],
    )
    types = dict(source.dtypes)
    kinds = [types[f"_v{k}"] for k in range(len(sums))] + ["bigint"] * len(distinct)
    for name, kind in zip(names, kinds):
        if kind not in ("tinyint", "smallint", "int", "bigint") and not kind.startswith("decimal"):
            raise ValueError(f"{name} is {kind}; sums of whole numbers or decimals only")
    wide = [k if k.startswith("decimal") else "bigint" for k in kinds]

    def step(us: Column, turn: int, values: dict[int, Column], row: Column | None = None) -> Column:
        filled = [values.get(k, F.lit(0)).cast(t).alias(f"s{k}") for k, t in enumerate(wide)]
        held = F.col("_row") if row is None else F.lit(None).cast(source.schema["_row"].dataType)
        return F.struct(us.alias("us"), F.lit(turn).alias("turn"), *filled, held.alias("row"))

    none = F.lit(None)
    own = {k: F.col(f"_v{k}") for k in range(len(sums))}
    us = F.col("_us")
    # at one time: rows add, rows look, rows leave
    plus = step(us, 0, own, none)
    minus = step(us + width, 2, {k: -v for k, v in own.items()}, none)
    timed = source.filter("_us IS NOT NULL")
    steps = timed.select("_key", F.explode(F.array(plus, step(us, 1, {}), minus)).alias("e"))
    for k in range(len(distinct)):
        at_k = len(sums) + k
        near = with_neighbour_times(timed.filter(f"_d{k} IS NOT NULL").select("_key", f"_d{k}", "_us"), ["_key", f"_d{k}"], "_us", partitions)
        begins = F.col("prev_us").isNull() | (us - F.col("prev_us") > width)
        ends = F.col("next_us").isNull() | (F.col("next_us") - us > width)
        edge = F.array_compact(F.array(
            F.when(begins, step(us, 0, {at_k: F.lit(1)}, none)), F.when(ends, step(us + width, 2, {at_k: F.lit(-1)}, none)),
        ))
        steps = steps.unionByName(near.select("_key", F.explode(edge).alias("e")))
    rows = order_rows(
        steps.select("_key", "e.*").withColumn("_any", F.xxhash64("row")), ["_key", "us", "turn", "_any"], partitions
    ).rows
    totals = rows.groupBy(PART).agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(len(names))])
    before = _over_parts().rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = totals.select(PART, *[F.coalesce(F.sum(f"t{k}").over(before), F.lit(0)).alias(f"o{k}") for k in range(len(names))])
    upto = _in_part().rowsBetween(W.Window.unboundedPreceding, 0)
    running = rows.withColumns({f"r{k}": F.sum(f"s{k}").over(upto) for k in range(len(names))}).filter("row IS NOT NULL")
    seen = running.join(F.broadcast(offsets), PART)
    columns = [F.col("row")[c].alias(c) for c in df.columns]
    found = seen.select(*columns, *[(F.col(f"r{k}") + F.col(f"o{k}")).alias(n) for k, n in enumerate(names)])
    untimed = source.filter("_us IS NULL").select(
        *[F.col("_row")[c].alias(c) for c in df.columns],
        *[F.lit(None).cast(found.schema[n].dataType).alias(n) for n in names],
    )
    return found.unionByName(untimed)
