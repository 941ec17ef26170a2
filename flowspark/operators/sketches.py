"""Exact top levels and quantiles of columns with too many values to count: sketches find what to look at, a second pass counts it."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.operators.stats import count_levels, fit_categorical, rank_levels
from flowspark.schemas import level_type_of_column, require_columns
from flowspark.session import fetch_small, small_table

# Levels a sketch keeps apart, and the largest share of the rows by which it may be wrong about one: 3.5 / map size,
# where the map is the power of two at or above 4/3 of the levels (fixed by the sketch).
TRACKED = 4096


def sketch_error(tracked: int) -> float:
    return 3.5 / (1 << math.ceil(math.log2(tracked * 4 / 3)))


def _item(df: DataFrame, feature: str) -> tuple[str, Column]:
    kind = level_type_of_column(df.schema[feature].dataType)
    return kind, quoted(feature).cast("bigint" if kind == "int" else "string")


def sketch_levels(df: DataFrame, features: list[str], tracked: int = TRACKED) -> DataFrame:
    """One row: the rows, and per feature (``_s0`` ...) a sketch of its frequent levels. Sketches of parts merge by
    ``approx_top_k_combine``; one sketch per task and feature is shuffled, whatever the number of levels."""
    require_columns(df, features)
    sketches = [F.call_function("approx_top_k_accumulate", _item(df, f)[1], F.lit(tracked)).alias(f"_s{i}") for i, f in enumerate(features)]
    known = [F.count(quoted(f)).alias(f"_n{i}") for i, f in enumerate(features)]
    return df.agg(F.count("*").alias("_rows"), *known, *sketches)


def frequent_levels(df: DataFrame, features: list[str], top_k: int = 32, tracked: int = TRACKED) -> DataFrame:
    """(feature, level_type, level, n, rank): what ``fit_categorical`` gives, without counting every level.

    The first pass sketches, the second counts the sketches' levels exactly: at most ``tracked`` per feature leave a task.
    A level outside the sketch has at most twice the sketch's error (or the least estimate of a full sketch) as its
    count. Where the k-th count is above that, or the levels of the sketch make up all rows, the result is proven. A
    feature without such a proof, one of flat frequencies, is counted in full.
    """
    if tracked < top_k:
        raise ValueError("a sketch must keep more levels than are asked for")
    kinds = {f: _item(df, f)[0] for f in features}
    one = sketch_levels(df, features, tracked)
    found = one.select(
        "_rows", *[f"_n{i}" for i in range(len(features))],
        *[F.call_function("approx_top_k_estimate", F.col(f"_s{i}"), F.lit(tracked)).alias(f"_t{i}") for i in range(len(features))],
    ).first()
    candidates, unseen, known = [], {}, {}
    for i, f in enumerate(features):
        items = found[f"_t{i}"] or []
        known[f] = found[f"_n{i}"]
        unseen[f] = 2 * sketch_error(tracked) * found["_rows"]
        if len(items) >= tracked:
            unseen[f] = max(unseen[f], min(r["count"] for r in items))
        for r in items:
            if r["item"] is not None:
                candidates.append((f, None, r["item"]) if kinds[f] == "int" else (f, r["item"], None))
    table = F.broadcast(small_table(df.sparkSession, candidates, "feature STRING, text STRING, as_int BIGINT"))
    counted = count_levels(df, features, among=table)
    # at most ``tracked`` rows per feature
    small = fetch_small(counted, tracked * len(features))
    counted = small if small is not None else counted
    ranked = rank_levels(counted, {}, top_k)
    seen = {r["feature"]: r["n"] for r in counted.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    last = {r["feature"]: r["n"] for r in ranked.filter(F.col("rank") == top_k).collect()}
    open_ = [f for f in features if seen.get(f, 0) != known[f] and not last.get(f, 0) > unseen[f]]
    if not open_:
        return ranked
    return ranked.filter(~F.col("feature").isin(open_)).unionByName(fit_categorical(df, open_, top_k))


# Values in a bracket that are counted one by one in the end.
BRACKET = 10_000


def exact_quantiles(df: DataFrame, feature: str, shares: list[float], sketch_k: int = 2000, bracket: int = BRACKET) -> DataFrame:
    """(share, value): the smallest value that is not below the given share of the values, as ``percentile_disc`` says;
    null and NaN are no values; null without any.

    A sketch gives each share a bracket of values around its place; a pass counts what lies below and inside, and sketches
    the inside of brackets that still hold more than ``bracket`` rows. A bracket that missed its place, which a sketch
    may, grows back to the one before it. So the rows are never sorted, and the last counts are small.
    """
    require_columns(df, [feature])
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError("shares lie between 0 and 1")
    spark = df.sparkSession
    x = quoted(feature).cast("double")
    values = df.select(x.alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    total = values.count()
    names = dict.fromkeys(shares)
    if total == 0:
        return small_table(spark, [(q, None) for q in names], "share DOUBLE, value DOUBLE")
    # the share as it is written: 0.1 of 30 rows are 3, not a little more
    place = {q: max(1, math.ceil(Fraction(repr(q)) * total)) for q in names}
    spread = 4 * 2.296 / sketch_k**0.9021  # four times the usual error of a sketch of this size
    wide = {q: (-math.inf, math.inf, 0, total) for q in names}  # from, to, rows below, rows inside
    done: dict[float, float] = {}
    while True:
        todo = [q for q in names if q not in done and wide[q][3] > bracket]
        if not todo:
            break
        near = _brackets(values, {q: (wide[q], place[q]) for q in todo}, spread, sketch_k)
        sizes = _count(values, near)
        for q in todo:
            low, high, (below, inside) = *near[q], sizes[q]
            if not below < place[q] <= below + inside:
                # the place is outside: what was learned still cuts the bracket on one side
                lo, hi, b, n = wide[q]
                if place[q] <= below:
                    wide[q] = (lo, _before(low), b, below - b)
                else:
                    wide[q] = (_after(high), hi, below + inside, b + n - below - inside)
            elif low == high:
                done[q] = low
            else:
                if inside == wide[q][3]:
                    # a sketch that cuts nothing off: take the halves on both sides of its middle in turn
                    middle = low / 2 + high / 2
                    (b, n), = _count(values, {q: (low, middle)}).values()
                    cut = (low, middle, b, n) if place[q] <= b + n else (_after(middle), high, b + n, inside - n)
                    wide[q] = cut
                else:
                    wide[q] = (low, high, below, inside)
                if wide[q][0] == wide[q][1]:
                    done[q] = wide[q][0]
    last = {q: wide[q] for q in names if q not in done}
    if last:
        spans = [F.when(_inside(w), F.lit(i)) for i, w in enumerate(last.values())]
        held = values.select("x", F.explode(F.array_compact(F.array(*spans))).alias("i"))
        counts: dict[int, list] = {i: [] for i in range(len(last))}
        for r in held.groupBy("i", "x").count().collect():  # at most ``bracket`` per share
            counts[r["i"]].append((r["x"], r["count"]))
        for i, (q, w) in enumerate(last.items()):
            left = place[q] - w[2]
            for v, n in sorted(counts[i]):
                left -= n
                if left <= 0:
                    done[q] = v
                    break
    return small_table(spark, [(q, done[q]) for q in names], "share DOUBLE, value DOUBLE")


def _before(v: float) -> float:
    return math.nextafter(v, -math.inf)


def _after(v: float) -> float:
    return math.nextafter(v, math.inf)


def _inside(w: tuple) -> Column:
    return (F.col("x") >= F.lit(float(w[0]))) & (F.col("x") <= F.lit(float(w[1])))


def _brackets(values: DataFrame, wanted: dict, spread: float, sketch_k: int) -> dict:
    """Per share two values around its place, from a sketch of the rows inside its bracket."""
    spans = list(dict.fromkeys(w for w, _ in wanted.values()))
    sketches = [F.call_function("kll_sketch_agg_double", F.when(_inside(w), F.col("x")), F.lit(sketch_k)).alias(f"s{i}") for i, w in enumerate(spans)]
    ends = []
    for q, (w, at) in wanted.items():
        rank = (at - w[2]) / w[3]
        for k, r in enumerate((max(rank - spread, 0.0), min(rank + spread, 1.0))):
            ends.append(F.call_function("kll_sketch_get_quantile_double", F.col(f"s{spans.index(w)}"), F.lit(r)))
    row = values.agg(*sketches).select(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()
    return {q: (row[2 * i], row[2 * i + 1]) for i, q in enumerate(wanted)}


def _count(values: DataFrame, spans: dict) -> dict:
    """Per share the rows below and inside its span."""
    aggs = []
    for i, w in enumerate(spans.values()):
        aggs += [F.count_if(F.col("x") < F.lit(float(w[0]))).alias(f"b{i}"), F.count_if(_inside(w)).alias(f"n{i}")]
    row = values.agg(*aggs).first()
    return {q: (row[f"b{i}"], row[f"n{i}"]) for i, q in enumerate(spans)}
