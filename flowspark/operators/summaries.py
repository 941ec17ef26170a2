"""Reports: totals over grouping sets, and what two captures have in common."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.schemas import require_columns


def cube_sets(dims: list[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def rollup_sets(dims: list[str]) -> list[tuple[str, ...]]:
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def grouping_sets(
    df: DataFrame, dims: list[str], sets: list[tuple[str, ...]], sums: dict[str, Column], distinct: dict[str, str] | None = None
) -> DataFrame:
    """Totals of ``sums`` and one distinct count over each of ``sets``: the dims (null where summed over),
    ``grouping_id`` (a bit per dim, the last lowest, 1 where summed over), the totals.

    Rows are summed by all dims and the distinct value first; only these sums are copied once for each set, and the
    distinct values of a group are told apart before they are counted. A null in a dim is a value of its own, told
    apart by ``grouping_id``; a null is no distinct value. An empty table has no groups, not even a total.
    """
    distinct = distinct or {}
    if len(distinct) > 1:
        raise ValueError("one distinct count at a time")
    unknown = {c for s in sets for c in s} - set(dims)
    if unknown:
        raise ValueError(f"grouping sets name other columns: {sorted(unknown)}")
    require_columns(df, [*dims, *distinct.values()])
    value = quoted(next(iter(distinct.values()))) if distinct else F.lit(None)
    keys = [F.col(f"_k{k}") for k in range(len(dims))]
    totals = [f"_s{k}" for k in range(len(sums))]
    base = (
        df.select(
            *[quoted(d).alias(f"_k{k}") for k, d in enumerate(dims)], value.alias("_d"),
            *[v.alias(t) for v, t in zip(sums.values(), totals)],
        )
        .groupBy(*keys, "_d").agg(*[F.sum(t).alias(t) for t in totals])
    )

    def masked(chosen: tuple[str, ...]) -> Column:
        gid = sum(1 << (len(dims) - 1 - k) for k, d in enumerate(dims) if d not in chosen)
        kept = [F.when(F.lit(d in chosen), key).alias(f"_k{k}") for k, (d, key) in enumerate(zip(dims, keys))]
        return F.struct(F.lit(gid).cast("bigint").alias("grouping_id"), *kept)

    groups = ["grouping_id", *[f"_k{k}" for k in range(len(dims))]]
    copies = base.select(F.explode(F.array(*[masked(s) for s in sets])).alias("g"), "_d", *totals).select("g.*", "_d", *totals)
    per_value = copies.groupBy(*groups, "_d").agg(*[F.sum(t).alias(t) for t in totals])
    found = per_value.groupBy(*groups).agg(
        *[F.sum(t).alias(n) for t, n in zip(totals, sums)], *[F.count("_d").alias(n) for n in distinct]
    )
    return found.select(*[F.col(f"_k{k}").alias(d) for k, d in enumerate(dims)], "grouping_id", *sums, *distinct)


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every different row of the two sides with ``only_left``, ``only_right`` and ``both``: how often it stands on one
    side beyond the other, and on both (``EXCEPT ALL`` both ways and ``INTERSECT ALL``). Nulls are equal.

    Rows are counted with a sign in one aggregation, combined before its shuffle, so a row that stands very often is
    one row per task.
    """
    if left.columns != right.columns:
        raise ValueError("both sides need the same columns")
    marked = left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(right.withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
    counted = marked.groupBy(*[quoted(c) for c in left.columns]).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    zero = F.lit(0).cast("bigint")
    return counted.select(
        *[quoted(c) for c in left.columns], F.greatest(F.col("_l") - F.col("_r"), zero).alias("only_left"),
        F.greatest(F.col("_r") - F.col("_l"), zero).alias("only_right"), F.least("_l", "_r").alias("both"),
    )


def capture_changes(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Per ``key``: n_same, n_removed, n_added, and ``changed`` where rows of the key were removed and others added. Only
    counts of the different rows are brought together by key."""
    require_columns(left, key)
    found = multiset_difference(left, right)
    per_key = found.groupBy(*[quoted(c) for c in key]).agg(
        F.sum("both").alias("n_same"), F.sum("only_left").alias("n_removed"), F.sum("only_right").alias("n_added")
    )
    return per_key.withColumn("changed", (F.col("n_removed") > 0) & (F.col("n_added") > 0))
