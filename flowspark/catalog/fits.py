"""Fits merged from parts, frequent levels and quantiles by sketch and count."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, ORDER, query
from flowspark.catalog.preparation import levels_sql
from flowspark.flows import flows
from flowspark.operators.appended import IndexedTable
from flowspark.operators.fits import FitStore
from flowspark.operators.sketches import exact_quantiles, frequent_levels
from flowspark.session import scratch_path
from flowspark.specs import NFV1

DAYS = 10


def fitted_days(spark, sf_dir):
    """The flows fitted in stretches of ten days."""
    f = flows(spark, sf_dir)
    stretch = F.floor(F.dayofyear("ts") / DAYS)
    store = FitStore(spark, scratch_path(spark, "fits"), NFV1.numerical, NFV1.categorical)
    for r in f.select(stretch.alias("d")).distinct().collect():
        store.add(f"days-{r['d']}", f.filter(stretch == r["d"]))
    return store


@query("g12_merged_levels", levels_sql({}, 32))
def _merged_levels(spark, sf_dir):
    return fitted_days(spark, sf_dir).ranked_levels().drop("level_type")


@query("g12_merged_statistics", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS n_values, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max, "
    f"round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std, count(*) FILTER (WHERE {f} <> 0) AS non_zero FROM ({FLOWS}) q"
    for f in NFV1.numerical
))
def _merged_statistics(spark, sf_dir):
    out = fitted_days(spark, sf_dir).statistics()
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


FREQUENT = [*NFV1.categorical, "IPV4_SRC_ADDR", "OUT_BYTES"]


@query("g13_frequent_levels", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(v AS VARCHAR) AS level, n, r AS rank FROM (SELECT {f} AS v, count(*) AS n, "
    f"CAST(row_number() OVER (ORDER BY count(*) DESC, {f}) AS INT) AS r FROM ({FLOWS}) q GROUP BY {f}) g WHERE r <= 10"
    for f in FREQUENT
))
def _frequent_levels(spark, sf_dir):
    return frequent_levels(flows(spark, sf_dir), FREQUENT, 10).drop("level_type")


SHARES = [0.0, 0.25, 0.5, 0.75, 1.0]


@query("g14_exact_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({q} AS DOUBLE) AS share, CAST(quantile_disc({c}, {q}) AS DOUBLE) AS value FROM ({FLOWS}) q"
    for c in ("OUT_BYTES", "FLOW_DURATION_MILLISECONDS") for q in SHARES
))
def _exact_quantiles(spark, sf_dir):
    f = flows(spark, sf_dir)
    one, two = (exact_quantiles(f, c, SHARES).withColumn("feature", F.lit(c)) for c in ("OUT_BYTES", "FLOW_DURATION_MILLISECONDS"))
    return one.unionByName(two).select("feature", "share", "value")


@query("w0_index_of_appended_rows", f"SELECT flow_id, OUT_BYTES, row_number() OVER (ORDER BY ts, flow_id) - 1 AS idx FROM ({FLOWS}) q")
def _index_of_appended_rows(spark, sf_dir):
    f = flows(spark, sf_dir).select("ts", "flow_id", "OUT_BYTES")
    low, high = f.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    slot = F.floor((F.unix_micros("ts") - low) * 3 / F.lit(high - low + 1))
    # a few flows of each third come with the next one
    part = F.least(slot + F.when(F.col("flow_id") % 101 == 7, 1).otherwise(0), F.lit(2))
    table = IndexedTable(spark, scratch_path(spark, "indexed"), ORDER)
    for i in range(3):
        table.append(f.filter(part == i))
    return table.rows().select("flow_id", "OUT_BYTES", "idx")
