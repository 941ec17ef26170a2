"""Traffic by grouping sets, and differences between captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, query
from flowspark.flows import flows
from flowspark.operators.summaries import capture_changes, cube_sets, grouping_sets, multiset_difference, rollup_sets

DIMS = ["PROTOCOL", "L7_PROTO", "Attack"]
TOTALS = """count(*) AS n_flows, CAST(sum(OUT_BYTES) AS BIGINT) AS bytes, count(DISTINCT IPV4_SRC_ADDR) AS hosts"""


def _totals(spark, sf_dir, sets):
    return grouping_sets(
        flows(spark, sf_dir), DIMS, sets, {"n_flows": F.lit(1), "bytes": F.col("OUT_BYTES")}, {"hosts": "IPV4_SRC_ADDR"}
    )


@query("g11_traffic_cube", f"""SELECT PROTOCOL, L7_PROTO, Attack, CAST(GROUPING(PROTOCOL, L7_PROTO, Attack) AS BIGINT) AS grouping_id, {TOTALS}
FROM ({FLOWS}) f GROUP BY CUBE (PROTOCOL, L7_PROTO, Attack)""")
def _cube(spark, sf_dir):
    return _totals(spark, sf_dir, cube_sets(DIMS))


@query("g11_traffic_rollup", f"""SELECT PROTOCOL, L7_PROTO, Attack, CAST(GROUPING(PROTOCOL, L7_PROTO, Attack) AS BIGINT) AS grouping_id, {TOTALS}
FROM ({FLOWS}) f GROUP BY ROLLUP (PROTOCOL, L7_PROTO, Attack)""")
def _rollup(spark, sf_dir):
    return _totals(spark, sf_dir, rollup_sets(DIMS))


# two captures of the same traffic: each misses some flows, the later one sees other flags
ROWS = ["IPV4_SRC_ADDR", "L4_DST_PORT", "PROTOCOL", "L7_PROTO", "TCP_FLAGS"]
BEFORE = f"SELECT IPV4_SRC_ADDR, L4_DST_PORT, PROTOCOL, L7_PROTO, TCP_FLAGS FROM ({FLOWS}) a WHERE flow_id % 7 <> 2"
AFTER = f"""SELECT IPV4_SRC_ADDR, L4_DST_PORT, PROTOCOL, L7_PROTO, CASE WHEN flow_id % 5 = 0 THEN NULL ELSE TCP_FLAGS END AS TCP_FLAGS
FROM ({FLOWS}) b WHERE flow_id % 3 <> 1"""


def _captures(spark, sf_dir):
    f = flows(spark, sf_dir)
    flags = F.when(F.col("flow_id") % 5 == 0, F.lit(None)).otherwise(F.col("TCP_FLAGS")).alias("TCP_FLAGS")
    return f.filter("flow_id % 7 <> 2").select(*ROWS), f.filter("flow_id % 3 <> 1").select(*ROWS[:-1], flags)


def _side(sql: str, side: str) -> str:
    return f"SELECT '{side}' AS side, * FROM ({sql}) q_{side}"


@query("o1_capture_difference", " UNION ALL ".join([
    _side(f"{BEFORE} EXCEPT ALL {AFTER}", "only_left"), _side(f"{AFTER} EXCEPT ALL {BEFORE}", "only_right"),
    _side(f"{BEFORE} INTERSECT ALL {AFTER}", "both"),
]))
def _difference(spark, sf_dir):
    found = multiset_difference(*_captures(spark, sf_dir))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("n")) for s in ("only_left", "only_right", "both")])
    rows = found.withColumn("_s", F.explode(sides)).filter("_s.n > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_s.n")))).select("_s.side", *ROWS)


@query("o1_capture_changes", f"""WITH c AS (SELECT *, 1 AS l, 0 AS r FROM ({BEFORE}) x UNION ALL SELECT *, 0, 1 FROM ({AFTER}) y),
 m AS (SELECT IPV4_SRC_ADDR, PROTOCOL, L4_DST_PORT, L7_PROTO, TCP_FLAGS, sum(l) AS l, sum(r) AS r FROM c GROUP BY ALL),
 k AS (SELECT IPV4_SRC_ADDR, PROTOCOL, CAST(sum(least(l, r)) AS BIGINT) AS n_same, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS n_removed,
  CAST(sum(greatest(r - l, 0)) AS BIGINT) AS n_added FROM m GROUP BY ALL)
SELECT *, n_removed > 0 AND n_added > 0 AS changed FROM k""")
def _changes(spark, sf_dir):
    return capture_changes(*_captures(spark, sf_dir), ["IPV4_SRC_ADDR", "PROTOCOL"])
