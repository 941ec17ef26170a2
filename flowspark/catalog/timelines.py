"""Labels that change over time, attack periods and rates per host."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, query
from flowspark.flows import flows
from flowspark.operators.intervals import interval_join
from flowspark.operators.timeline import asof_join, range_frames

FRAME_S = 12 * 3600


def label_changes(f):
    """A label per host from some of the flows on."""
    changes = f.filter("flow_id % 11 = 3")
    return changes.select("IPV4_SRC_ADDR", "ts", F.col("Attack").alias("host_label"), F.col("flow_id").alias("since_flow"))


CHANGES = f"SELECT IPV4_SRC_ADDR, ts, Attack AS host_label, flow_id AS since_flow FROM ({FLOWS}) c WHERE flow_id % 11 = 3"


@query("j1_asof_labels", f"""SELECT f.flow_id, f.IPV4_SRC_ADDR, l.host_label, l.since_flow FROM ({FLOWS}) f
ASOF LEFT JOIN ({CHANGES}) l ON f.IPV4_SRC_ADDR = l.IPV4_SRC_ADDR AND f.ts >= l.ts""")
def _asof_labels(spark, sf_dir):
    f = flows(spark, sf_dir)
    found = asof_join(f.select("flow_id", "IPV4_SRC_ADDR", "ts"), label_changes(f), "IPV4_SRC_ADDR", "ts")
    return found.drop("ts")


@query("j1_asof_labels_recent", f"""SELECT f.flow_id, CASE WHEN f.ts - l.ts <= INTERVAL 2 DAYS THEN l.since_flow END AS since_flow FROM ({FLOWS}) f
ASOF LEFT JOIN ({CHANGES}) l ON f.IPV4_SRC_ADDR = l.IPV4_SRC_ADDR AND f.ts > l.ts""")
def _asof_labels_recent(spark, sf_dir):
    f = flows(spark, sf_dir)
    found = asof_join(
        f.select("flow_id", "IPV4_SRC_ADDR", "ts"), label_changes(f), "IPV4_SRC_ADDR", "ts", values=["since_flow"],
        strict=True, tolerance_s=2 * 24 * 3600,
    )
    return found.select("flow_id", "since_flow")


# a period lasts from minutes to weeks, a flow some seconds
PERIODS = """SELECT flow_id AS period_id, IPV4_SRC_ADDR, Attack AS kind, ts AS begins,
 ts + CASE flow_id % 3 WHEN 0 THEN INTERVAL 5 MINUTES WHEN 1 THEN INTERVAL 9 HOURS ELSE INTERVAL 20 DAYS END AS ends
FROM ({flows}) p WHERE flow_id % 17 = 5"""


@query("j2_interval_attack_periods", f"""SELECT f.flow_id, p.period_id, p.kind FROM ({FLOWS}) f
JOIN ({PERIODS.format(flows=FLOWS)}) p ON p.IPV4_SRC_ADDR = f.IPV4_SRC_ADDR
 AND f.ts <= p.ends AND f.ts + to_milliseconds(FLOW_DURATION_MILLISECONDS) >= p.begins""")
def _interval_periods(spark, sf_dir):
    f = flows(spark, sf_dir)
    periods = spark.sql(PERIODS.replace("{flows}", "SELECT * FROM {f}"), f=f)
    spans = f.select("flow_id", "IPV4_SRC_ADDR", F.col("ts").alias("seen"), F.expr(
        "timestampadd(MICROSECOND, FLOW_DURATION_MILLISECONDS * 1000, ts)"
    ).alias("gone"))
    met = interval_join(spans, periods, ["IPV4_SRC_ADDR"], ("seen", "gone"), ("begins", "ends"), cell_s=600)
    return met.select("flow_id", "period_id", "kind")


@query("j3_range_frames_per_host", f"""WITH f AS ({FLOWS}),
 d AS (SELECT a.flow_id, count(DISTINCT b.L4_DST_PORT) AS ports, count(DISTINCT b.L7_PROTO) AS apps FROM f a
  JOIN f b ON b.IPV4_SRC_ADDR = a.IPV4_SRC_ADDR AND b.ts BETWEEN a.ts - INTERVAL {FRAME_S} SECONDS AND a.ts GROUP BY a.flow_id)
SELECT flow_id, count(*) OVER w AS n_flows, CAST(sum(OUT_PKTS) OVER w AS BIGINT) AS packets, CAST(sum(OUT_BYTES) OVER w AS BIGINT) AS bytes, ports, apps
FROM f JOIN d USING (flow_id)
WINDOW w AS (PARTITION BY IPV4_SRC_ADDR ORDER BY ts RANGE BETWEEN INTERVAL {FRAME_S} SECONDS PRECEDING AND CURRENT ROW)""")
def _range_frames(spark, sf_dir):
    f = flows(spark, sf_dir).select("flow_id", "IPV4_SRC_ADDR", "ts", "OUT_PKTS", "OUT_BYTES", "L4_DST_PORT", "L7_PROTO")
    found = range_frames(
        f, "IPV4_SRC_ADDR", "ts", FRAME_S, {"n_flows": F.lit(1), "packets": F.col("OUT_PKTS"), "bytes": F.col("OUT_BYTES")},
        {"ports": "L4_DST_PORT", "apps": "L7_PROTO"},
    )
    return found.select("flow_id", "n_flows", "packets", "bytes", "ports", "apps")
