"""Streams whose rows arrive late, and streams joined with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, query
from flowspark.catalog.detection import arrive_in_parts, ddl
from flowspark.catalog.preparation import ASSEMBLED, GAP_S, comparable
from flowspark.flows import flows, packets
from flowspark.session import scratch_path
from flowspark.sources import readers
from flowspark.streaming.events import EventTotals, EventWindows, join_following, latest_totals
from flowspark.streaming.flows import drain, send_tick, tick_stream, with_ticks
from flowspark.streaming.sessions import assemble_flows_stateful, rocksdb_state

DAY = 24 * 3600
PARTS = 3
DELAY_S = DAY

# a thirteenth of the flows arrives one part after its time
ARRIVED = f"""SELECT *, least(CAST(floor((epoch_us(ts) - lo) * {PARTS} / (hi - lo + 1)) AS INT) + CASE WHEN flow_id % 13 = 5 THEN 1 ELSE 0 END, {PARTS - 1}) AS part
 FROM ({FLOWS}) q, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM ({FLOWS}) r) b"""


def placed_sql(width: int, slide: int) -> str:
    """CTE ``w``: each flow once per window, with ``late`` where the window was closed when it came."""
    return f"""WITH f AS ({ARRIVED}), m AS (SELECT part, max(epoch_us(ts)) AS newest FROM f GROUP BY part),
 c AS (SELECT part, max(newest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM m),
 w AS (SELECT f.*, s.start AS window_start, coalesce((s.start + {width}) * CAST(1000000 AS BIGINT) <= clock - {DELAY_S} * CAST(1000000 AS BIGINT), false) AS late
  FROM f JOIN c USING (part), LATERAL (SELECT CAST(epoch_us(ts) // ({slide} * CAST(1000000 AS BIGINT)) * {slide} - i * {slide} AS BIGINT) AS start FROM range({width // slide}) t(i)) s)"""


def totals(key, width_s, slide_s=None):
    aggs = {"n_flows": ("sum", F.lit(1)), "bytes": ("sum", F.col("OUT_BYTES")), "most": ("max", F.col("OUT_PKTS"))}
    return EventTotals([key], aggs, width_s, slide_s)


def run_windows(spark, sf_dir, spec):
    """The flows in parts through ``EventWindows``; the folder of its tables."""
    path, ticks, out, state = (scratch_path(spark, n) for n in ("flows", "ticks", "windows", "state"))
    f = flows(spark, sf_dir)
    low, high = f.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    last = f.agg(F.max("ts")).first()[0]
    slot = F.floor((F.unix_micros("ts") - low) * PARTS / F.lit(high - low + 1)).cast("int")
    part = F.least(slot + F.when(F.col("flow_id") % 13 == 5, 1).otherwise(0), F.lit(PARTS - 1))
    # a first tick, so that the folder of ticks is there; it is older than all flows
    send_tick(spark, ticks, f.agg(F.min("ts")).first()[0])

    def run():
        live = with_ticks(readers.stream_records(spark, path, ddl(f)), tick_stream(spark, ticks))
        feed = EventWindows(spec, f"{state}/feed", out, DELAY_S)
        live.writeStream.foreachBatch(feed).option("checkpointLocation", f"{state}/query").trigger(availableNow=True).start().awaitTermination()

    for i in range(PARTS):
        f.filter(part == i).write.mode("append").parquet(path)
        run()
    drain(spark, ticks, last, DELAY_S + spec.width_s)
    run()
    return out


@query("t1_tumbling_windows_late_rows", f"""{placed_sql(DAY // 4, DAY // 4)}
SELECT window_start, PROTOCOL, late, count(*) AS n_flows, CAST(sum(OUT_BYTES) AS BIGINT) AS bytes, max(OUT_PKTS) AS most FROM w GROUP BY ALL""")
def _tumbling(spark, sf_dir):
    spec = totals("PROTOCOL", DAY // 4)
    out = run_windows(spark, sf_dir, spec)
    columns = ["window_start", "PROTOCOL", *spec.aggs]
    closed = spark.read.parquet(f"{out}/closed").select(*columns, F.lit(False).alias("late"))
    late = spec.totals(spark.read.parquet(f"{out}/late")).select(*columns, F.lit(True).alias("late"))
    return closed.unionByName(late)


@query("t1_hopping_windows_updates", f"""{placed_sql(DAY, DAY // 4)}
SELECT window_start, L7_PROTO, count(*) AS n_flows, CAST(sum(OUT_BYTES) AS BIGINT) AS bytes, max(OUT_PKTS) AS most FROM w WHERE NOT late GROUP BY ALL""")
def _hopping(spark, sf_dir):
    spec = totals("L7_PROTO", DAY, DAY // 4)
    out = run_windows(spark, sf_dir, spec)
    return latest_totals(spark.read.parquet(f"{out}/updates"), spec)


# -- two streams -------------------------------------------------------------------------------------
SPAN_S = 12 * 3600
ALERTED = f"SELECT flow_id AS alert_id, IPV4_SRC_ADDR, ts FROM ({FLOWS}) a WHERE Attack <> 'Benign'"


@query("j4_flows_after_alerts", f"""SELECT a.alert_id, a.IPV4_SRC_ADDR, f.flow_id, f.OUT_BYTES AS bytes FROM ({ALERTED}) a
LEFT JOIN ({FLOWS}) f ON f.IPV4_SRC_ADDR = a.IPV4_SRC_ADDR AND f.ts > a.ts AND f.ts <= a.ts + INTERVAL {SPAN_S} SECONDS""")
def _flows_after_alerts(spark, sf_dir):
    path, ticks, out, state = (scratch_path(spark, n) for n in ("flows", "ticks", "joined", "state"))
    f = flows(spark, sf_dir).select("flow_id", "IPV4_SRC_ADDR", "ts", "OUT_BYTES", "Attack")
    first, last = f.agg(F.min("ts"), F.max("ts")).first()
    send_tick(spark, ticks, first)
    alerted = F.col("Attack") != "Benign"

    def run(ended):
        if ended:
            drain(spark, ticks, last, SPAN_S + DAY)
        live = readers.stream_records(spark, path, ddl(f))
        alerts = live.filter(alerted).select(F.col("flow_id").alias("alert_id"), "IPV4_SRC_ADDR", "ts")
        found = join_following(
            alerts, readers.stream_records(spark, path, ddl(f)), ["IPV4_SRC_ADDR"], SPAN_S, {"flow_id": "flow_id", "OUT_BYTES": "bytes"},
            "1 hour", tick_stream(spark, ticks), tick_stream(spark, ticks),
        )
        q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()

    arrive_in_parts(f, path, run, PARTS)
    return spark.read.parquet(out).select("alert_id", "IPV4_SRC_ADDR", "flow_id", "bytes")


@query("a3_assemble_flows_stateful", ASSEMBLED)
def _assemble_flows_stateful(spark, sf_dir):
    path, ticks, out, state = (scratch_path(spark, n) for n in ("packets", "ticks", "flows", "state"))
    pk = packets(spark, sf_dir)
    first, last = pk.agg(F.min("ts"), F.max("ts")).first()
    send_tick(spark, ticks, first)

    def run(ended):
        if ended:
            drain(spark, ticks, last, GAP_S + 60)
        found = assemble_flows_stateful(readers.stream_records(spark, path, ddl(pk)), GAP_S, "1 minute", tick_stream(spark, ticks))
        with rocksdb_state(spark):
            q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()

    arrive_in_parts(pk, path, run)
    return comparable(spark.read.parquet(out))
