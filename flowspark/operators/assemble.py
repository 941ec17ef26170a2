"""Flow assembly: packets to bidirectional flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Bit per TCP flag.
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]


def flag_bits() -> Column:
    """The TCP flags of one packet as an integer."""
    bits = [F.when(F.col(name), bit).otherwise(0) for name, bit in FLAG_BITS.items()]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def with_conversation(packets: DataFrame) -> DataFrame:
    """Direction-free key (lower endpoint first), ``forward`` for packets sent by the lower endpoint,
    time in microseconds and flag bits."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    forward = src <= dst
    return packets.select(
        "packet_id",
        "ts",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("lo_ip"),
        F.when(forward, F.col("src_port")).otherwise(F.col("dst_port")).alias("lo_port"),
        F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("hi_ip"),
        F.when(forward, F.col("dst_port")).otherwise(F.col("src_port")).alias("hi_port"),
        "protocol",
        "bytes",
        forward.alias("forward"),
        flag_bits().alias("flags"),
    )


def flow_columns(first_forward: Column, keep: list[str] | None = None) -> list[Column]:
    """Raw flow columns from the per-direction sums and the first packet's direction."""

    def pick(if_forward: str, otherwise: str) -> Column:
        return F.when(first_forward, F.col(if_forward)).otherwise(F.col(otherwise))

    return [
        *[F.col(c) for c in keep or []],
        pick("lo_ip", "hi_ip").alias("src_ip"),
        pick("lo_port", "hi_port").alias("src_port"),
        pick("hi_ip", "lo_ip").alias("dst_ip"),
        pick("hi_port", "lo_port").alias("dst_port"),
        F.col("protocol"),
        F.lit(None).cast("string").alias("application_name"),
        pick("f_pkts", "b_pkts").alias("src2dst_packets"),
        pick("f_bytes", "b_bytes").alias("src2dst_bytes"),
        pick("b_pkts", "f_pkts").alias("dst2src_packets"),
        pick("b_bytes", "f_bytes").alias("dst2src_bytes"),
        F.expr("CAST((last_us - first_us) div 1000 AS BIGINT)").alias("bidirectional_duration_ms"),
        F.timestamp_micros("first_us").alias("first_seen"),
        F.col("tcp_flags").alias("udps.tcp_flags"),
    ]


def direction_sums() -> list[Column]:
    """Mergeable aggregates: all have fixed-width buffers, so they combine before the shuffle."""
    fwd = F.col("forward")
    return [
        F.count_if(fwd).alias("f_pkts"),
        F.count_if(~fwd).alias("b_pkts"),
        F.sum(F.when(fwd, F.col("bytes")).otherwise(F.lit(0))).alias("f_bytes"),
        F.sum(F.when(fwd, F.lit(0)).otherwise(F.col("bytes"))).alias("b_bytes"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.bit_or("flags").alias("tcp_flags"),
    ]


# Width of a time bucket in idle timeouts.
BUCKET_TIMEOUTS = 8


def assemble_flows(
    packets: DataFrame, idle_timeout_s: float = 1.0, bucket_s: float | None = None
) -> DataFrame:
    """Bidirectional flows: a silence longer than the idle timeout starts a new flow; the source is
    the sender of the first packet.

    Packets are put into sessions inside (conversation, time bucket) first, so a hot conversation is
    split by time. Only the first and last session of a bucket can go on in another bucket; these few
    are merged per conversation. One shuffle of the packets, one of the edge sessions.
    """
    timeout_us = int(round(idle_timeout_s * 1_000_000))
    width_us = int(round((bucket_s or BUCKET_TIMEOUTS * idle_timeout_s) * 1_000_000)) or 1
    rows = with_conversation(packets).drop("ts").withColumn("_bucket", F.floor(F.col("us") / width_us))
    in_bucket = W.Window.partitionBy(*KEY, "_bucket")
    by_time = in_bucket.orderBy("us", "packet_id")
    gap = F.coalesce(F.col("us") - F.lag("us").over(by_time) > timeout_us, F.lit(True))
    sofar = by_time.rowsBetween(W.Window.unboundedPreceding, 0)
    marked = rows.withColumn("_gap", gap.cast("int")).withColumn("_session", F.sum("_gap").over(sofar))
    # a session's first packet is the one after the gap
    first = F.max(F.when(F.col("_gap") == 1, F.col("forward"))).alias("first_forward")
    partial = marked.groupBy(*KEY, "_bucket", "_session").agg(first, *direction_sums())
    last = F.max("_session").over(in_bucket)
    edge = partial.withColumn("_edge", (F.col("_session") == 1) | (F.col("_session") == last))

    by_start = W.Window.partitionBy(*KEY).orderBy("_bucket", "_session")
    silent = F.coalesce(F.col("first_us") - F.lag("last_us").over(by_start) > timeout_us, F.lit(True))
    upto = by_start.rowsBetween(W.Window.unboundedPreceding, 0)
    chained = edge.filter("_edge").withColumn("_silent", silent.cast("int")).withColumn(
        "_flow", F.sum("_silent").over(upto)
    )
    first = F.max(F.when(F.col("_silent") == 1, F.col("first_forward"))).alias("first_forward")
    merged = chained.groupBy(*KEY, "_flow").agg(first, *merged_sums()).drop("_flow")
    inner = edge.filter("NOT _edge").select(*merged.columns)
    return merged.unionByName(inner).select(*flow_columns(F.col("first_forward")))


def merged_sums() -> list[Column]:
    """``direction_sums`` of partial sessions."""
    sums = [F.sum(c).alias(c) for c in ("f_pkts", "b_pkts", "f_bytes", "b_bytes")]
    return [*sums, F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.bit_or("tcp_flags").alias("tcp_flags")]
