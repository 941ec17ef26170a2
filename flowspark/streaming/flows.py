"""Flow assembly on a packet stream."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.assemble import KEY, direction_sums, flow_columns, with_conversation


# Before every time.
EARLIEST_US = -(1 << 62)


def assemble_flows_stream(
    packets: DataFrame, idle_timeout: str = "1 second", watermark: str = "10 seconds",
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Flows as they expire: sessions per conversation, closed once the watermark passed their end.

    The aggregates merge, so sessions are combined inside each partition before the shuffle when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on; a hot
    conversation then ships one partial row per partition and batch. Append output: a flow
    is emitted when something newer than its end plus the watermark has arrived.

    ``ticks`` is a stream of times (column ts) that moves the watermark on while no packet comes; a tick
    is no packet and forms no flow. ``drain`` sends the last one.
    """
    timed = with_clock(packets, watermark, ticks)
    grouped = with_conversation(timed).groupBy(F.session_window("ts", idle_timeout).alias("w"), *KEY)
    first = F.min_by("forward", F.struct("us", "packet_id")).alias("first_forward")
    flows = grouped.agg(first, *direction_sums())
    return flows.select(*flow_columns(F.col("first_forward")))


def with_ticks(stream: DataFrame, ticks: DataFrame | None) -> DataFrame:
    """``stream`` with the column ``_tick``, and a row for each tick that holds nothing but its time."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_tick", F.lit(False))
    if ticks is None:
        return timed
    clock = ticks.select(F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("_tick"))
    return timed.unionByName(clock, allowMissingColumns=True)


def with_clock(stream: DataFrame, watermark: str, ticks: DataFrame | None = None) -> DataFrame:
    """``stream`` with a watermark on ts, which the ticks move on as well; the ticks themselves are left out."""
    if ticks is None:
        return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    timed = with_ticks(stream, ticks).withWatermark("ts", watermark)
    # naming ts keeps the filter above the watermark, which must see the ticks; no time is that early, but the optimizer
    # does not know (a test for null would fall away where ts is known not to be null)
    return timed.filter(~F.col("_tick") | (F.unix_micros("ts") < F.lit(EARLIEST_US))).drop("_tick")


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """The ticks written under ``path`` as a stream."""
    return spark.readStream.schema("ts timestamp").parquet(path)


def send_tick(spark: SparkSession, path: str, at: datetime) -> None:
    spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(path)


def drain(spark: SparkSession, path: str, last: datetime, closes_after_s: float) -> None:
    """End a bounded input: one tick ``closes_after_s`` (idle timeout plus watermark, at least) past its
    last packet lets the next batch emit every flow that is still open."""
    send_tick(spark, path, last + timedelta(seconds=closes_after_s + 1))
