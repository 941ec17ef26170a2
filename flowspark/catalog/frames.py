"""Binary frames of model inputs, written and read as tables and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, query
from flowspark.flows import flows
from flowspark.session import scratch_path
from flowspark.sources.frames import register_frames
from flowspark.sources.tensors import accepted_messages, tensor_messages, validate_messages

COUNTS = [2, 1]
FRAMES = f"""SELECT flow_id + 1 AS seq, unnest([0, 1, 2]) AS pos, CAST(unnest([OUT_BYTES, IN_BYTES, OUT_PKTS]) AS DOUBLE) AS v FROM ({FLOWS}) q"""


def flow_messages(spark, sf_dir):
    """A message of two inputs for each flow; sequence numbers begin at 1."""
    f = flows(spark, sf_dir).select("ts", F.col("flow_id"), F.array("OUT_BYTES", "IN_BYTES").alias("bytes"), F.array("OUT_PKTS").alias("pkts"))
    return f, tensor_messages(f, ["bytes", "pkts"], F.col("flow_id") + 1)


def floats(messages):
    checked = accepted_messages(validate_messages(messages, COUNTS, 4096))
    return checked.select("seq", F.posexplode("payload").alias("pos", "v")).select("seq", "pos", F.col("v").cast("double").alias("v"))


@query("s12_frames_round_trip", FRAMES)
def _round_trip(spark, sf_dir):
    register_frames(spark)
    path = scratch_path(spark, "frames")
    _, messages = flow_messages(spark, sf_dir)
    messages.write.format("frames").mode("append").save(path)
    return floats(spark.read.format("frames").load(path))


@query("s12_frames_stream", FRAMES)
def _stream(spark, sf_dir):
    """Messages appended in three jobs; a stream takes them up after each and passes them on as frames of its own."""
    register_frames(spark)
    path, out, state = (scratch_path(spark, n) for n in ("frames", "frames-out", "state"))
    _, messages = flow_messages(spark, sf_dir)
    for i in range(3):
        messages.filter(F.pmod("seq", F.lit(3)) == i).write.format("frames").mode("append").save(path)
        live = spark.readStream.format("frames").load(path)
        q = live.writeStream.format("frames").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return floats(spark.read.format("frames").load(out))
