"""Model inputs as flat messages: one row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the message contract.
MAGIC = 0x314D4853
VERSION = 1
MAX_INPUTS = 16
HEADER_BYTES = 4 + 4 + 8 + 4 + 4 + 4 * MAX_INPUTS
FLOAT_BYTES = 4


def _flat(df: DataFrame, name: str) -> Column:
    x, depth = F.col(f"`{name}`"), df.schema[name].dataType
    while isinstance(depth, T.ArrayType) and isinstance(depth.elementType, T.ArrayType):
        x, depth = F.flatten(x), depth.elementType
    return x.cast("array<float>")


def tensor_messages(
    df: DataFrame, inputs: list[str], seq: Column, max_bytes: int | None = None
) -> DataFrame:
    """Inputs flattened in model order and joined: (magic, version, seq, n_inputs, total_floats,
    elem_counts, payload). Too many inputs fail at once, an oversized message when it is reached.

    A message is made as one generated row, so that conditions on its fields read the message that was made and are
    not turned into conditions on the inputs, which would make all of it anew for every field they name.
    """
    if len(inputs) > MAX_INPUTS:
        raise ValueError(f"too many model inputs: {len(inputs)} > {MAX_INPUTS}")
    flat = [F.col(f"_flat{i}") for i in range(len(inputs))]
    parts = df.select(seq.cast("bigint").alias("seq"), *[_flat(df, n).alias(f"_flat{i}") for i, n in enumerate(inputs)])
    body = F.struct(
        F.array(*[F.size(x) for x in flat]).alias("elem_counts"), F.concat(*flat).alias("payload")
    )
    rows = parts.select("seq", F.inline(F.array(body))).withColumns({
        "magic": F.lit(MAGIC), "version": F.lit(VERSION), "n_inputs": F.lit(len(inputs)),
    })
    total = F.size("payload")
    if max_bytes is not None:
        too_large = total * FLOAT_BYTES + HEADER_BYTES > max_bytes
        total = F.when(too_large, F.raise_error(F.lit("message too large")).cast("int")).otherwise(total)
    return rows.select("magic", "version", "seq", "n_inputs", total.alias("total_floats"), "elem_counts", "payload")


def validate_messages(
    df: DataFrame, expected_counts: list[int], max_bytes: int, last_seq: int = 0
) -> DataFrame:
    """``reject_reason`` (NULL for a good message): magic, version, sequence, input count, element counts,
    total, size."""
    declared = F.aggregate("elem_counts", F.lit(0), lambda a, v: a + v)
    reason = (
        F.when(F.col("magic") != MAGIC, "magic")
        .when(F.col("version") != VERSION, "version")
        .when(F.col("seq").isin(0, last_seq), "sequence")
        .when(F.col("n_inputs") != len(expected_counts), "input count")
        .when(F.col("elem_counts") != F.array(*[F.lit(int(n)) for n in expected_counts]), "element count")
        .when(declared != F.col("total_floats"), "total")
        .when(F.col("total_floats") * FLOAT_BYTES + HEADER_BYTES > max_bytes, "size")
    )
    return df.withColumn("reject_reason", reason)


def accepted_messages(validated: DataFrame) -> DataFrame:
    """Good messages, each sequence number once: of differing duplicates the smallest, so the result does
    not depend on their order. Combined before the shuffle.

    On a stream the first one that arrives is kept and ``dropDuplicatesWithinWatermark`` bounds the state.
    """
    good = validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    if good.isStreaming:
        return good.dropDuplicatesWithinWatermark(["seq"])
    rest = [c for c in good.columns if c != "seq"]
    least = good.groupBy("seq").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_m"))
    return least.select(*[F.col("seq") if c == "seq" else F.col(f"_m.`{c}`").alias(c) for c in good.columns])
