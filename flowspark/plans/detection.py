"""Detection: flows to windows, scores, verdicts and alerts, on a table or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.functions.verdict import score_health, verdict
from flowspark.operators.encode import encode_codes
from flowspark.operators.order import index_rows
from flowspark.operators.windows import (
    CONTEXT_FIELDS, context_struct, keyed_index, model_inputs, sliding_windows,
)
from flowspark.schemas import FittedParams
from flowspark.settings import VerdictSettings
from flowspark.sources.tensors import tensor_messages
from flowspark.sources.writers import alerts
from flowspark.streaming.windows import WindowFeed

# windows (kept columns, ``win`` of encoded flows) -> the same plus ``scores``
ScoreFn = Callable[[DataFrame], DataFrame]


def needed_columns(params: FittedParams, keep: list[str]) -> list[str]:
    return list(dict.fromkeys([*keep, *params.features, *CONTEXT_FIELDS]))


def encode_for_windows(flows: DataFrame, params: FittedParams, keep: list[str]) -> DataFrame:
    """Each flow encoded once, before any window is formed, with its context struct ``ctx``."""
    names = list(dict.fromkeys([*keep, "ctx"]))
    return encode_codes(flows.withColumn("ctx", context_struct()), params, names)


def judge(windows: DataFrame, score: ScoreFn, settings: VerdictSettings) -> DataFrame:
    """Score windows of (features, ctx) structs; add ``ctx``, ``verdict`` and ``health``."""
    scored = score(windows)
    return scored.select(
        *[c for c in scored.columns if c not in ("win", "features")],
        F.transform("win", lambda s: s["ctx"]).alias("ctx"),
        verdict(
            F.col("scores"), settings.labels, settings.benign_label, settings.benign_class_index,
            settings.threshold,
        ).alias("verdict"),
        score_health(F.col("scores")).alias("health"),
    )


def detect_table(
    flows: DataFrame, params: FittedParams, score: ScoreFn, settings: VerdictSettings,
    order: list[str], keep: list[str], window: int = 8, key: str | None = None,
) -> DataFrame:
    """Verdicts for every full window of a table, per ``key`` or over the whole table."""
    needed = list(dict.fromkeys([*keep, *order, *([key] if key else [])]))
    raw = flows.select(*[quoted(c) for c in needed_columns(params, needed)])
    # order first, encode after: sorting evaluates its input twice
    indexed = keyed_index(raw, key, order) if key else index_rows(raw, order)
    encoded = encode_for_windows(indexed, params, [*needed, "idx"])
    found = sliding_windows(encoded, [*params.features, "ctx"], window, keep=needed, key=key)
    return judge(found.drop("idx"), score, settings)


Sink = Callable[[DataFrame, int], None]


def table_sink(path: str) -> Sink:
    """Every batch to its own folder ``batch_id=N``; a retried batch overwrites it."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def alert_sink(path: str, keep: list[str]) -> Sink:
    """Only the attack verdicts, as alerts."""
    write = table_sink(path)
    return lambda judged, batch_id: write(alerts(judged, keep), batch_id)


# Sequence numbers a batch may use.
SEQ_PER_BATCH = 1 << 36


def tensor_sink(
    path: str, params: FittedParams, input_names: list[str], dims: dict[str, int] | None = None,
    max_bytes: int | None = None,
) -> Sink:
    """Windows as tensor messages; the sequence number is made of batch and row number."""
    write = table_sink(path)

    def publish(found: DataFrame, batch_id: int) -> None:
        inputs = model_inputs(found, params, input_names, dims, keep=["idx"])
        seq = F.lit(batch_id * SEQ_PER_BATCH + 1).cast("bigint") + F.col("idx")
        write(tensor_messages(inputs, input_names, seq, max_bytes), batch_id)

    return publish


def window_stream(
    flows: DataFrame, params: FittedParams, order: list[str], keep: list[str], sink: Sink,
    checkpoint: str, window: int = 8, key: str | None = None, trigger: dict | None = None,
):
    """Start a query that hands each micro-batch's encoded windows to ``sink``."""
    needed = list(dict.fromkeys([*keep, *order, *([key] if key else [])]))
    raw = flows.select(*[quoted(c) for c in needed_columns(params, needed)])

    def encode(indexed: DataFrame, names: list[str]) -> DataFrame:
        return encode_for_windows(indexed, params, names)

    feed = WindowFeed(
        f"{checkpoint}/windows", [*params.features, "ctx"], order, sink, key, needed, window, encode
    )
    writer = raw.writeStream.foreachBatch(feed).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def detect_stream(
    flows: DataFrame, params: FittedParams, score: ScoreFn, settings: VerdictSettings,
    order: list[str], keep: list[str], sink: Sink, checkpoint: str, window: int = 8,
    key: str | None = None, trigger: dict | None = None,
):
    """``detect_table`` on a stream: each micro-batch's verdicts go to ``sink``."""

    def judged(found: DataFrame, batch_id: int) -> None:
        sink(judge(found.drop("idx"), score, settings), batch_id)

    return window_stream(flows, params, order, keep, judged, checkpoint, window, key, trigger)
