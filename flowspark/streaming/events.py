"""Totals over windows of event time with a table of late rows, and the join of two streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.schemas import require_columns
from flowspark.session import path_exists, remove_path, small_table
from flowspark.streaming.flows import EARLIEST_US, with_clock

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class EventTotals:
    """What is summed up: ``aggs`` maps a name to (sum, min or max; column) over windows of ``width_s`` seconds that
    begin every ``slide_s`` (tumbling without it), counted from the epoch, per ``keys``. Nulls in a key are a group."""

    keys: list[str]
    aggs: dict[str, tuple[str, Column]]
    width_s: int
    slide_s: int | None = None
    time: str = "ts"

    def __post_init__(self):
        unknown = {kind for kind, _ in self.aggs.values()} - set(_MERGE)
        if unknown:
            raise ValueError(f"aggregates that do not merge: {sorted(unknown)}")
        if self.slide_s is not None and (self.slide_s <= 0 or self.width_s % self.slide_s):
            raise ValueError("the width must be a multiple of the slide")

    def spans(self) -> Column:
        """Begins (seconds since the epoch) of the windows that a row belongs to; null for a row without a time."""
        slide = self.slide_s or self.width_s
        last = F.floor(F.unix_micros(F.col(self.time).cast("timestamp")) / F.lit(slide * 1_000_000)) * slide
        return F.transform(F.sequence(F.lit(0), F.lit(self.width_s // slide - 1)), lambda i: (last - i * slide).cast("bigint"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Each row once per window it belongs to, with ``window_start``; once with null if it has no time."""
        require_columns(rows, [*self.keys, self.time])
        timed = F.when(F.col(self.time).isNotNull(), self.spans())
        return rows.select("*", F.explode_outer(timed).alias("window_start"))

    def totals(self, placed: DataFrame) -> DataFrame:
        """One row per window and group that has rows; combined before the shuffle."""
        named = [_MERGE[kind](c).alias(n) for n, (kind, c) in self.aggs.items()]
        return placed.filter("window_start IS NOT NULL").groupBy("window_start", *[quoted(k) for k in self.keys]).agg(*named)

    def merged(self, parts: DataFrame, *more: Column) -> DataFrame:
        named = [_MERGE[kind](n).alias(n) for n, (kind, _) in self.aggs.items()]
        return parts.groupBy("window_start", *[quoted(k) for k in self.keys]).agg(*named, *more)


class EventWindows:
    """``foreachBatch`` function for totals over event time in which no row is lost without a trace.

    The clock of a batch is the latest time in the batches before it less ``delay_s``; a window is closed when its end
    is not after the clock. Below ``out_path``:

    * ``closed``: every window once, when it closes (append mode).
    * ``updates``: the totals so far of each window that a batch changed (update mode); the largest ``batch_id`` counts.
    * ``late``: the rows, once per window that was closed when they came, with ``window_start``; rows without a time with
      a null there. So ``closed`` plus the totals of ``late`` are the totals of all rows.

    Only windows that are still open are carried on, summed up, below ``state_path``: their number follows from the
    delay and the groups, not from the rows. Each batch starts from what the one before left and writes under its own
    number, so a batch that is tried again gives the same tables. Rows whose column ``_tick`` is true move the clock only.
    """

    def __init__(self, spec: EventTotals, state_path: str, out_path: str, delay_s: int = 0):
        self.spec, self.state_path, self.out_path, self.delay_s = spec, state_path, out_path, delay_s

    def _clock(self, spark: SparkSession, batch_id: int) -> int | None:
        """Latest time, in microseconds, of all batches up to this one."""
        path = f"{self.state_path}/clock-{batch_id}"
        if batch_id < 0 or not path_exists(spark, path):
            return None
        return spark.read.schema("clock BIGINT").parquet(path).first()["clock"]

    def _closed(self, clock: int | None) -> Column:
        if clock is None:
            return F.lit(False)
        return (F.col("window_start") + self.spec.width_s) * 1_000_000 <= F.lit(clock - self.delay_s * 1_000_000)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, spec = batch.sparkSession, self.spec
        before = self._clock(spark, batch_id - 1)
        newest = batch.agg(F.max(F.unix_micros(F.col(spec.time).cast("timestamp")))).first()[0]
        clock = max((t for t in (before, newest) if t is not None), default=None)
        rows = batch.filter("NOT _tick").drop("_tick") if "_tick" in batch.columns else batch
        placed = spec.placed(rows)
        late = placed.filter(F.col("window_start").isNull() | self._closed(before))
        late.write.mode("overwrite").parquet(f"{self.out_path}/late/batch_id={batch_id}")

        parts = spec.totals(placed.filter(~self._closed(before))).withColumn("_touched", F.lit(True))
        carried = f"{self.state_path}/windows-{batch_id - 1}"
        if path_exists(spark, carried):
            waiting = spark.read.schema(parts.schema).parquet(carried).filter(~self._closed(before))
            parts = parts.unionByName(waiting.withColumn("_touched", F.lit(False)))
        state = f"{self.state_path}/windows-{batch_id}"
        spec.merged(parts, F.max("_touched").alias("_touched")).write.mode("overwrite").parquet(state)
        now = spark.read.schema(parts.schema).parquet(state)
        for name, chosen in (("closed", self._closed(clock)), ("updates", F.col("_touched"))):
            now.filter(chosen).drop("_touched").write.mode("overwrite").parquet(f"{self.out_path}/{name}/batch_id={batch_id}")
        # written last: a batch without a clock has not ended
        small_table(spark, [(clock,)], "clock BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{self.state_path}/clock-{batch_id}")
        for old in ("windows", "clock"):
            remove_path(spark, f"{self.state_path}/{old}-{batch_id - 2}")


def latest_totals(updates: DataFrame, spec: EventTotals) -> DataFrame:
    """The last totals of each window in the table of updates."""
    names = list(spec.aggs)
    newest = updates.groupBy("window_start", *[quoted(k) for k in spec.keys]).agg(
        F.max_by(F.struct(*[quoted(n) for n in names]), "batch_id").alias("_t")
    )
    return newest.select("window_start", *[quoted(k) for k in spec.keys], *[F.col(f"_t.`{n}`").alias(n) for n in names])


# Width of a time cell in spans of the join.
CELL_SPANS = 8


def join_following(
    left: DataFrame, right: DataFrame, on: list[str], within_s: int, values: dict[str, str], watermark: str = "10 seconds",
    left_ticks: DataFrame | None = None, right_ticks: DataFrame | None = None,
) -> DataFrame:
    """Each row of the stream ``left`` with every row of the stream ``right`` that has the same ``on`` and comes after it
    by event time (ts), at most ``within_s`` seconds later. ``values`` names the right columns to take and what they are
    called. A left row that nothing follows comes out once, with nulls, when the watermark has passed its span.

    Both sides are kept only as long as the watermarks allow a partner. Times are cut into cells: a left row lies in one,
    a right row in its own and, near the beginning of it, in the one before as well (an eighth of the rows). So a key that
    holds most of the stream is spread by time, and a left row is still known to be unmatched in one place.

    A null in ``on`` equals nothing; rows without a time take no part. Repeated rows each count. Tables give the same rows.
    """
    require_columns(left, [*on, "ts"])
    require_columns(right, [*on, "ts", *values])
    if within_s <= 0:
        raise ValueError("the span must be positive")
    cell = CELL_SPANS * within_s * 1_000_000
    us = F.unix_micros("ts")
    lefts = with_clock(left, watermark, left_ticks).filter("ts IS NOT NULL").withColumn("_cell", F.floor(us / F.lit(cell)))
    cells = F.array_distinct(F.array(F.floor(us / F.lit(cell)), F.floor((us - within_s * 1_000_000) / F.lit(cell))))
    # the join needs keys that are not null: naming ts keeps that test above the watermark, which must see the ticks
    timed = F.unix_micros("ts") > F.lit(EARLIEST_US)
    rights = with_clock(right, watermark, right_ticks).filter("ts IS NOT NULL").select(
        *[F.when(timed, quoted(k)).alias(f"_r_{k}") for k in on], F.col("ts").alias("_r_ts"), F.explode(cells).alias("_r_cell"),
        *[quoted(c).alias(f"_v{i}") for i, c in enumerate(values)],
    )
    met = F.col("_cell") == F.col("_r_cell")
    for k in on:
        met = met & (quoted(k) == F.col(f"`_r_{k}`"))
    met = met & (F.col("_r_ts") > F.col("ts")) & (F.col("_r_ts") <= F.col("ts") + F.expr(f"INTERVAL {within_s} SECONDS"))
    found = lefts.join(rights, met, "left_outer")
    return found.select(*[quoted(c) for c in left.columns], *[F.col(f"_v{i}").alias(n) for i, n in enumerate(values.values())])
