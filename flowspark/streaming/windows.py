"""Sliding windows of the last W flows on a stream, in arrival order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowspark.functions.numeric import quoted
from flowspark.operators.order import order_rows
from flowspark.operators.windows import sliding_windows
from flowspark.session import lookup_join, path_exists, remove_path, small_table


class WindowFeed:
    """``foreachBatch`` function that hands every micro-batch's full windows to ``sink(windows,
    batch_id)``, which must write them before it returns. ``idx`` numbers the rows of the batch.

    The last ``window - 1`` rows per key are carried from batch to batch as tables under
    ``state_path``, in ``buckets`` by key. A batch reads and rewrites only the buckets of its own keys;
    choose ``buckets`` so that one holds few keys. A small table per batch says which batch wrote a
    bucket last; a retried batch starts from the one before it. Inside a batch the rows go through the
    same range-sorted, chunked windows as a table, so one very busy key, or a single window over the
    whole stream (``key=None``), still uses all tasks.

    Rows of a batch are put in ``order``; rows of later batches follow, however old they are. With
    ``idle`` a key whose carried rows are older than that before its next row (by ``order[0]``; seconds for
    times) starts afresh, and each batch also clears one more bucket of keys that are idle for longer.
    ``prepare(rows, names)`` may turn the indexed rows into others that hold ``cols`` besides the
    given names; the carried rows are those before it.
    """

    def __init__(
        self, state_path: str, cols: list[str], order: list[str],
        sink: Callable[[DataFrame, int], None], key: str | None = None,
        keep: list[str] | None = None, window: int = 8,
        prepare: Callable[[DataFrame, list[str]], DataFrame] | None = None,
        buckets: int = 256, idle: float | None = None,
    ):
        self.prepare, self.buckets, self.idle = prepare, buckets if key else 1, idle
        self.state_path, self.cols, self.order = state_path, cols, order
        self.sink, self.key, self.keep, self.window = sink, key, keep or [], window

    def _bucket(self) -> Column:
        if not self.key:
            return F.lit(0)
        return F.pmod(F.xxhash64(quoted(self.key)), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """Batch that wrote each bucket last, after ``batch_id``; at most ``buckets`` rows."""
        if batch_id < 0:
            return {}
        rows = spark.read.schema(_VERSIONS).parquet(f"{self.state_path}/versions-{batch_id}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def _carry_path(self, bucket: int, batch_id: int) -> str:
        return f"{self.state_path}/carry-{batch_id}/_bucket={bucket}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = [*self.keep, *self.order, *([self.key] if self.key else [])]
        names = batch.columns if self.prepare else list(dict.fromkeys([*self.cols, *own]))
        fresh = batch.select(
            *[quoted(n) for n in names], F.lit(True).alias("_fresh"), F.lit(0).cast("bigint").alias("_seq")
        )
        versions = self._versions(spark, batch_id - 1)
        touched = {r[0] for r in fresh.select(self._bucket()).distinct().collect()}
        if self.idle is not None and self.key:
            touched.add(batch_id % self.buckets)
        paths = [self._carry_path(b, versions[b]) for b in sorted(touched) if b in versions]
        paths = [p for p in paths if path_exists(spark, p)]
        carried = spark.read.schema(fresh.schema).parquet(*paths) if paths else fresh.limit(0)
        rows, waiting = self._split(fresh, carried) if paths and self.key else (carried.unionByName(fresh), None)
        lead = [self.key] if self.key else []
        with order_rows(rows, [*lead, "_fresh", "_seq", *self.order]) as ordered:
            indexed = ordered.indexed().drop("_part", "_pos")
            ready = indexed
            if self.prepare:
                ready = self.prepare(indexed, list(dict.fromkeys([*own, "_fresh", "idx"])))
            found = sliding_windows(
                ready, self.cols, self.window, keep=list(dict.fromkeys([*lead, *self.keep])), key=self.key,
                ends=F.col("_fresh"),
            )
            self.sink(found, batch_id)
            self._write_carry(indexed, ordered.n, waiting, batch_id)
        self._write_versions(spark, versions, touched, batch_id)

    def _split(self, fresh: DataFrame, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows to build windows from, and carried rows of keys that the batch does not have."""
        at = F.col(self.order[0]).cast("double")
        starts = fresh.groupBy(quoted(self.key).alias("_k")).agg(F.min(at).alias("_from"))
        last = F.max(at).over(Window.partitionBy(quoted(self.key)))
        dated = carried.withColumn("_last", last)
        placed = dated.join(starts, dated[self.key].eqNullSafe(starts["_k"]), "left")
        here = F.col("_from").isNotNull()
        used, waiting = placed.filter(here), placed.filter(~here)
        if self.idle is not None:
            now = fresh.agg(F.max(at)).first()[0]
            used = used.filter(F.col("_last") >= F.col("_from") - self.idle)
            waiting = waiting.filter(F.col("_last") >= F.lit(now) - self.idle) if now is not None else waiting
        columns = [quoted(c) for c in fresh.columns]
        return used.select(*columns).unionByName(fresh), waiting.select(*columns)

    def _write_carry(self, indexed: DataFrame, n: int, waiting: DataFrame | None, batch_id: int) -> None:
        if self.key:
            ends = indexed.groupBy(self.key).agg(F.max("idx").alias("_last"))
            tail = lookup_join(indexed, ends, [self.key])
        else:
            tail = indexed.withColumn("_last", F.lit(n - 1).cast("bigint"))
        tail = tail.filter(F.col("idx") > F.col("_last") - (self.window - 1))
        tail = tail.withColumn("_seq", F.col("idx")).withColumn("_fresh", F.lit(False)).drop("idx", "_last")
        if waiting is not None:
            tail = tail.unionByName(waiting)
        tail = tail.withColumn("_bucket", self._bucket())
        tail.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.state_path}/carry-{batch_id}")

    def _write_versions(self, spark: SparkSession, versions: dict[int, int], touched: set[int], batch_id: int) -> None:
        now = versions | {b: batch_id for b in touched}
        table = small_table(spark, sorted(now.items()), _VERSIONS)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.state_path}/versions-{batch_id}")
        if batch_id > 1 and path_exists(spark, f"{self.state_path}/versions-{batch_id - 2}"):
            # a retried batch needs what the one before it left, nothing older
            for bucket, old in self._versions(spark, batch_id - 2).items():
                if versions.get(bucket) != old:
                    remove_path(spark, self._carry_path(bucket, old))
            remove_path(spark, f"{self.state_path}/versions-{batch_id - 2}")


_VERSIONS = "bucket INT, batch BIGINT"


# Groups of keys that share one state of ``sliding_windows_stateful``.
STATE_BUCKETS = 1024


def sliding_windows_stateful(
    stream: DataFrame, key: str, cols: list[str], order: list[str], window: int = 8,
    keep: list[str] | None = None, idle_s: float | None = None, buckets: int = STATE_BUCKETS,
) -> DataFrame:
    """The same per key as one continuous stateful query (state: the last ``window - 1`` rows, dropped
    when a key has had no row for ``idle_s`` seconds of processing time).

    Keys share state in ``buckets``, so that keys of a few rows are handled together; their number stays
    the same over a checkpoint's life. One bucket of one micro-batch is sorted in one task, so bound the
    trigger size, and use ``WindowFeed`` when a single key carries a large share of the stream.

    Output: key, ``keep`` of the last row, and per column an array of ``window`` values.
    """
    keep = [c for c in keep or [] if c != key]
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    fields = [f"`{key}` {types[key]}"] + [f"`{c}` {types[c]}" for c in keep]
    fields += [f"`win_{c}` array<{types[c]}>" for c in cols]
    state_cols = list(dict.fromkeys([*cols]))
    # per key: its value, whether it is null, its number of rows, when it was last seen; per row: the columns
    state_schema = f"`_keys` array<{types[key]}>, `_nulls` array<boolean>, `_counts` array<int>, `_seen` array<bigint>, "
    state_schema += ", ".join(f"`{c}` array<{types[c]}>" for c in state_cols)
    idle_ms = None if idle_s is None else int(idle_s * 1000)
    # pandas has no null integers: these travel as a value and a flag
    whole = [types[c] in ("tinyint", "smallint", "int", "bigint") for c in state_cols]

    def exact(rows: pd.DataFrame, i: int) -> list:
        values = rows[f"_value{i}" if whole[i] else state_cols[i]].tolist()
        if whole[i] and rows[f"_absent{i}"].any():
            return [None if gone else v for v, gone in zip(values, rows[f"_absent{i}"])]
        return values

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = state.get if state.exists else tuple([] for _ in range(4 + len(state_cols)))
        old_keys, old_nulls, counts, seen, held = *past[:4], past[4:]
        new = None if state.hasTimedOut else pd.concat(list(batches), ignore_index=True)
        fresh = 0 if new is None else len(new)
        now = 0 if idle_ms is None else state.getCurrentProcessingTimeMs()
        # a code for each key; None is a null key, whatever value stands for it
        values = pd.Series([*old_keys, *(new["_key"].tolist() if fresh else [])], dtype=object)
        nulls = np.array([*old_nulls, *(new["_null"].tolist() if fresh else [])], dtype=bool)
        codes = pd.factorize(pd.factorize(values, use_na_sentinel=False)[0] * 2 + nulls)[0]
        n_old, n_keys = len(old_keys), int(codes.max()) + 1 if len(codes) else 0
        own, order_codes = codes[n_old:], codes[:n_old]
        if fresh:
            rank = new.assign(_code=own).sort_values(["_code", *order], kind="stable").index.to_numpy()
            new, own = new.loc[rank], own[rank]
        # rows carried along stand before the new ones of their key
        owner = np.r_[np.repeat(order_codes, counts), own].astype(np.int64)
        place = np.argsort(owner, kind="stable")
        owner, is_new = owner[place], place >= len(place) - fresh
        size = np.bincount(owner, minlength=n_keys)
        start = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if n_keys else np.zeros(0, np.int64)
        at = np.arange(len(owner)) - start[owner]
        history = {}
        for i, c in enumerate(state_cols):
            # an object array, so that nulls and wide integers stay what they are
            both = np.empty(len(place), dtype=object)
            both[:] = [*held[i], *(exact(new, i) if fresh else [])]
            history[c] = both[place]

        first = np.zeros(n_keys, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]  # a place in ``values`` that has the key
        last_seen = np.zeros(n_keys, np.int64)
        last_seen[order_codes] = seen
        last_seen[own] = now
        stays = np.ones(n_keys, bool) if idle_ms is None else last_seen + idle_ms >= now
        carried = stays[owner] & (size[owner] - at < window)
        if stays.any():
            kept = np.flatnonzero(stays)
            state.update((
                values[first[kept]].tolist(), nulls[first[kept]].tolist(),
                np.minimum(size[kept], window - 1).tolist(), last_seen[kept].tolist(),
                # rows in the order of their keys
                *[history[c][carried].tolist() for c in state_cols],
            ))
            if idle_ms is not None:
                state.setTimeoutDuration(max(1, int(last_seen[kept].min()) + idle_ms - now))
        elif state.exists:
            state.remove()
        ends = np.flatnonzero(is_new & (at >= window - 1))
        if len(ends):
            rows = place[ends] - (len(place) - fresh)
            named = new["_key"].iloc[rows]
            absent = new["_null"].iloc[rows].to_numpy(dtype=bool)
            if absent.any():
                named = pd.Series([None if gone else v for v, gone in zip(named.tolist(), absent)], dtype=object)
            out = {key: named.reset_index(drop=True)}
            for c in keep:
                out[c] = new[c].iloc[rows].reset_index(drop=True)
            for c in cols:
                out[f"win_{c}"] = list(np.lib.stride_tricks.sliding_window_view(history[c], window)[ends - (window - 1)])
            yield pd.DataFrame(out)

    own_cols = [quoted(c) for c in dict.fromkeys([*keep, *order, *[c for c, w in zip(state_cols, whole) if not w]])]
    for i, c in enumerate(state_cols):
        if whole[i]:
            own_cols += [F.coalesce(quoted(c), F.lit(0).cast(types[c])).alias(f"_value{i}"), quoted(c).isNull().alias(f"_absent{i}")]
    absent = quoted(key).isNull()
    dealt = stream.select(
        F.pmod(F.xxhash64(quoted(key)), F.lit(buckets)).cast("int").alias("_bucket"), absent.alias("_null"),
        F.coalesce(quoted(key), F.lit("0").cast(types[key])).alias("_key"), *own_cols,
    )
    return dealt.groupBy("_bucket").applyInPandasWithState(
        step, ", ".join(fields), state_schema, "append",
        GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
