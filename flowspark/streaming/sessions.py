"""Flow assembly with state and timers of its own, for streams in which most conversations are short."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowspark.operators.assemble import KEY, flow_columns, with_conversation
from flowspark.streaming.flows import with_clock

SUMS = ["f_pkts", "b_pkts", "f_bytes", "b_bytes"]
SESSION = "first_us BIGINT, last_us BIGINT, first_id BIGINT, first_forward BOOLEAN, " + ", ".join(f"{c} BIGINT" for c in SUMS) + ", tcp_flags INT"
FIELDS = [f.split()[0] for f in SESSION.split(", ")]

# Groups of conversations that share one state. A group costs its calls and a message for each, so conversations of a
# few packets are handled together; each group should still hold far fewer sessions than fit one task.
STATE_BUCKETS = 512
# Bit i is set where the i-th part of the key is null; the part itself then holds a value that means nothing.
NULLS = "key_nulls"
CONVERSATION = [*KEY, NULLS]


def merge_sessions(parts: pd.DataFrame, timeout_us: int) -> pd.DataFrame:
    """Sessions of one conversation that overlap, or follow with no longer silence than the timeout, become one."""
    columns = [*CONVERSATION, *FIELDS]
    if len(parts) < 2:
        return parts[columns]
    talk = parts.groupby(CONVERSATION, sort=False, dropna=False).ngroup()
    p = parts.assign(_talk=talk).sort_values(["_talk", "first_us", "first_id"], kind="stable")
    talk, reach = p["_talk"].to_numpy(), p.groupby("_talk")["last_us"].cummax().to_numpy()
    apart = (talk[1:] != talk[:-1]) | (p["first_us"].to_numpy()[1:] - reach[:-1] > timeout_us)
    starts = np.flatnonzero(np.r_[True, apart])
    out = p.iloc[starts][[*CONVERSATION, "first_us", "first_id", "first_forward"]].reset_index(drop=True)
    out["last_us"] = np.maximum.reduceat(p["last_us"].to_numpy(), starts)
    for c in SUMS:
        out[c] = np.add.reduceat(p[c].to_numpy(), starts)
    out["tcp_flags"] = np.bitwise_or.reduceat(p["tcp_flags"].to_numpy(), starts)
    return out[columns]


class FlowSessions(StatefulProcessor):
    """State of a bucket of conversations: a list of the sessions that are still open. Packets of a batch are summed up and
    appended to it unread. A timer stands at the earliest end of a session plus the timeout, or before; it reads the list,
    emits what has ended, keeps the rest and sets the next one, so a conversation that falls silent is let go without
    another packet of its own."""

    def __init__(self, timeout_us: int, session: str):
        self.timeout_us, self.session = timeout_us, session

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.session)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for chunk in rows:
            fwd = chunk["forward"].astype(bool)
            size = chunk["bytes"].fillna(0).astype("int64")
            packets = pd.DataFrame({
                **{c: chunk[c] for c in CONVERSATION},
                "first_us": chunk["us"], "last_us": chunk["us"], "first_id": chunk["packet_id"], "first_forward": fwd,
                "f_pkts": fwd.astype("int64"), "b_pkts": (~fwd).astype("int64"), "f_bytes": size.where(fwd, 0),
                "b_bytes": size.where(~fwd, 0), "tcp_flags": chunk["flags"],
            })
            found = merge_sessions(packets, self.timeout_us)
            self.open.appendList(_tuples(found))
            earliest.append(int(found["last_us"].min()))
        if earliest:
            self._wake_at(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(list(self.open.get()), columns=[*CONVERSATION, *FIELDS])
        if known.empty:
            return
        sessions = merge_sessions(known, self.timeout_us)
        ended = sessions["last_us"] + self.timeout_us <= timerValues.getCurrentWatermarkInMs() * 1000
        left = sessions[~ended]
        if not left.empty:
            self._wake_at(int(left["last_us"].min()))
        if not ended.any():
            return
        if left.empty:
            self.open.clear()
        else:
            self.open.put(_tuples(left))
        yield sessions[ended]

    def _wake_at(self, last_us: int) -> None:
        self.handle.registerTimer(-(-(last_us + self.timeout_us) // 1000))

    def close(self) -> None:
        pass


def _tuples(sessions: pd.DataFrame) -> list[tuple]:
    return list(zip(*[sessions[c].tolist() for c in [*CONVERSATION, *FIELDS]]))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which lists and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def assemble_flows_stateful(
    packets: DataFrame, idle_timeout_s: float = 1.0, watermark: str = "10 seconds", ticks: DataFrame | None = None,
    buckets: int = STATE_BUCKETS,
) -> DataFrame:
    """``assemble_flows_stream`` as a processor with list state and event-time timers; start it inside ``rocksdb_state``.

    Packets not after the watermark are late and left out, and so are those without a time. Packets of one conversation
    in one batch go through one task; ``assemble_flows_stream`` combines them before the shuffle, so prefer it where
    a single conversation carries a large share. A null end point or protocol is a conversation of its own.

    Conversations share state in ``buckets`` by their key, whose number stays the same over a checkpoint's life.
    """
    timeout_us = int(round(idle_timeout_s * 1_000_000))
    timed = with_conversation(with_clock(packets, watermark, ticks).filter("ts IS NOT NULL"))
    types = dict(timed.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in KEY) + f", {NULLS} INT, " + SESSION
    # pandas has no null integers: nulls travel as a bit of their own
    nulls = sum((F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(KEY)), F.lit(0))
    dealt = timed.withColumns({NULLS: nulls, "bucket": F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")})
    dealt = dealt.withColumns({k: F.coalesce(F.col(k), F.lit("0").cast(types[k])) for k in KEY})
    found = dealt.groupBy("bucket").transformWithStateInPandas(FlowSessions(timeout_us, schema), schema, "Append", "EventTime")
    known = {k: F.when(F.col(NULLS).bitwiseAND(F.lit(1 << i)) == 0, F.col(k)) for i, k in enumerate(KEY)}
    return found.withColumns(known).select(*flow_columns(F.col("first_forward")))
