"""Windows of event time with late rows, the join of two streams, and flow assembly with own state, against plain Python."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowspark.operators.assemble import assemble_flows
from flowspark.schemas import PACKET_SCHEMA
from flowspark.sources.readers import stream_records
from flowspark.streaming.events import EventTotals, EventWindows, join_following, latest_totals
from flowspark.streaming.flows import drain, send_tick, tick_stream
from flowspark.streaming.sessions import assemble_flows_stateful, rocksdb_state
from tests.test_assemble import A, B, packet

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
E0 = int(T0.timestamp())
DDL = "host STRING, ts TIMESTAMP, v BIGINT"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def arrivals():
    """Rows out of order, some far behind, some without a time or a host."""
    rng = random.Random(3)
    out = []
    for n in range(4):
        rows = [(rng.choice(["hot"] * 4 + ["a", None]), at(n * 100 + rng.randrange(100)), rng.randrange(50)) for _ in range(40)]
        rows += [("a", at(rng.randrange(n * 100 + 1)), 1) for _ in range(10)] + [("a", None, 7)]
        out.append(rows + rows[:3])
    return out


@pytest.mark.parametrize("width, slide, repeat", [(30, None, ()), (60, 20, (1, 2, 3))])
def test_late_rows_and_closed_windows_are_all_rows(spark, tmp_path, width, slide, repeat):
    spec = EventTotals(["host"], {"n": ("sum", F.lit(1)), "total": ("sum", F.col("v")), "most": ("max", F.col("v"))}, width, slide)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    delay, clock = 25, None
    closed, late = defaultdict(list), []
    for n, rows in enumerate([*arrivals(), []]):
        if rows:
            df = spark.createDataFrame(rows, DDL).withColumn("_tick", F.lit(False))
        else:  # the last batch only moves the clock
            df = spark.createDataFrame([(None, at(10_000), None)], DDL).withColumn("_tick", F.lit(True))
        for _ in range(2 if n in repeat else 1):
            EventWindows(spec, state, out, delay)(df, n)
        for host, ts, v in rows:
            if ts is None:
                late.append((host, None, v))
                continue
            s = int(ts.timestamp())
            step = slide or width
            for i in range(width // step):
                start = s // step * step - i * step
                if clock is not None and start + width <= clock - delay:
                    late.append((host, start, v))
                else:
                    closed[start, host].append(v)
        clock = max([clock or 0, *[int(ts.timestamp()) for _, ts, _ in rows if ts is not None]])
    want = {(*k, len(v), sum(v), max(v)) for k, v in closed.items()}
    assert len(late) > 20
    for found in (spark.read.parquet(f"{out}/closed"), latest_totals(spark.read.parquet(f"{out}/updates"), spec)):
        rows = [tuple(r) for r in found.select("window_start", "host", "n", "total", "most").collect()]
        assert len(rows) == len(want) and set(rows) == want
    got = [tuple(r) for r in spark.read.parquet(f"{out}/late").select("host", "window_start", "v").collect()]
    assert sorted(got, key=repr) == sorted(late, key=repr)
    # closed windows are no longer carried
    carried = spark.read.parquet(f"{state}/windows-3").filter(F.col("window_start") < E0 + 100)
    assert carried.count() < len([k for k in closed if k[0] < E0 + 100])


def test_windows_that_cannot_be_merged(spark):
    with pytest.raises(ValueError):
        EventTotals([], {"x": ("avg", F.lit(1))}, 10)
    with pytest.raises(ValueError):
        EventTotals([], {"x": ("sum", F.lit(1))}, 10, 3)


def test_an_empty_first_batch_has_no_clock(spark, tmp_path):
    spec = EventTotals(["host"], {"n": ("sum", F.lit(1))}, 10)
    feed = EventWindows(spec, str(tmp_path / "s"), str(tmp_path / "o"), 0)
    feed(spark.createDataFrame([], DDL), 0)
    feed(spark.createDataFrame([("a", at(5), 1)], DDL), 1)
    feed(spark.createDataFrame([("a", at(25), 1)], DDL), 2)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "o" / "closed")).select("window_start", "host", "n").collect()] == [(E0, "a", 1)]


def following(lefts, rights, within):
    want = []
    for i, host, t in lefts:
        met = [j for j, h, u in rights if host is not None and h == host and t is not None and u is not None and t < u <= t + within]
        if t is not None:
            want += [(i, j) for j in met] or [(i, None)]
    return sorted(want, key=repr)


def test_two_streams_meet_across_batches(spark, tmp_path):
    """Pairs whose sides come in different batches, cells with a border between the sides, and rows that nothing follows."""
    rng = random.Random(9)
    lefts = [(i, rng.choice(["hot", "hot", "a", None]), rng.randrange(900)) for i in range(60)]
    rights = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(900)) for i in range(150)] + [(999, "hot", 80), (999, "hot", 80)]
    lefts += [(100, "hot", 79), (101, "hot", 80), (102, "hot", 70), (103, "a", None), (104, "alone", 899), (105, "hot", 899)]
    left_at, right_at, ticks, out, state = (str(tmp_path / n) for n in ("l", "r", "t", "o", "s"))
    send_tick(spark, ticks, at(0))
    ldl, rdl = "id BIGINT, host STRING, ts TIMESTAMP", "flow BIGINT, host STRING, ts TIMESTAMP"
    for lo in (0, 300, 600):
        inside = lambda rows: [(i, h, None if t is None else at(t)) for i, h, t in rows if lo <= (t or 0) < lo + 300]
        spark.createDataFrame(inside(lefts), ldl).write.mode("append").parquet(left_at)
        spark.createDataFrame(inside(rights), rdl).write.mode("append").parquet(right_at)
        if lo == 600:
            drain(spark, ticks, at(900), 60)
        found = join_following(
            stream_records(spark, left_at, ldl), stream_records(spark, right_at, rdl), ["host"], 10, {"flow": "flow_id"},
            "20 seconds", tick_stream(spark, ticks), tick_stream(spark, ticks),
        )
        q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept < 20  # what the watermark has passed is let go
    got = [(r["id"], r["flow_id"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == following(lefts, rights, 10)


def test_joined_tables_and_bad_arguments(spark):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(50))], "id INT, host STRING, ts TIMESTAMP")
    right = spark.createDataFrame([(7, "a", at(10)), (8, "a", at(11))], "flow INT, host STRING, ts TIMESTAMP")
    found = join_following(left, right, ["host"], 10, {"flow": "next"})
    assert sorted((r["id"], r["next"]) for r in found.select("id", F.coalesce("next", F.lit(0)).alias("next")).collect()) == [(1, 7), (2, 0)]
    assert join_following(left.limit(0), right, ["host"], 10, {"flow": "next"}).count() == 0
    with pytest.raises(ValueError):
        join_following(left, right, ["host"], 0, {"flow": "next"})


def test_flows_with_own_state_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([0.1, 0.5, 1.0, 1.3, 3.0])
        ends = (A, B) if rng.random() < 0.7 else (A, ("10.0.0.9", 53))
        rows.append(packet(i, t, *(ends if rng.random() < 0.5 else ends[::-1]), ["ack"], 20))
    src, ticks, out, state = (str(tmp_path / n) for n in ("src", "ticks", "out", "state"))
    table = spark.createDataFrame(rows, PACKET_SCHEMA)
    send_tick(spark, ticks, table.agg(F.min("ts")).first()[0])
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    open_sessions, bounds, seen = [], [], []
    for n, part in enumerate((rows[:100], rows[100:110], rows[110:])):
        shuffled = rng.sample(part, len(part))  # any order inside a batch
        spark.createDataFrame(shuffled, PACKET_SCHEMA).write.mode("append").parquet(src)
        if n == 2:
            drain(spark, ticks, table.agg(F.max("ts")).first()[0], 6)
        found = assemble_flows_stateful(stream_records(spark, src, PACKET_SCHEMA), 1.0, "5 seconds", tick_stream(spark, ticks))
        with rocksdb_state(spark):
            q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
        open_sessions.append(spark.read.format("statestore").option("stateVarName", "open").load(state).count())
        seen += [r[1] for r in part]
        bounds.append(sum(ts > max(seen) - timedelta(seconds=6) for ts in seen))  # timeout and watermark
    got = sorted(map(tuple, spark.read.parquet(out).drop("application_name").collect()))
    assert got == sorted(map(tuple, assemble_flows(table, 1.0).drop("application_name").collect()))
    assert open_sessions[-1] == 0 and all(n <= b < 15 for n, b in zip(open_sessions, bounds))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider


def test_sessions_of_conversations_that_share_a_state():
    import pandas as pd

    from flowspark.streaming.sessions import CONVERSATION, FIELDS, merge_sessions

    def part(host, nulls, first, last, i):
        return (host, 1, "b", 2, 6, nulls, first, last, i, True, 1, 0, 10, 0, 1 << i)

    rows = [part("a", 0, 0, 5, 0), part("0", 0, 3, 4, 1), part("0", 1, 4, 4, 2), part("a", 0, 7, 9, 3), part("a", 0, 20, 21, 4)]
    parts = pd.DataFrame(rows, columns=[*CONVERSATION, *FIELDS])
    found = merge_sessions(parts, 2)
    got = sorted(map(tuple, found[["lo_ip", "key_nulls", "first_us", "last_us", "f_pkts", "tcp_flags"]].to_numpy().tolist()))
    # a null end point is no other conversation's, whatever value stands for it
    assert got == [("0", 0, 3, 4, 1, 2), ("0", 1, 4, 4, 1, 4), ("a", 0, 0, 9, 2, 9), ("a", 0, 20, 21, 1, 16)]
