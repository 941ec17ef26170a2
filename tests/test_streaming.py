import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.assemble import assemble_flows
from flowspark.sources.readers import stream_records
from flowspark.streaming.flows import assemble_flows_stream, drain, send_tick, tick_stream
from flowspark.streaming.windows import WindowFeed, sliding_windows_stateful
from tests.test_assemble import A, B, packet
from flowspark.schemas import PACKET_SCHEMA

DDL = "id BIGINT, key STRING, t BIGINT"


def batches():
    """Three arrivals; the last brings rows older than everything before them."""
    rng = random.Random(11)
    out, i = [], 0
    for start in (100, 200, 0):
        rows = []
        for _ in range(60):
            rows.append((i, rng.choice(["hot"] * 6 + ["a", "b", "c"]), start + rng.randrange(50)))
            i += 1
        out.append(rows)
    return out


def expected(arrivals, window, keyed=True):
    """Arrival order between batches, time order inside one."""
    want, history = {}, {}
    for rows in arrivals:
        for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
            past = history.setdefault(key if keyed else None, [])
            past.append(i)
            if len(past) >= window:
                want[i] = past[-window:]
    return want


def run_feed(spark, tmp_path, key, repeat=()):
    got = {}

    def sink(found, batch_id):
        got[batch_id] = {r["end"]: [m["id"] for m in r["win"]] for r in found.collect()}

    feed = WindowFeed(str(tmp_path / "state"), ["id"], ["t", "id"], sink, key, ["end"], 5)
    for n, rows in enumerate(batches()):
        df = spark.createDataFrame(rows, DDL).withColumn("end", F.col("id"))
        for _ in range(2 if n in repeat else 1):
            feed(df, n)
    return {k: v for part in got.values() for k, v in part.items()}


@pytest.mark.parametrize("key", ["key", None])
def test_feed_windows_follow_arrival_order(spark, tmp_path, key):
    assert run_feed(spark, tmp_path, key) == expected(batches(), 5, key is not None)


def test_retried_batches_change_nothing(spark, tmp_path):
    assert run_feed(spark, tmp_path, "key", repeat=(0, 1, 2)) == expected(batches(), 5)


def test_stateful_windows_follow_arrival_order(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for rows in batches():
        spark.createDataFrame(rows, DDL).write.mode("append").parquet(src)
        found = sliding_windows_stateful(stream_records(spark, src, DDL), "key", ["id"], ["t", "id"], 5, keep=["id"])
        q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = {r["id"]: list(r["win_id"]) for r in spark.read.parquet(out).collect()}
    assert got == expected(batches(), 5)


def test_batches_touch_only_the_buckets_of_their_keys(spark, tmp_path):
    def run(others):
        name = f"state-{others}"
        feed = WindowFeed(str(tmp_path / name), ["id"], ["t", "id"], lambda found, _: found.count(), "key", ["end"], 5, buckets=64)
        first = [(i, f"other{i % others}", i) for i in range(others * 2)] + [(10**6 + i, "own", i) for i in range(9)]
        for n, rows in enumerate((first, [(2 * 10**6, "own", 50)])):
            feed(spark.createDataFrame(rows, DDL).withColumn("end", F.col("id")), n)
        return spark.read.parquet(str(tmp_path / name / "carry-1")).count()

    few, many = run(20), run(200)
    assert few <= 4 + 2 and many <= 4 + 2 * 12  # the keys that share the bucket, nothing else


def test_idle_keys_start_afresh(spark, tmp_path):
    got = {}

    def sink(found, batch_id):
        got.update({r["end"]: [m["id"] for m in r["win"]] for r in found.collect()})

    feed = WindowFeed(str(tmp_path / "state"), ["id"], ["t", "id"], sink, "key", ["end"], 3, buckets=2, idle=100)
    arrivals = [
        [(1, "a", 0), (2, "a", 1), (3, "b", 0), (4, "b", 1)], [(5, "a", 50), (6, "b", 300)], [(7, "b", 301), (8, "b", 302)],
    ]
    for n, rows in enumerate(arrivals):
        feed(spark.createDataFrame(rows, DDL).withColumn("end", F.col("id")), n)
    assert got == {5: [1, 2, 5], 8: [6, 7, 8]}


def test_drained_flows_equal_the_batch(spark, tmp_path):
    """No packet is invented: ticks close what is open at the end."""
    from datetime import datetime

    rows = [packet(i, i * 0.7 % 20, A, B if i % 3 else ("10.0.0.9", 53), ["ack"], 20) for i in range(60)]
    src, ticks, out, state = (str(tmp_path / n) for n in ("src", "ticks", "out", "state"))
    table = spark.createDataFrame(rows, PACKET_SCHEMA)
    table.write.parquet(src)
    last = table.agg(F.max("ts")).first()[0]
    assert isinstance(last, datetime)
    send_tick(spark, ticks, table.agg(F.min("ts")).first()[0])

    def run():
        live = assemble_flows_stream(stream_records(spark, src, PACKET_SCHEMA), "1 second", "5 seconds", tick_stream(spark, ticks))
        q = live.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()

    run()
    drain(spark, ticks, last, 6)
    run()
    got = sorted(map(tuple, spark.read.parquet(out).drop("application_name").collect()))
    assert got == sorted(map(tuple, assemble_flows(table, 1.0).drop("application_name").collect()))


def test_streamed_flows_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([0.1, 0.5, 1.0, 1.3, 3.0])
        ends = (A, B) if rng.random() < 0.7 else (A, ("10.0.0.9", 53))
        rows.append(packet(i, t, *(ends if rng.random() < 0.5 else ends[::-1]), ["ack"], 20))
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    late = packet(10_000, t + 3600, ("z", 1), ("z", 2))  # closes every open session
    for part in (rows[:120], rows[120:], [late]):
        spark.createDataFrame(part, PACKET_SCHEMA).write.mode("append").parquet(src)
        live = assemble_flows_stream(stream_records(spark, src, PACKET_SCHEMA), "1 second", "5 seconds")
        q = live.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).filter("src_ip <> 'z'").drop("application_name").collect()))
    want = assemble_flows(spark.createDataFrame(rows, PACKET_SCHEMA), 1.0).drop("application_name")
    assert got == sorted(map(tuple, want.collect()))


def test_tensor_messages_from_a_stream(spark, sf_dir, tmp_path):
    from flowspark.flows import flows
    from flowspark.operators.stats import collect_params
    from flowspark.plans.detection import SEQ_PER_BATCH, tensor_sink, window_stream
    from flowspark.sources.tensors import accepted_messages, validate_messages
    from flowspark.specs import NFV1

    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    f = flows(spark, sf_dir)
    params = collect_params(f, NFV1)
    ddl = ", ".join(f"`{c}` {t}" for c, t in f.dtypes)
    names = ["input_PROTOCOL", "input_IN_PKTS"]
    for part in ("flow_id < 500", "flow_id >= 500"):
        f.filter(part).write.mode("append").parquet(src)
        window_stream(
            stream_records(spark, src, ddl), params, ["ts", "flow_id"], ["flow_id"],
            tensor_sink(out, params, names, {"PROTOCOL": 4}, 1000), state,
        ).awaitTermination()
    m = spark.read.parquet(out)
    assert m.count() == 1000 - 7 == m.select("seq").distinct().count()
    assert m.filter(F.col("seq") > SEQ_PER_BATCH).count() == 500
    checked = validate_messages(m, [32, 8], 1000)
    assert accepted_messages(checked.unionByName(checked)).count() == 993


@pytest.mark.parametrize("buckets", [1, 4])
def test_stateful_windows_of_keys_that_share_a_state(spark, tmp_path, buckets):
    ddl = "key bigint, t int, id bigint, v bigint"
    wide, rng = (1 << 60) + 1, random.Random(9)
    rows = [(rng.choice([None, 0, 5, wide]), t, t, None if t % 5 == 0 else wide + t) for t in range(60)]
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for part in (rows[:20], rows[20:22], rows[22:]):
        spark.createDataFrame(rng.sample(part, len(part)), ddl).coalesce(1).write.mode("append").parquet(src)
        found = sliding_windows_stateful(stream_records(spark, src, ddl), "key", ["id", "v"], ["t"], 4, keep=["id"], buckets=buckets)
        q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
        # one group of state for each bucket, not for each key
        assert spark.read.format("statestore").load(state).count() <= buckets
    want, past = {}, {}
    for key, t, i, v in rows:
        past.setdefault(key, []).append((i, v))
        if len(past[key]) >= 4:
            want[i] = (key, [list(x) for x in zip(*past[key][-4:])])
    got = {r["id"]: (r["key"], [list(r["win_id"]), list(r["win_v"])]) for r in spark.read.parquet(out).collect()}
    assert got == want
