"""The index of a table that grows, and binary frames."""

import os
import random

import numpy as np
import pytest

from flowspark.operators.appended import IndexedTable
from flowspark.sources import frames
from flowspark.sources.tensors import MAGIC, VERSION, validate_messages

DDL = "t BIGINT, id BIGINT, x STRING"


def files_below(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def indexed(table):
    return sorted((r["idx"], r["t"], r["id"], r["x"]) for r in table.rows().collect())


def test_index_after_appends(spark, tmp_path):
    rng = random.Random(8)
    table = IndexedTable(spark, str(tmp_path / "t"), ["t", "id"], partitions=4)
    with pytest.raises(ValueError):
        table.rows()
    known, n = [], 0
    arrivals = [
        [(100 + rng.randrange(50)) for _ in range(200)],
        [(200 + rng.randrange(50)) for _ in range(100)],  # all after the first
        [(300 + rng.randrange(9)) for _ in range(50)] + [101, 101, 220],  # some late
        [],
        [3, 5, 100],  # before everything
        [149, 150, 155, 309, 400],  # between folders
    ]
    for times in arrivals:
        rows = [(t, (n := n + 1), f"r{n}" if n % 7 else None) for t in times]
        rng.shuffle(rows)
        table.append(spark.createDataFrame(rows, DDL))
        known += rows
        assert indexed(table) == [(i, *r) for i, r in enumerate(sorted(known, key=lambda r: r[:2]))]
    assert table.count() == len(known)
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1, 1)], "t BIGINT, id BIGINT"))


def test_untouched_files_stay(spark, tmp_path):
    table = IndexedTable(spark, str(tmp_path / "t"), ["t", "id"], partitions=4)
    make = lambda rows: spark.createDataFrame(rows, DDL)
    table.append(make([(t, t, "a") for t in range(400)]))
    rows = str(tmp_path / "t" / "rows")
    before = files_below(rows)
    table.append(make([(t, t, "b") for t in range(400, 500)]))
    after = files_below(rows)
    assert before.items() <= after.items()  # rows after everything touch nothing
    table.append(make([(250, 10_000, "late")]))
    late = files_below(rows)
    assert len(after.items() - late.items()) == 1  # one folder was written anew
    # an append that did not end leaves the table as it was
    before = indexed(table)
    (tmp_path / "t" / "rows" / "3").mkdir()
    (tmp_path / "t" / "folders" / "3").mkdir()
    assert indexed(table) == before
    table.append(make([(1000, 1, "end")]))
    assert indexed(table) == [*before, (501, 1000, 1, "end")]


def message(seq, counts, floats, magic=MAGIC):
    return (magic, VERSION, seq, len(counts), len(floats), counts, floats)


def test_frames_round_trip_and_layout(spark, tmp_path):
    frames.register_frames(spark)
    path = str(tmp_path / "f")
    rng = np.random.default_rng(1)
    rows = [message(2**40 + i, [3, i % 4], [float(v) for v in rng.random(3 + i % 4).astype("f4")], magic=5 if i == 9 else MAGIC) for i in range(300)]
    rows += [message(1, [], []), message(2, [1], [float("nan")]), message(3, [0], [])]
    spark.createDataFrame(rows, frames.SCHEMA).repartition(3).write.format("frames").option("file_bytes", "4000").mode("append").save(path)
    found = spark.read.format("frames").load(path)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, spark.createDataFrame(rows, frames.SCHEMA).collect()))
    names = [n for n in os.listdir(path) if n.endswith(".frames")]
    assert len(names) > 3 and max(os.path.getsize(f"{path}/{n}") for n in names) < 4500  # files are begun anew
    raw = open(f"{path}/{names[0]}", "rb").read()
    assert frames.HEADER.size == 88 and int.from_bytes(raw[:4], "little") in (MAGIC, 5)
    bad = validate_messages(found.filter("seq > 1000000"), [3, 0], 4096).groupBy("reject_reason").count()
    reasons = {r["reject_reason"]: r["count"] for r in bad.collect()}
    assert reasons["magic"] == 1 and reasons["element count"] > 200


def test_failed_jobs_leave_no_frame(spark, tmp_path):
    frames.register_frames(spark)
    path = str(tmp_path / "f")
    good = [message(i, [1], [1.0]) for i in range(1, 40)]
    spark.createDataFrame(good, frames.SCHEMA).write.format("frames").mode("append").save(path)
    wrong = spark.createDataFrame(good[:20] + [message(99, [2], [1.0])], frames.SCHEMA).repartition(2)
    with pytest.raises(Exception):
        wrong.write.format("frames").mode("append").save(path)
    assert spark.read.format("frames").load(path).count() == 39
    with pytest.raises(Exception):
        spark.createDataFrame(good, frames.SCHEMA).write.format("frames").mode("overwrite").save(path)
    # a file that lost its end is an error, not fewer rows
    name = next(n for n in os.listdir(path) if n.endswith(".frames"))
    with open(f"{path}/{name}", "r+b") as f:
        f.truncate(os.path.getsize(f"{path}/{name}") - 2)
    with pytest.raises(Exception, match="ends inside"):
        spark.read.format("frames").load(path).count()


def test_a_batch_written_again_counts_once(tmp_path):
    sink = frames.FrameStreamWriter(str(tmp_path), 10**6)
    reader = frames.FrameStreamReader(str(tmp_path))
    assert reader.latestOffset() == reader.initialOffset() == {"commits": 0}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(frames.ARROW.names, message(1, [1], [2.0])))], schema=frames.ARROW)
    for batch_id in (0, 0, 1):
        sink.commit([sink.write(iter([batch])), None], batch_id)
    assert reader.latestOffset() == {"commits": 2}
    assert len(reader.partitions({"commits": 1}, {"commits": 2})) == 1
    assert len([n for n in os.listdir(tmp_path) if n.endswith(".frames")]) == 2
    sink.abort([sink.write(iter([batch]))], 2)
    assert len([n for n in os.listdir(tmp_path) if n.endswith(".frames")]) == 2
