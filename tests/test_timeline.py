"""As-of join, neighbours, frames and interval join against plain Python, with keys that span many parts."""

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.intervals import interval_join
from flowspark.operators.timeline import asof_join, range_frames, with_neighbour_times

HOT = ["hot"] * 5 + ["a", "b", None]


def at(spark, rows, names, types):
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict, tolerance", [(False, None), (True, None), (False, 3.0), (True, 2.0)])
def test_asof_join_equals_a_scan(spark, strict, tolerance):
    rng = random.Random(1)
    time = lambda: rng.choice([None, *range(40)])
    left = [(k, rng.choice(HOT), time()) for k in range(300)] + [(1, "hot", 7), (1, "hot", 7)]
    right = [(rng.choice(HOT + ["c"]), time(), rng.choice(["x", None, "z"]), k) for k in range(60)]
    got = asof_join(
        at(spark, left, ["id", "host", "t"], ["int", "string", "int"]),
        at(spark, right, ["host", "since", "label", "n"], ["string", "int", "string", "int"]),
        "host", "t", "since", ["label", "n"], ["n"], strict, tolerance, partitions=7,
    )
    assert got.columns == ["id", "host", "t", "label", "n"]

    def newest(host, t):
        ok = [
            r for r in right if host is not None and r[0] == host and t is not None and r[1] is not None
            and (r[1] < t if strict else r[1] <= t)
        ]
        r = max(ok, key=lambda r: (r[1], r[3]), default=None)
        return (None, None) if r is None or tolerance is not None and t - r[1] > tolerance else r[2:]

    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((*x, *newest(x[1], x[2])) for x in left), key=repr)


def test_asof_join_of_empty_sides_and_clashes(spark):
    left = at(spark, [(1, "a", 5)], ["id", "k", "t"], ["int", "string", "int"])
    right = at(spark, [("a", 1, 9)], ["k", "t", "v"], ["string", "int", "int"])
    assert [tuple(r) for r in asof_join(left, right.limit(0), "k", "t").collect()] == [(1, "a", 5, None)]
    assert asof_join(left.limit(0), right, "k", "t").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left, right.withColumnRenamed("v", "id"), "k", "t")


def test_a_hot_key_of_the_asof_join_spans_tasks(spark):
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), "id")
    right = spark.range(200).select(F.lit("hot").alias("k"), (F.col("id") * 100).alias("t"), F.col("id").alias("v"))
    got = asof_join(left, right, "k", "t", partitions=8)
    assert got.filter(F.col("v") != F.floor(F.col("t") / 100)).count() == 0 and got.count() == 20_000
    # rows meet by part and by range; nothing is joined or windowed by the key
    plan = plans(got)
    assert "hashpartitioning(_part" in plan and "hashpartitioning(_key" not in plan and "SortMergeJoin" not in plan
    parts = {r[0] for r in spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).select("_part").distinct().collect()}
    assert len(parts) == 8


def test_neighbours_across_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(HOT), rng.choice([1, 2, None]), rng.randrange(50)) for _ in range(300)]
    df = at(spark, rows, ["k", "v", "us"], ["string", "int", "int"])
    got = with_neighbour_times(df, ["k", "v"], "us", partitions=9).collect()
    want = []
    for g in {r[:2] for r in rows}:
        times = sorted(r[2] for r in rows if r[:2] == g)
        want += [(*g, t, p, n) for p, t, n in zip([None, *times], times, [*times[1:], None])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("partitions", [1, 11])
def test_frames_equal_a_scan(spark, partitions):
    rng = random.Random(3)
    rows = [
        (k, rng.choice(HOT), rng.choice([None, *range(60)]), rng.choice([None, 1, 5, -2]), rng.choice([None, 80, 443, 53]))
        for k in range(400)
    ]
    df = at(spark, rows, ["id", "host", "t", "bytes", "port"], ["int", "string", "int", "bigint", "int"])
    got = range_frames(
        df, "host", "t", 6, {"n": F.lit(1), "total": F.col("bytes"), "cents": F.col("bytes").cast("decimal(10,2)") / 4},
        {"ports": "port"}, partitions,
    )
    assert got.columns == [*df.columns, "n", "total", "cents", "ports"]
    found = {r["id"]: (r["n"], r["total"], None if r["cents"] is None else float(r["cents"]), r["ports"]) for r in got.collect()}
    for i, host, t, _, _ in rows:
        if t is None:
            assert found[i] == (None,) * 4
            continue
        seen = [r for r in rows if r[1] == host and r[2] is not None and t - 6 <= r[2] <= t]
        total = sum(r[3] or 0 for r in seen)
        assert found[i] == (len(seen), total, total / 4, len({r[4] for r in seen} - {None})), i


def test_frames_refuse_what_would_not_cancel(spark):
    df = at(spark, [("a", 1, 0.5)], ["k", "t", "x"], ["string", "int", "double"])
    with pytest.raises(ValueError, match="whole numbers"):
        range_frames(df, "k", "t", 5, {"s": F.col("x")})
    with pytest.raises(ValueError, match="there already"):
        range_frames(df, "k", "t", 5, {"x": F.lit(1)})
    assert range_frames(df.limit(0), "k", "t", 5, {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("hot_rows", [100_000, 3])
@pytest.mark.parametrize("cell", [0.5, 8.0, 1000.0])
def test_interval_join_equals_all_pairs(spark, hot_rows, cell):
    rng = random.Random(4)

    def spans(n):
        out = []
        for k in range(n):
            a = rng.choice([None, *range(-20, 60)])
            b = None if a is None else a + rng.choice([0, 0, 1, 3, 10, 200, -1])
            out.append((k, rng.choice(HOT), rng.choice([1, 1, None]), a, b))
        return out

    left, right = spans(150), spans(60)
    got = interval_join(
        at(spark, left, ["id", "host", "net", "a", "b"], ["int", "string", "int", "int", "int"]),
        at(spark, right, ["pid", "host", "net", "begins", "ends"], ["int", "string", "int", "int", "int"]),
        ["host", "net"], ("a", "b"), ("begins", "ends"), cell, hot_rows,
    )
    assert got.columns == ["id", "host", "net", "a", "b", "pid", "begins", "ends"]
    fine = lambda r: None not in r and r[3] <= r[4]
    want = [
        (*x, y[0], y[3], y[4]) for x in left for y in right
        if fine(x) and fine(y) and x[1:3] == y[1:3] and x[3] <= y[4] and y[3] <= x[4]
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_interval_join_has_no_cartesian_product_and_few_copies(spark):
    left = spark.range(2000).select("id", F.lit("h").alias("k"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    # one span of some weeks beside cells of a second
    right = spark.createDataFrame([(1, "h", 0, 3_000_000), (2, "h", 10, 11)], "pid int, k string, p int, q int")
    got = interval_join(left, right, ["k"], ("a", "b"), ("p", "q"), cell_s=1)
    plan = plans(got)
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert got.filter("pid = 1").count() == 2000 and got.filter("pid = 2").count() == 3
    assert interval_join(left, right.limit(0), ["k"], ("a", "b"), ("p", "q")).count() == 0
