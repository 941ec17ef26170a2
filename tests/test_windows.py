import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import windows as Wn
from flowspark.operators.order import index_rows
from flowspark.schemas import CategoricalParams, FittedParams, NumericParams


def indexed(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 10).alias("x"))


@pytest.mark.parametrize("n,window,chunk", [(50, 8, 16), (50, 8, 8), (7, 8, 16), (8, 8, 4096), (33, 1, 5), (40, 5, 7)])
def test_sliding_windows_equal_slices(spark, n, window, chunk):
    out = Wn.sliding_windows(indexed(spark, n), ["x"], window, chunk=chunk)
    got = {r["idx"]: [v["x"] for v in r["win"]] for r in out.collect()}
    assert got == {i: [10 * j for j in range(i - window + 1, i + 1)] for i in range(window - 1, n)}


def test_window_longer_than_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        Wn.sliding_windows(indexed(spark, 10), ["x"], 8, chunk=4)


def test_keyed_windows_with_hot_key_and_null_key(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id BIGINT, key STRING")
    ix = Wn.keyed_index(df, "key", ["id"])
    out = Wn.sliding_windows(ix, ["id"], 4, keep=["key", "id"], key="key", chunk=16)
    got = {r["id"]: [v["id"] for v in r["win"]] for r in out.collect()}
    want = {}
    for key in {k for _, k in rows}:
        ids = [i for i, k in rows if k == key]
        for j in range(3, len(ids)):
            want[ids[j]] = ids[j - 3: j + 1]
    assert got == want


@pytest.mark.parametrize("n,window,stride", [(30, 8, 8), (30, 8, 3), (30, 4, 6), (7, 8, 8), (16, 8, 1)])
def test_strided_windows(spark, n, window, stride):
    out = Wn.strided_windows(indexed(spark, n), ["x"], window, stride)
    got = {r["start_idx"]: [v["x"] for v in r["win"]] for r in out.collect()}
    assert got == {s: [10 * (s + j) for j in range(window)] for s in range(0, n - window + 1, stride)}


def test_nine_rows_two_sliding_one_strided(spark):
    df = indexed(spark, 9)
    assert Wn.sliding_windows(df, ["x"], 8).count() == 2
    assert Wn.strided_windows(df, ["x"], 8).count() == 1


def test_edge_window_pads_after_the_data_and_repeats(spark):
    out = Wn.edge_window(indexed(spark, 3), ["x"], 5, batch=2).collect()
    assert [[v["x"] for v in r["win"]] for r in out] == [[0, 10, 20, 0, 0]] * 2
    last = Wn.edge_window(indexed(spark, 9), ["x"], 4).first()
    first = Wn.edge_window(indexed(spark, 9), ["x"], 4, from_end=False).first()
    assert [v["x"] for v in last["win"]] == [50, 60, 70, 80]
    assert [v["x"] for v in first["win"]] == [0, 10, 20, 30]
    with pytest.raises(ValueError):
        Wn.edge_window(indexed(spark, 3), ["x"], 5, strict=True)


PARAMS = FittedParams(
    {"n": NumericParams(0.0, 10.0)}, {"c": CategoricalParams(("a", "b"), 2)}, window_size=3
)


def coded(spark, codes):
    return spark.createDataFrame([(i, float(i) / 10, c) for i, c in enumerate(codes)], "idx BIGINT, n DOUBLE, c INT")


def test_model_inputs_order_width_and_unknown_flag(spark):
    win = Wn.sliding_windows(coded(spark, [1, 0, 2]), ["n", "c"], 3)
    out = Wn.model_inputs(win, PARAMS, ["input_c", "input_n"], {"c": 4})
    assert out.columns == ["input_c", "input_n"]
    r = out.first()
    assert r["input_c"] == [[1, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0]]
    assert [round(v[0], 6) for v in r["input_n"]] == [0.0, 0.1, 0.2]
    with pytest.raises(ValueError, match="missing"):
        Wn.model_inputs(win, PARAMS, ["input_zz"])


def test_padding_rows_carry_no_unknown_flag(spark):
    df = coded(spark, [1, 0])
    win = Wn.edge_window(df, ["n", "c"], 3).withColumn("n_valid", F.lit(2))
    r = Wn.model_inputs(win, PARAMS, ["input_c"], {"c": 3}, valid=F.col("n_valid")).first()
    assert r["input_c"] == [[1, 0, 0], [0, 0, 1], [0, 0, 0]]


def test_record_vectors_and_pooling(spark):
    win = Wn.sliding_windows(coded(spark, [1, 0, 2]), ["n", "c"], 3)
    v = win.select(F.transform("win", lambda s: Wn.record_vector(s, PARAMS)).alias("v"))
    r = v.select(*[Wn.pool_window(F.col("v"), how, 3, 3).alias(how) for how in ("last", "flatten", "mean")]).first()
    assert [round(x, 6) for x in r["last"]] == [0.2, 0.0, 1.0]
    assert len(r["flatten"]) == 9
    assert [round(x, 6) for x in r["mean"]] == [0.1, 0.333333, 0.333333]
    with pytest.raises(ValueError):
        Wn.pool_window(F.col("v"), "max", 3, 3)


def test_random_context_draws_without_replacement_in_a_batch(spark):
    rows = spark.range(400).select(F.col("id").alias("idx"), F.col("id").alias("x"))
    targets = index_rows(rows.filter("idx >= 350"), ["idx"], "ordinal").select("ordinal", "idx")
    context = index_rows(rows.filter("idx < 350"), ["idx"], "pos").select("pos", "idx")
    out = Wn.random_context_windows(targets, context, rows, ["x"], 350, 8, 25, 5).collect()
    assert len(out) == 50
    for lo in (350, 375):
        batch = [r for r in out if lo <= r["idx"] < lo + 25]
        drawn = [v["x"] for r in batch for v in r["win"][:-1]]
        assert len(drawn) == 175 == len(set(drawn)) and max(drawn) < 350
        assert all(r["win"][-1]["x"] == r["idx"] for r in batch)
    with pytest.raises(ValueError):
        Wn.random_context_windows(targets, context, rows, ["x"], 350, 8, 64, 5)


def test_windows_at_few_rows_leave_the_table_where_it_is(spark):
    table = spark.range(10_000).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("x"), (F.col("id") % 3).alias("y"))
    targets = spark.createDataFrame([(3,), (7,), (8,), (8,), (4096,), (4100,), (9999,), (10_500,)], "idx bigint")
    few = Wn.windows_at(table, targets, ["x"], 8, keep=["y"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    # the picked rows are grouped; the table meets them by a broadcast
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(_chunk" not in plan
    many = Wn.windows_at(table, targets, ["x"], 8, keep=["y"], max_rows=0)
    rows = sorted(map(repr, few.collect()))
    assert rows == sorted(map(repr, many.collect())) and len(rows) == 5 and few.columns == ["idx", "y", "win"]


def test_record_vectors_are_copied_part_by_part(spark):
    win = Wn.sliding_windows(coded(spark, [1, 2, 0]), ["n", "c"], 3)
    v = win.select(F.transform("win", lambda s: Wn.record_vector(s, PARAMS)).alias("v"))
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" not in plan and "slice(" not in plan
    assert v.schema["v"].dataType.simpleString() == "array<array<double>>"
