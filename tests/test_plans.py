from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.catalog.preparation import raw_flows
from flowspark.flows import flows, packets
from flowspark.operators import assemble, encode, order, score, split, stats, windows
from flowspark.plans import dataset, training
from flowspark.specs import NAMED_SPECS, NFV1

ORDER = ["ts", "flow_id"]


def test_prepare_dataset(spark, sf_dir):
    out, params = dataset.prepare_dataset(raw_flows(spark, sf_dir), "flow_id", "Dos_TCP_Flood", strategy="upsample")
    counts = {r["Attack"]: r["count"] for r in out.groupBy("Attack").count().collect()}
    assert len(set(counts.values())) == 1 and set(counts) == {"Benign", "Dos_TCP_Flood"}
    assert params.categorical["PROTOCOL"].n_levels == 3 and "vlan_id" not in out.columns


@pytest.mark.parametrize("sampling", [training.LAST_ROWS, training.RANDOM_ROWS])
def test_load_dataset_fits_on_training_rows_only(spark, sf_dir, sampling):
    data = training.load_dataset(flows(spark, sf_dir), ORDER, sampling=sampling, n_rows=600, eval_percent=0.25)
    assert data.n_rows == 600 and data.table.count() == 600
    assert data.table.filter("NOT training").count() == 150
    limits = data.table.filter("training").agg(F.min("OUT_BYTES"), F.max("OUT_BYTES")).first()
    assert limits[0] == 0.0 and abs(limits[1] - 1.0) < 1e-9
    assert set(data.spec.classes) == {"Benign", "Dos_TCP_Flood", "Dos_UDP_flood"}
    assert data.spec.attack_classes == tuple(c for c in data.spec.classes if c != "Benign")


def test_integer_format_counts_codes(spark, sf_dir):
    data = training.load_dataset(
        flows(spark, sf_dir), ORDER, categorical_format="integers", prep=training.Preprocessing.as_in_training(4)
    )
    codes = {r[0] for r in data.table.select("L4_SRC_PORT").distinct().collect()}
    assert codes == {1, 2, 3, 4}  # unknown shares the first code
    assert dict(zip(data.spec.categorical_features, data.spec.levels_per_categorical))["L4_SRC_PORT"] == 4


def test_cached_load(spark, sf_dir, tmp_path):
    first = training.load_cached(spark, str(tmp_path), "events", flows(spark, sf_dir), ORDER, n_rows=300)
    again = training.load_cached(spark, str(tmp_path), "events", None, ORDER, n_rows=300)
    assert again.params.categorical == first.params.categorical and again.spec == first.spec
    assert again.table.count() == 300 and again.table.exceptAll(first.table).count() == 0


def test_single_flow_vectors_equal_windows_of_one(spark, sf_dir):
    data = training.load_dataset(flows(spark, sf_dir), ORDER)
    one = windows.sliding_windows(data.table, NFV1.features, 1)
    by_window = score.window_vectors(one, data.params, "last", keep=["idx"])
    by_flow = score.flow_vectors(data.table, data.params, keep=["idx"])
    assert by_window.exceptAll(by_flow).count() == 0 and by_window.count() == 1000
    assert len(by_flow.first()["features"]) == score.record_width(data.params)


def test_batch_scorer_sees_whole_windows(spark):
    df = spark.range(10).select(
        "id", F.array(*[F.array((F.col("id") + i).cast("float")) for i in range(3)]).alias("x")
    )

    def make():
        return lambda arrays: np.stack([arrays[0].sum(axis=(1, 2)), -arrays[0][:, 0, 0]], axis=1)

    got = {r["id"]: list(r["scores"]) for r in score.score_with(df, make, ["x"], ["id"]).collect()}
    assert got == {i: [3 * i + 3, -i] for i in range(10)}


def test_feature_statistics_of_arrays(spark):
    df = spark.createDataFrame([([[0.0], [2.0]],), ([[4.0], [6.0]],)], "x ARRAY<ARRAY<DOUBLE>>")
    r = stats.feature_statistics(df, ["x"]).first()
    assert (r["n_values"], r["min"], r["max"], r["mean"], r["non_zero"]) == (4, 0.0, 6.0, 3.0, 3)
    assert round(r["std"], 6) == round(5 ** 0.5, 6)


def test_load_dataset_with_a_test_column(spark, sf_dir):
    spec = replace(NFV1, test_column="is_test")
    f = flows(spark, sf_dir).withColumn("is_test", F.when(F.col("flow_id") % 5 == 0, "y").otherwise("n"))
    data = training.load_dataset(f, ORDER, spec, training.FILTER_COLUMN)
    assert "is_test" not in data.table.columns
    assert data.table.filter("NOT training").count() == len([i for i in range(1000) if i % 5 == 0 and i > 8])


def test_scoring_leaves_the_model_unchanged(spark, sf_dir):
    data = training.load_dataset(flows(spark, sf_dir), ORDER, n_rows=300)
    vectors = score.flow_vectors(data.table, data.params, keep=["idx", "Attack"])
    model = score.fit_binary_classifier(vectors, max_iter=3)
    out = score.score_positive(vectors, model)
    assert model.getFeaturesCol() == "features" and out.columns == ["idx", "Attack", "features", "score"]
    assert out.filter("score < 0 OR score > 1").count() == 0


# -- physical plans ------------------------------------------------------------------------------
def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_is_map_only_and_prunes_columns(spark, sf_dir):
    params = stats.collect_params(flows(spark, sf_dir), NFV1)
    plan = plan_of(encode.encode_vectors(flows(spark, sf_dir), params, keep=["flow_id"]))
    assert "Exchange" not in plan and "Python" not in plan and "transform(" not in plan
    narrow = plan_of(stats.fit_numeric(flows(spark, sf_dir), ["IN_BYTES"]))
    assert "ReadSchema: struct<value:double>" in narrow


def test_level_ranking_is_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(stats.fit_categorical(flows(spark, sf_dir), NFV1.categorical))
    assert plan.count("WindowGroupLimit") == 2 and "SinglePartition" not in plan


def test_windows_need_one_shuffle_by_chunk(spark, sf_dir):
    table = order.index_rows(flows(spark, sf_dir), ORDER)
    plan = plan_of(windows.sliding_windows(table, ["IN_PKTS"], 8))
    assert plan.count("Exchange hashpartitioning(_chunk") == 1 and "SinglePartition" not in plan
    assert "OUT_BYTES" not in plan


def test_sampling_and_positions_do_not_shuffle_or_cross_join(spark, sf_dir):
    f = flows(spark, sf_dir)
    down = plan_of(split.balance_down(f, "flow_id", "Dos_TCP_Flood"))
    assert "Exchange" not in down
    for df in (assemble.assemble_flows(packets(spark, sf_dir), 60), order.index_in_groups(f, ["Attack"], ORDER)):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan
        assert "SortAggregate" not in plan


def test_whole_path_with_unusual_column_names(spark):
    spec = NAMED_SPECS["cse_cic_ids_2017"]  # names with spaces, a dot and dashes
    rows = spark.range(80).withColumns({
        n: ((F.col("id") * (i + 3)) % 11).cast("double") for i, n in enumerate(spec.include_fields)
    }).withColumn("Label", F.when(F.col("id") % 3 == 0, "BENIGN").otherwise("DoS"))
    data = training.load_dataset(rows, ["id"], spec)
    sets = training.window_sets(data, "Label")
    assert sets.filter("role = 'train'").count() == 64 - 8 and sets.filter("role = 'eval'").count() == 16 - 8
    assert len(sets.first()["features"]) == 8 * score.record_width(data.params)
    inputs = windows.model_inputs(
        windows.sliding_windows(data.table, spec.features, 8), data.params, ["input_Fwd Header Length.1", "input_Destination Port"]
    )
    assert inputs.count() == 73


def test_ranges_do_not_grow_with_joins(spark, sf_dir):
    f = flows(spark, sf_dir)
    base = order.input_bytes(f)
    indexed = order.index_rows(f, ORDER)
    labelled = stats.encode_labels(indexed, "Attack")
    assert order.input_bytes(labelled) < 4 * order.input_bytes(indexed) + 100_000
    assert order.parts_for(labelled) == order.parts_for(f) and base < 10**7


def test_ordered_rows_are_released(spark, sf_dir):
    import os

    with order.order_rows(flows(spark, sf_dir), ORDER) as found:
        path = found.path.removeprefix("file:")
        assert os.path.exists(path) and found.n == 1000
    assert not os.path.exists(path)


def test_subset_positions_need_no_new_order(spark, monkeypatch):
    monkeypatch.setattr(order, "SUBSET_CHUNK", 7)
    df = spark.range(100).selectExpr("id AS idx", "IF(id % 3 = 0, 'a', IF(id % 10 = 1, NULL, 'b')) AS g")
    got = sorted((r["idx"], r["g"], r["pos"]) for r in order.subset_positions(df.filter("idx % 5 <> 2"), ["g"]).collect())
    seen, want = {}, []
    for i in range(100):
        if i % 5 != 2:
            g = "a" if i % 3 == 0 else None if i % 10 == 1 else "b"
            want.append((i, g, seen.get(g, 0)))
            seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_thresholds_are_refined_in_large_slivers(spark, monkeypatch):
    monkeypatch.setattr(order, "SLIVER_ROWS", 3)
    df = spark.range(500).toDF("i")
    wide = order.flag_first_by_hash(df, "i", 1, 77, prefix_digits=1).filter("picked")
    plain = order.flag_first_by_hash(df, "i", 1, 77).filter("picked")
    assert sorted(r["i"] for r in wide.collect()) == sorted(r["i"] for r in plain.collect()) and wide.count() == 77


def test_many_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(split, "COPIES_AT_ONCE", 4)
    df = spark.createDataFrame([(1, 11), (2, 4), (3, 0)], "i int, n int")
    out = split.repeat_rows(df, F.col("n"), 11, "i").groupBy("i").agg(F.sort_array(F.collect_list("copy")).alias("c"))
    assert {r["i"]: list(r["c"]) for r in out.collect()} == {1: list(range(1, 12)), 2: [1, 2, 3, 4]}


def test_verdict_fields_are_pruned(spark):
    from flowspark.functions.verdict import verdict

    df = spark.createDataFrame([([0.1, 0.9],)], "s array<double>")
    one = df.select(verdict(F.col("s"), ["Benign", "X"]).alias("v")).select("v.is_attack")
    all_ = df.select(verdict(F.col("s"), ["Benign", "X"]).alias("v"))
    count = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("array_max")
    assert count(one) < count(all_) / 3


# -- training ------------------------------------------------------------------------------------
def separable(spark, labels, n=400):
    """Flows whose bytes tell their class; labels alternate in blocks, so windows are pure at their end."""
    rows = []
    for i in range(n):
        k = (i // 20) % len(labels)
        rows.append((i, 5, 6, 10, 1, 10 + 1000 * k, 1, 5, "10.0.0.1", 1000 + k, "10.0.0.2", 80, 6, "X", 0, labels[k]))
    kind = "int" if isinstance([v for v in labels if v is not None][0], int) else "string"
    ddl = (
        "ts bigint, flow_id bigint, user_id bigint, FLOW_DURATION_MILLISECONDS bigint, OUT_PKTS bigint, OUT_BYTES bigint, IN_PKTS bigint, "
        "IN_BYTES bigint, IPV4_SRC_ADDR string, L4_SRC_PORT int, IPV4_DST_ADDR string, L4_DST_PORT int, PROTOCOL int, "
        f"L7_PROTO string, TCP_FLAGS int, Attack {kind}"
    )
    return spark.createDataFrame(rows, ddl)


def accuracy(report):
    return {r["class"]: r["precision"] for r in report.collect()}["accuracy"]


@pytest.mark.parametrize("labels,n_rows", [([2, 10], 0), (["Benign", "DoS"], 0), (["a", None, "b"], 0)])
def test_predicted_names_follow_the_codes(spark, labels, n_rows):
    spec = replace(NFV1, benign_label=str(labels[0]))
    data = training.load_dataset(separable(spark, labels), ["ts"], spec, sampling=training.RANDOM_ROWS, n_rows=n_rows)
    assert data.class_map == tuple(str(v) for v in sorted(v for v in labels if v is not None))
    assert "None" not in data.spec.classes
    _, report, judged = training.train_and_evaluate(data, pooling="last", hidden=(8,), max_iter=60, steps=8, batch=32)
    assert accuracy(report) > 0.9 and judged.filter("Attack IS NULL").count() == 0


def test_names_when_the_row_limit_cuts_a_class_off(spark):
    rows = separable(spark, ["z1", "z2"], 400)
    last = rows.limit(3).withColumn("ts", F.col("ts") + 10_000).withColumn("Attack", F.lit("Benign"))
    data = training.load_dataset(rows.unionByName(last), ["ts"], sampling=training.RANDOM_ROWS, n_rows=400)
    assert data.spec.classes == ("z1", "z2", "Benign") and data.class_map == ("z1", "z2")
    _, report, _ = training.train_and_evaluate(data, pooling="last", hidden=(8,), max_iter=60, steps=8, batch=32)
    assert accuracy(report) > 0.9


def test_training_batches_are_balanced_and_bounded(spark, sf_dir):
    data = training.load_dataset(flows(spark, sf_dir), ORDER)
    rows = training.training_batches(data, batch=30, steps=5, pooling="last").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in rows} == {0: 50, 1: 50, 2: 50}
