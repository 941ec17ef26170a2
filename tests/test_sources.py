import json

import pytest
from pyspark.sql import functions as F

from flowspark import settings
from flowspark.schemas import NFV1_SCHEMA, ModelInputSpec
from flowspark.sources import cache, readers, tensors, writers
from flowspark.specs import NFV1

HEADER = [p.split()[0] for p in NFV1_SCHEMA.split(", ")]


def record(i, label="Benign"):
    return ("10.0.0.1", i, "fe80::1", 80, 6, 0, 1, 60, 0, 0, "HTTP", 0, label)


def records(spark, n=10, label="Benign"):
    return spark.createDataFrame([record(i, label) for i in range(n)], NFV1_SCHEMA)


def test_csv_round_trip_and_row_limit_in_file_order(spark, tmp_path):
    path = str(tmp_path / "new" / "flows")  # folders are created
    writers.write_csv(records(spark, 50).coalesce(1), path)
    back = readers.read_flows(spark, path)
    assert back.columns == HEADER and back.count() == 50
    first = readers.read_flows(spark, path, n_rows=7)
    assert sorted(r["L4_SRC_PORT"] for r in first.collect()) == list(range(7))


def test_rotation(spark, tmp_path):
    path = tmp_path / "rot"
    writers.write_csv(records(spark, 25).coalesce(1), str(path), rows_per_file=10)
    assert len(list(path.glob("*.csv"))) == 3


def test_glob_merge_keeps_name_order(spark, tmp_path):
    for name, label in (("converted_b.csv", "B"), ("converted_a.csv", "A"), ("other.csv", "C")):
        lines = [",".join(HEADER)] + [",".join(map(str, record(i, label))) for i in range(3)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = readers.read_glob(spark, str(tmp_path / "converted*.csv")).orderBy(*readers.FILE_ORDER).collect()
    assert [(r["Attack"], r["L4_SRC_PORT"]) for r in got] == [(x, i) for x in "AB" for i in range(3)]
    with pytest.raises(FileNotFoundError):
        readers.read_glob(spark, str(tmp_path / "nothing*.csv"))


def test_labelled_files_skip_missing_and_broken(spark, tmp_path):
    good, broken = str(tmp_path / "good"), tmp_path / "broken.parquet"
    records(spark, 4, "old").write.parquet(good)
    broken.write_text("not a parquet file")
    out = readers.read_labelled(spark, [(good, "New"), (str(tmp_path / "none"), "X"), (str(broken), "Y")])
    assert {r["Attack"]: r["count"] for r in out.groupBy("Attack").count().collect()} == {"New": 4}
    with pytest.raises(ValueError):
        readers.read_labelled(spark, [(str(tmp_path / "none"), "X")])


def test_column_reader(spark, tmp_path):
    path = str(tmp_path / "flows.parquet")
    records(spark).write.parquet(path)
    df = readers.read_columns(spark, path, NFV1)
    assert df.columns == [*NFV1.include_fields, "Attack"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IPV4_SRC_ADDR" not in plan
    with pytest.raises(ValueError):
        readers.read_columns(spark, "x.txt", NFV1)


def test_cache_key_and_reuse(spark, tmp_path):
    a, b = cache.identifier({"x": 1, "y": 2}), cache.identifier({"y": 2, "x": 1})
    assert a == b and a != cache.identifier({"x": 1, "y": 3}) and a.isalnum() and len(a) == 40
    assert cache.cache_key("d", 5, {}, {}).startswith("d_5_")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).toDF("v"), 'two\nlines "quoted"'

    for _ in range(2):
        df, text = cache.cached(spark, str(tmp_path), "k", build)
        assert df.count() == 3 and text == 'two\nlines "quoted"'
    assert len(calls) == 1


def test_incomplete_cache_entry_is_rebuilt(spark, tmp_path):
    spark.range(9).toDF("v").write.parquet(str(tmp_path / "k"))  # data without metadata
    df, text = cache.cached(spark, str(tmp_path), "k", lambda: (spark.range(2).toDF("v"), "m"))
    assert df.count() == 2 and text == "m"


def message(spark, **kw):
    row = {"magic": tensors.MAGIC, "version": 1, "seq": 5, "n_inputs": 2, "total_floats": 3, "elem_counts": [1, 2], "payload": [1.0, 2.0, 3.0], **kw}
    ddl = "magic INT, version INT, seq BIGINT, n_inputs INT, total_floats INT, elem_counts ARRAY<INT>, payload ARRAY<FLOAT>"
    return spark.createDataFrame([tuple(row.values())], ddl)


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"magic": 1}, "magic"), ({"version": 2}, "version"), ({"seq": 0}, "sequence"), ({"seq": 9}, "sequence"),
    ({"seq": 3}, None), ({"n_inputs": 1}, "input count"), ({"elem_counts": [2, 1]}, "element count"), ({"total_floats": 4}, "total"),
])
def test_message_validation(spark, change, reason):
    r = tensors.validate_messages(message(spark, **change), [1, 2], 1000, last_seq=9).first()
    assert r["reject_reason"] == reason


def test_message_size_bound(spark):
    assert tensors.validate_messages(message(spark), [1, 2], 99).first()["reject_reason"] == "size"
    assert tensors.validate_messages(message(spark), [1, 2], 100).first()["reject_reason"] is None
    df = spark.createDataFrame([([[1.0], [2.0]], [3.0])], "a ARRAY<ARRAY<FLOAT>>, b ARRAY<FLOAT>")
    got = tensors.tensor_messages(df, ["b", "a"], F.lit(1)).first()
    assert list(got["payload"]) == [3.0, 1.0, 2.0] and list(got["elem_counts"]) == [1, 2]
    with pytest.raises(ValueError):
        tensors.tensor_messages(df, ["a"] * 17, F.lit(1))
    with pytest.raises(Exception, match="too large"):
        tensors.tensor_messages(df, ["a"], F.lit(1), max_bytes=90).collect()


def test_differing_duplicates_collapse_alike(spark):
    two = message(spark).unionByName(message(spark, payload=[9.0, 2.0, 3.0]))
    for rows in (two, two.orderBy("payload", ascending=False).coalesce(1)):
        kept = tensors.accepted_messages(tensors.validate_messages(rows, [1, 2], 1000)).collect()
        assert len(kept) == 1 and list(kept[0]["payload"]) == [1.0, 2.0, 3.0]


def test_metadata_on_a_hadoop_path(spark, tmp_path):
    path = f"file://{tmp_path}/model.meta.json"
    settings.write_metadata(path, ["input_a"], {"b": 4}, ["Benign", "X"])
    assert settings.load_metadata(f"file://{tmp_path}/model.onnx").class_labels == ("Benign", "X")
    assert settings.load_class_info(path).benign_class_index == 0
    with pytest.raises(FileNotFoundError):
        settings.load_class_info(f"file://{tmp_path}/none.json")


def test_damage_anywhere_in_a_file_skips_the_file(spark, tmp_path):
    good, bad = str(tmp_path / "a b+c"), tmp_path / "bad"
    records(spark, 6).write.parquet(good)
    records(spark, 5).coalesce(1).write.parquet(str(bad))
    part = next(bad.glob("*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2 :] = b"x" * (len(raw) - len(raw) // 2)
    part.write_bytes(bytes(raw))
    out = readers.read_labelled(spark, [(str(bad), "Bad"), (good, "Good")])
    assert {r["Attack"]: r["count"] for r in out.groupBy("Attack").count().collect()} == {"Good": 6}


def test_first_rows_read_only_the_first_files(spark, tmp_path):
    path = str(tmp_path / "flows")
    records(spark, 40).repartitionByRange(8, "L4_SRC_PORT").sortWithinPartitions("L4_SRC_PORT").write.csv(path, header=True)
    df = spark.read.schema(NFV1_SCHEMA).csv(path, header=True)
    assert len(readers._first_files(spark, df, NFV1_SCHEMA, 3)) < len(df.inputFiles())
    got = readers.read_flows(spark, path, n_rows=7).collect()
    assert sorted(r["L4_SRC_PORT"] for r in got) == list(range(7))


def test_scratch_scope(spark):
    from flowspark.session import materialize, path_exists, scratch_path, scratch_scope

    with scratch_scope(spark):
        inside = scratch_path(spark, "t")
        materialize(spark.range(3).toDF("v"), "t", inside)
        assert path_exists(spark, inside)
    assert not path_exists(spark, inside)


def test_class_labels_and_metadata(tmp_path):
    assert settings.class_labels_of({"class_map": {"2": "c", "0": "a", "x": "?", "1": "b"}}) == ["a", "b", "c"]
    assert settings.class_labels_of({"label_encoder_classes": [1, 2]}) == ["1", "2"]
    assert settings.class_labels_of({}) == []
    model = tmp_path / "m.onnx"
    assert settings.load_metadata(str(model)) is None
    (tmp_path / "m.json").write_text(json.dumps({"input_names": ["a", "", 3], "model_expected_dims": {"p": "4", "q": 0, "r": "x"}}))
    (tmp_path / "m.meta.json").write_text("{broken")
    meta = settings.load_metadata(str(model))
    assert meta.path.endswith("m.json") and meta.input_names == ("a",) and meta.dims == {"p": 4}
    given = tmp_path / "given.json"
    given.write_text(json.dumps({"class_labels": ["Benign", "X"], "benign_class_index": "0"}))
    meta = settings.load_metadata(str(model), str(given))
    assert meta.class_labels == ("Benign", "X") and meta.benign_class_index == 0


def test_settings_precedence(tmp_path):
    meta = settings.ModelMetadata(class_labels=("a", "b"), benign_label="a", benign_class_index=0)
    info = settings.ModelMetadata(class_labels=("c", "d"), benign_class_index=1)
    s = settings.resolve_verdict_settings(meta, info, threshold=7)
    assert (s.labels, s.benign_label, s.benign_class_index, s.threshold) == (["c", "d"], "a", 1, 1.0)
    s = settings.resolve_verdict_settings(meta, info, benign_label="z", benign_class_index=5)
    assert (s.benign_label, s.benign_class_index) == ("z", 5)
    assert settings.resolve_verdict_settings().benign_label == "Benign"
    with pytest.raises(FileNotFoundError):
        settings.load_class_info(str(tmp_path / "none.json"))
    path = str(tmp_path / "out.meta.json")
    settings.write_metadata(path, ["input_a"], {"a": 1, "b": 4}, ["Benign", "X"])
    back = settings.load_metadata(str(tmp_path / "out.onnx"))
    assert back.dims == {"b": 4} and back.class_labels == ("Benign", "X") and back.benign_class_index == 0


def test_input_spec_round_trip():
    spec = ModelInputSpec(("n", "c"), 1, (4,), "onehot", ("Benign", "X"), ("X",))
    assert ModelInputSpec.from_json(spec.to_json()) == spec and spec.categorical_features == ("c",)


def test_conditions_on_messages_do_not_make_them_again(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "n long, x array<double>")
    made = tensors.tensor_messages(df, ["x"], F.col("n"), max_bytes=1000)
    checked = tensors.validate_messages(made, [2], 1000)
    good = tensors.accepted_messages(checked.unionByName(checked))
    assert sorted((r["seq"], r["elem_counts"], r["payload"]) for r in good.collect()) == [(1, [2], [1.0, 2.0]), (2, [2], [3.0, 4.0])]
    plan = checked.filter("reject_reason IS NULL").select("seq")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("x#" in line for line in filters)


def test_payload_texts_equal_those_made_number_by_number(spark):
    from flowspark.catalog.files import payload_text

    def vectors(*places):
        return [float(p == at) for dim, at in zip((1, 1, 3, 3), places) for p in range(1, dim + 1)]

    scaled = [0.0, 0.5, 0.0005, 0.0125, 0.4995, 0.99949, 1e-30, 2.5, 1234.5678, 9.9e8]
    hot = [vectors(a, b, c, d) for a in (0, 1) for b in (0, 1) for c in range(4) for d in range(4)]
    payloads = [[x, y, *hot[(7 * i + j) % 64]] for i, x in enumerate(scaled) for j, y in enumerate(scaled)]
    payloads += [[0.25, 0.5, *v] for v in hot]
    payloads += [[x, 0.5, *hot[27]] for x in (-0.0005, -2.5, 1e9, 3e12, None)]
    # entries that are not 0 or 1, more than one 1 in a vector, nulls, other lengths
    for at in range(8):
        payloads += [[0.25, 0.5, *hot[27][:at], v, *hot[27][at + 1:]] for v in (-0.0, 0.0, 1.0, 2.0, -1.0, 0.0005, 0.9999, None)]
    payloads += [[0.25, 0.5, *[1.0] * 8], [0.25, 0.5, *hot[27], 0.0], [0.25, 0.5, *hot[27][:-1]], [0.5], [None, None], [None] * 10, [], None]
    df = spark.createDataFrame(list(enumerate(payloads)), "seq long, payload array<float>")
    single = F.array_join(F.transform("payload", lambda v: F.round(v.cast("double") * 1000).cast("bigint").cast("string")), ",")
    want = {r["seq"]: r["t"] for r in df.select("seq", single.alias("t")).collect()}
    out = payload_text(df, 2, 2, [1, 3])
    got = {r["seq"]: r["payload"] for r in out.collect()}
    assert got == want and len(got) == len(payloads) and out.columns == ["seq", "payload"]


def test_tensor_messages_do_not_write_one_hot_entries_one_by_one(spark, tmp_path):
    import __spark_entry__ as entry_point

    rows = [(i, i % 7, "abc"[i % 3], 1.5 * (i % 40), f'{{"k": {i % 90}}}') for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events = events.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000))
    events.write.parquet(f"{tmp_path}/events.parquet")
    out = entry_point.queries()["s9_tensor_messages"](spark, str(tmp_path))
    found = {r["seq"]: r["payload"].split(",") for r in out.collect()}
    assert sorted(found) == list(range(1, 54)) and {len(v) for v in found.values()} == {8 * (5 + 102)}
    assert all(set(v[40:]) == {"0", "1000"} for v in found.values())
    # a text per vector, looked up by the place of its 1, each found once
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(_bits") + plan.count("array_position(slice(_bits") == 8 * 5
