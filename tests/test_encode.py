import math

import pytest
from pyspark.sql import functions as F

from flowspark.functions import categorical as C
from flowspark.functions.numeric import clean_numeric, log_minmax
from flowspark.operators import encode, prepare, stats
from flowspark.schemas import CategoricalParams, FittedParams, NumericParams
from flowspark.specs import NAMED_SPECS, NFV1

FRAME = [
    (10, 5, 100, 200, 100, 7000, 1900, 6, "TLS", 24), (20, 15, 200, 300, 200, 52990, 7007, 17, "SSDP", 0),
    (30, 25, 300, 400, 300, 58578, 42844, 6, "MQTT", 24), (15, 10, 150, 250, 150, 7000, 1900, 17, "TLS", 0),
    (25, 20, 250, 350, 250, 5353, 5353, 6, "MDNS", 24), (20, 15, 200, 300, 200, 52990, 7007, 17, "SSDP", 0),
    (30, 25, 300, 400, 300, 58578, 42844, 6, "MQTT", 24), (15, 10, 150, 250, 150, 7000, 1900, 17, "TLS", 0),
    (25, 20, 250, 350, 250, 5353, 5353, 6, "MDNS", 24),
]
SCALING = {
    "IN_PKTS": NumericParams(0, 335), "OUT_PKTS": NumericParams(1, 534), "IN_BYTES": NumericParams(0, 105056),
    "OUT_BYTES": NumericParams(60, 696118), "FLOW_DURATION_MILLISECONDS": NumericParams(0, 3483),
}
DDL = (
    "IN_PKTS BIGINT, OUT_PKTS BIGINT, IN_BYTES BIGINT, OUT_BYTES BIGINT, FLOW_DURATION_MILLISECONDS BIGINT, "
    "L4_SRC_PORT INT, L4_DST_PORT INT, PROTOCOL INT, L7_PROTO STRING, TCP_FLAGS INT"
)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(FRAME, DDL)


def values(spark, expr, column="DOUBLE", rows=()):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i INT, x {column}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scaling_of_the_worked_row(spark, frame):
    exprs = [log_minmax(F.col(f), p).alias(f) for f, p in SCALING.items()]
    r = frame.limit(1).select(*exprs).first()
    want = [0.412214, 0.256187, 0.399154, 0.367848, 0.565860]
    assert [round(v, 6) for v in r] == want


def test_scaling_edges(spark):
    p = NumericParams(5.0, 10.0)
    nan, inf = float("nan"), float("inf")
    got = values(spark, lambda x: log_minmax(x, p), rows=[5.0, 15.0, 4.0, 1.0, nan, inf, None, 100.0])
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12 and got[2] == got[3] == 0
    assert got[4] == got[5] == got[6] == 0  # treated as 0, which is below the minimum
    assert got[7] > 1
    assert values(spark, lambda x: log_minmax(x, p, clip=True), rows=[100.0]) == [1.0]
    raw = values(spark, lambda x: log_minmax(x, p, floor=False), rows=[3.0, 4.0, 5.0])
    assert math.isnan(raw[0]) and raw[1] == -inf and raw[2] == 0
    assert values(spark, lambda x: log_minmax(x, NumericParams(7, 0)), rows=[1.0, 7.0, 9.0]) == [0.0] * 3


def test_cleaning_keeps_the_bounds(spark):
    rows = [1e9, -1e9, 1.1e9, -1.1e9, float("nan"), float("inf"), float("-inf"), None, 3.5]
    assert values(spark, clean_numeric, rows=rows) == [1e9, -1e9, 0, 0, 0, 0, 0, 0, 3.5]


LEVELS = (7000, 52990, 58578, 55974, 59037, 5353)


@pytest.mark.parametrize("value,at", [(7000, 0), (52990, 1), (58578, 2), (55974, 3), (59037, 4), (5353, 5), (9999, None), (None, None)])
def test_worked_one_hot_examples(spark, value, at):
    df = spark.createDataFrame([(value,)], "x INT")
    code = C.level_code(F.col("x"), df.schema["x"].dataType, LEVELS)
    r = df.select(C.one_hot(code, 6).alias("v"), C.fit_width(C.one_hot(code, 6), 6, 8).alias("wide"),
                  C.fit_width(C.one_hot(code, 6), 6, 4).alias("cut"), C.one_hot_fitted(code, 6, 8).alias("fitted"),
                  C.one_hot_fitted(code, 6, 4).alias("fitted_cut")).first()
    want = [1.0 if i == at else 0.0 for i in range(6)]
    assert r["v"] == want
    assert r["wide"] == r["fitted"] == want + [1.0 if at is None else 0.0, 0.0]
    assert r["cut"] == r["fitted_cut"] == want[:4]


def test_unknown_variants_and_level_kinds(spark):
    df = spark.createDataFrame([(1, "6"), (9, "7")], "n INT, s STRING")
    n, s = df.schema["n"].dataType, df.schema["s"].dataType

    def code(col, dtype, levels, unknown=C.UNKNOWN_ZERO):
        return [r[0] for r in df.orderBy("n").select(C.level_code(F.col(col), dtype, levels, unknown)).collect()]

    assert code("n", n, (5, 1)) == [2, 0]
    assert code("n", n, (5, 1), C.UNKNOWN_FIRST) == [2, 1]
    assert code("s", s, (6, 7)) == [0, 0]  # text never equals a number
    assert code("s", s, ("6", "x")) == [1, 0]
    assert code("n", n, ()) == [0, 0]


def test_fit_orders_levels_by_count_then_value(spark):
    rows = [(10, "b"), (9, "b"), (9, "a"), (10, "a"), (2, "c"), (None, None)]
    df = spark.createDataFrame(rows, "p INT, s STRING")
    got = {}
    for r in stats.fit_categorical(df, ["p", "s"], 2).orderBy("feature", "rank").collect():
        got.setdefault(r["feature"], []).append(r["level"])
    assert got == {"p": ["9", "10"], "s": ["a", "b"]}  # 9 before 10: numbers sort as numbers
    capped = stats.fit_categorical(df, ["p", "s"], 1, caps={"s": 3})
    assert {(r["feature"], r["n"]) for r in capped.groupBy("feature").agg(F.count("*").alias("n")).collect()} == {("p", 1), ("s", 3)}


def test_params_round_trip(spark, frame):
    params = stats.collect_params(frame, NFV1, top_k=3)
    assert params.categorical["PROTOCOL"] == CategoricalParams((6, 17), 2)
    assert params.categorical["L7_PROTO"].levels == ("TLS", "MDNS", "MQTT")
    assert FittedParams.from_json(params.to_json()).categorical == params.categorical
    back = FittedParams.from_rows(params.to_df(spark).collect(), top_k=3)
    assert back.categorical == params.categorical and back.numerical == params.numerical
    wide = params.with_dims({"PROTOCOL": 5, "L7_PROTO": 1})
    assert wide.categorical["PROTOCOL"] == CategoricalParams((6, 17), 5)
    assert wide.categorical["L7_PROTO"] == CategoricalParams(("TLS",), 1)
    assert params.check_widths({"PROTOCOL": 5}, allow_mismatch=True) == [("PROTOCOL", 2, 5)]
    with pytest.raises(ValueError):
        params.check_widths({"PROTOCOL": 5})
    with pytest.raises(ValueError):
        params.with_dims({"nope": 3})


def test_preprocess_table_names(spark, frame):
    params = stats.collect_params(frame, NFV1)
    df = frame.withColumn("other", F.lit(1))
    kept = encode.preprocess_table(df, params).columns
    assert "other" in kept and "IN_PKTS" in kept and "IN_PKTS_preprocessed" in kept and "PROTOCOL_onehot_1" in kept
    only = encode.preprocess_table(df, params, keep_other=False).columns
    assert "other" not in only and "IN_PKTS" not in only and len(only) == 5 + sum(p.n_levels for p in params.categorical.values())
    dropped = encode.preprocess_table(df, params, drop_original=True)
    assert "IN_PKTS" in dropped.columns and "PROTOCOL" not in dropped.columns and "PROTOCOL_0" in dropped.columns
    assert dropped.schema["IN_PKTS"].dataType.simpleString() == "float"
    with pytest.raises(ValueError, match="missing columns"):
        encode.preprocess_table(df.drop("PROTOCOL"), params)


def test_many_levels_go_through_a_join(spark, monkeypatch, frame):
    params = stats.collect_params(frame, NFV1)
    want = sorted(map(tuple, encode.encode_codes(frame, params).collect()))
    monkeypatch.setattr(encode, "MAX_INLINE_LEVELS", 1)
    assert sorted(map(tuple, encode.encode_codes(frame, params).collect())) == want


def test_one_hot_rows_sum_to_zero_or_one(spark, frame):
    params = stats.collect_params(frame, NFV1, top_k=2)
    vec = encode.encode_vectors(frame, params)
    for f in NFV1.categorical:
        sums = {sum(r[0]) for r in vec.select(f).collect()}
        assert sums <= {0.0, 1.0}


def test_specs():
    sizes = {n: (len(s.include_fields), len(s.categorical), len(s.numerical)) for n, s in NAMED_SPECS.items()}
    assert sizes["cse_cic_ids_2018"] == sizes["unified_flow_format"] == (37, 9, 28)
    assert sizes["cse_cic_ids_2018_improved"] == (84, 11, 73)
    assert sizes["mqtt"] == (29, 3, 26) and sizes["nsl_kdd"] == (41, 7, 34)
    assert sizes["cse_cic_ids_2017"] == (78, 7, 71)
    assert sizes["CICFlowMeter_flow_format"] == (77, 12, 64)  # the class is listed among the fields
    assert NAMED_SPECS["nsl_kdd"].test_column == "is_test" and NAMED_SPECS["mqtt"].benign_label == "1"


def test_spec_with_dotted_and_spaced_columns(spark):
    spec = NAMED_SPECS["cse_cic_ids_2017"]
    names = [*spec.include_fields, spec.class_column]
    row = tuple(float(i) for i in range(len(names) - 1)) + ("BENIGN",)
    ddl = ", ".join(f"`{n}` {'STRING' if n == 'Label' else 'DOUBLE'}" for n in names)
    df = spark.createDataFrame([row, row], ddl)
    assert prepare.project_spec(df, spec).columns == [*spec.features, "Label"]
    params = stats.collect_params(df, spec)
    out = encode.encode_codes(df, params).first()
    assert out["Fwd Header Length.1"] == 0.0 and out["Destination Port"] == 1


def test_fill_missing_adds_absent_columns(spark):
    params = FittedParams({"a": NumericParams(0, 1)}, {"b": CategoricalParams(("x", "y"), 2), "c": CategoricalParams((), 0)})
    out = prepare.fill_missing(spark.createDataFrame([(1,)], "k INT"), params).first()
    assert (out["a"], out["b"], out["c"]) == (0.0, "x", 0)


def test_address_label_overwrites_and_needs_the_column(spark):
    df = spark.createDataFrame([("1.1.1.1", "old"), (None, "old")], "IPV4_SRC_ADDR STRING, Attack STRING")
    got = [r["Attack"] for r in prepare.label_by_address(df, "1.1.1.1", "Dos").collect()]
    assert got == ["Dos", "Benign"]
    with pytest.raises(ValueError):
        prepare.label_by_address(df, "x", "Dos", address_column="nope")


@pytest.mark.parametrize("width, first_code, max_code", [(6, 1, None), (6, 0, None), (4, 1, 6), (3, 0, 9), (1, 1, 7)])
def test_vectors_from_the_table_equal_slices(spark, monkeypatch, width, first_code, max_code):
    last = max(width + first_code - 1, max_code or 0)
    codes = spark.range(last + 1).select(F.col("id").cast("int").alias("c"))

    def vectors(dtype):
        found = codes.select("c", C.one_hot(F.col("c"), width, first_code, max_code, dtype).alias("v"))
        return {r["c"]: r["v"] for r in found.collect()}

    want = {c: [float(p + first_code == c) for p in range(width)] for c in range(last + 1)}
    assert vectors("float") == vectors("double") == want
    # the vectors are elements of one constant, not copies cut out per row
    assert "slice(" not in codes.select(C.one_hot(F.col("c"), width, first_code, max_code))._jdf.queryExecution().toString()
    monkeypatch.setattr(C, "TABLE_ENTRIES", 0)
    assert vectors("float") == vectors("double") == want
