"""Row index and windows of consecutive flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import (
    FLOWS, INDEXED, ORDER, WINDOW, encoded_sql, indexed_flows, micros, params_sql, query,
)
from flowspark.catalog.encoding import DIMS, WIDTHS, fitted_code_sql
from flowspark.catalog.splits import ROLES, multiclass_roles, number_sql
from flowspark.flows import flows
from flowspark.functions.numeric import int_div
from flowspark.operators import encode, score, stats, windows
from flowspark.operators.order import index_in_groups, subset_positions
from flowspark.specs import NFV1

COLS = ["flow_id", "OUT_BYTES", "L7_PROTO"]


def members(df, *keep):
    """One row per window member, for comparison."""
    return df.select(*keep, F.posexplode("win").alias("pos", "m")).select(
        *keep, "pos", *[F.col(f"m.{c}").alias(c) for c in COLS]
    )


def members_sql(ends: str, length: int = WINDOW, source: str = INDEXED) -> str:
    return (
        f"WITH i AS ({source}), e AS ({ends}) SELECT e.*, CAST(j AS INT) AS pos, r.flow_id, r.OUT_BYTES, r.L7_PROTO FROM e, "
        f"generate_series(0, {length - 1}) g(j) JOIN i r ON r.idx = e.idx - {length - 1} + j"
    )


@query("w0_row_index", f"SELECT flow_id, idx FROM ({INDEXED}) q")
def _row_index(spark, sf_dir):
    return indexed_flows(spark, sf_dir).select("flow_id", "idx")


@query(
    "w0_row_index_in_groups",
    f"SELECT flow_id, Attack, row_number() OVER (PARTITION BY Attack ORDER BY ts, flow_id) - 1 AS pos FROM ({FLOWS}) q",
)
def _row_index_in_groups(spark, sf_dir):
    return index_in_groups(flows(spark, sf_dir), ["Attack"], ORDER).select("flow_id", "Attack", "pos")


@query("w1_sliding_windows", members_sql(f"SELECT idx, Attack AS label FROM i WHERE idx >= {WINDOW - 1}"))
def _sliding_windows(spark, sf_dir):
    rows = indexed_flows(spark, sf_dir).withColumnRenamed("Attack", "label")
    return members(windows.sliding_windows(rows, COLS, WINDOW, keep=["label"]), "idx", "label")


KEYED = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, flow_id) - 1 AS idx FROM ({FLOWS}) q"
KEYED_MEMBERS = f"""WITH i AS ({KEYED}) SELECT e.user_id, e.flow_id AS end_id, CAST(j AS INT) AS pos, r.flow_id, r.OUT_BYTES, r.L7_PROTO
 FROM i e, generate_series(0, {WINDOW - 1}) g(j) JOIN i r ON r.user_id = e.user_id AND r.idx = e.idx - {WINDOW - 1} + j
 WHERE e.idx >= {WINDOW - 1}"""


@query("w1_sliding_windows_per_sensor", KEYED_MEMBERS)
def _sliding_windows_per_sensor(spark, sf_dir):
    rows = windows.keyed_index(flows(spark, sf_dir), "user_id", ORDER).withColumn("end_id", F.col("flow_id"))
    found = windows.sliding_windows(rows, COLS, WINDOW, keep=["user_id", "end_id"], key="user_id")
    return members(found, "user_id", "end_id")


def strided_sql(stride: int) -> str:
    return f"""WITH i AS ({INDEXED}) SELECT (e.idx // {stride}) AS window_id, e.idx AS start_idx, CAST(j AS INT) AS pos, r.flow_id, r.OUT_BYTES, r.L7_PROTO
    FROM i e, generate_series(0, {WINDOW - 1}) g(j) JOIN i r ON r.idx = e.idx + j
    WHERE e.idx % {stride} = 0 AND e.idx + {WINDOW} <= (SELECT count(*) FROM i)"""


@query("w2_windows_no_overlap", strided_sql(WINDOW))
def _windows_no_overlap(spark, sf_dir):
    out = windows.strided_windows(indexed_flows(spark, sf_dir), COLS, WINDOW)
    return members(out, "window_id", "start_idx")


@query("w2_windows_stride_3", strided_sql(3))
def _windows_stride_3(spark, sf_dir):
    out = windows.strided_windows(indexed_flows(spark, sf_dir), COLS, WINDOW, 3)
    return members(out, "window_id", "start_idx")


PAD = 50


@query(
    "w3_padded_windows",
    f"""WITH i AS ({KEYED}), w AS (SELECT DISTINCT user_id, idx // {PAD} AS window_id FROM i)
    SELECT w.user_id, w.window_id, CAST(p AS INT) AS pos, coalesce(i.flow_id, 0) AS flow_id, coalesce(i.OUT_BYTES, 0) AS OUT_BYTES
    FROM w CROSS JOIN generate_series(0, {PAD - 1}) g(p)
    LEFT JOIN i ON i.user_id = w.user_id AND i.idx = w.window_id * {PAD} + p""",
)
def _padded_windows(spark, sf_dir):
    # each sensor's history in windows of PAD flows, zero rows after the data in its last one
    cols = ["flow_id", "OUT_BYTES"]
    rows = index_in_groups(flows(spark, sf_dir), ["user_id"], ORDER)
    grouped = rows.groupBy("user_id", int_div(F.col("pos"), PAD).alias("window_id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", F.struct(*cols).alias("r")))).alias("a")
    )
    win = F.transform("a", lambda x: x["r"])
    padded = windows.pad_window(win, PAD, windows.zero_row(rows.schema, cols))
    return grouped.select("user_id", "window_id", F.posexplode(padded).alias("pos", "m")).select(
        "user_id", "window_id", "pos", "m.flow_id", "m.OUT_BYTES"
    )


@query(
    "w4_last_window",
    f"""WITH i AS ({INDEXED}) SELECT CAST(b AS INT) AS b, CAST(idx - (SELECT count(*) - {WINDOW} FROM i) AS INT) AS pos, flow_id, OUT_BYTES, L7_PROTO
    FROM i, generate_series(0, 3) g(b) WHERE idx >= (SELECT count(*) - {WINDOW} FROM i)""",
)
def _last_window(spark, sf_dir):
    return members(windows.edge_window(flows(spark, sf_dir), COLS, WINDOW, batch=4, order=ORDER), "b")


@query("w5_first_window", f"SELECT CAST(0 AS INT) AS b, CAST(idx AS INT) AS pos, flow_id, OUT_BYTES, L7_PROTO FROM ({INDEXED}) q WHERE idx < {WINDOW}")
def _first_window(spark, sf_dir):
    return members(windows.edge_window(flows(spark, sf_dir), COLS, WINDOW, from_end=False, strict=True, order=ORDER), "b")


@query("w6_windows_at_eval_rows", members_sql("SELECT idx FROM i WHERE role = 'eval'", source=ROLES))
def _windows_at_eval_rows(spark, sf_dir):
    roles = multiclass_roles(spark, sf_dir)
    return members(windows.windows_at(roles, roles.filter("role = 'eval'"), COLS, WINDOW), "idx")


CONTEXT_BATCH = 32
CONTEXT = f"""WITH i AS ({ROLES}),
 t AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS o FROM i WHERE role = 'eval'),
 c AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM i WHERE training),
 d AS (SELECT t.idx AS target, s, CAST((2654435761::HUGEINT * ((o % {CONTEXT_BATCH}) * {WINDOW} + s)
   + {number_sql(f"concat('42-', CAST(o // {CONTEXT_BATCH} AS STRING))")} % (SELECT max(n) FROM c)) % (SELECT max(n) FROM c) AS BIGINT) AS p
  FROM t, generate_series(0, {WINDOW - 2}) g(s)),
 m AS (SELECT d.target, d.s, c.idx FROM d JOIN c USING (p) UNION ALL SELECT idx, {WINDOW - 1}, idx FROM t)
 SELECT m.target AS idx, CAST(m.s AS INT) AS pos, i.flow_id, i.OUT_BYTES, i.L7_PROTO FROM m JOIN i ON i.idx = m.idx"""


@query("w7_random_context", CONTEXT)
def _random_context(spark, sf_dir):
    roles = multiclass_roles(spark, sf_dir)
    # rows are indexed once; positions among the targets and the training rows follow from counts
    targets = subset_positions(roles.filter("role = 'eval'").select("role", "idx"), ["role"], pos="ordinal").drop("role")
    context = subset_positions(roles.filter("training").select("training", "idx"), ["training"]).drop("training")
    out = windows.random_context_windows(
        targets, context, roles, COLS, roles.filter("training").count(), WINDOW, CONTEXT_BATCH, 42
    )
    return members(out, "idx")


# -- encoded windows ---------------------------------------------------------------------------
CODES = f"WITH f AS ({INDEXED}), {params_sql('f')}, e AS ({encoded_sql('f', ['idx', 'flow_id', 'Attack'])})"


def encoded_windows(spark, sf_dir, keep=("Attack",)):
    f = indexed_flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    codes = encode.encode_codes(f, params, keep=["idx", "Attack"])
    return windows.sliding_windows(codes, NFV1.features, WINDOW, keep=list(keep)), params


def joined_sql(value: str) -> str:
    return f"string_agg(CAST({value} AS VARCHAR), ',' ORDER BY r.idx)"


def per_window_sql(columns: str) -> str:
    return (
        f"{CODES} SELECT x.idx AS idx, {columns} FROM e x JOIN e r ON r.idx BETWEEN x.idx - {WINDOW - 1} AND x.idx "
        f"WHERE x.idx >= {WINDOW - 1} GROUP BY x.idx, x.Attack"
    )


def micro(f: str, alias: str = "r") -> str:
    return f"CAST(round({alias}.{f} * 1000000) AS BIGINT)"


@query(
    "w8_w14_feature_wise",
    per_window_sql(
        "x.Attack AS label, " + ", ".join(f"{joined_sql(micro(f))} AS {f}" for f in NFV1.numerical)
        + ", " + ", ".join(f"{joined_sql(f'r.{f}')} AS {f}" for f in NFV1.categorical)
    ),
)
def _feature_wise(spark, sf_dir):
    f = indexed_flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    codes = encode.encode_codes(f, params, keep=["idx", "Attack"])
    found = windows.sliding_windows(codes, [*NFV1.features, "Attack"], WINDOW)
    wise = found.select(
        "idx", windows.last_label(F.col("win"), "Attack").alias("label"),
        *windows.feature_wise(F.col("win"), NFV1.features),
    )
    return wise.select(
        "idx", "label", *[micros(F.col(n)).alias(n) for n in NFV1.numerical],
        *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in NFV1.categorical],
    )


# every input, categoricals at fixed widths
INPUT_NAMES = [f"input_{f}" for f in NFV1.features]


def input_sql(f: str) -> str:
    if f in NFV1.numerical:
        return f'{joined_sql(f"CAST(round(r.{f} * 10000) AS BIGINT)")} AS "input_{f}"'
    at = fitted_code_sql(f)
    digits = f"CASE WHEN {at} = 0 THEN repeat('0', {DIMS[f]}) ELSE repeat('0', CAST({at} - 1 AS INT)) || '1' || repeat('0', CAST({DIMS[f]} - {at} AS INT)) END"
    return f"string_agg({digits}, ',' ORDER BY r.idx) AS \"input_{f}\""


@query(
    "w9_model_inputs",
    f"{CODES}, n AS (SELECT {WIDTHS}) SELECT x.idx AS idx, {', '.join(input_sql(f) for f in NFV1.features)} "
    f"FROM e x JOIN e r ON r.idx BETWEEN x.idx - {WINDOW - 1} AND x.idx CROSS JOIN n WHERE x.idx >= {WINDOW - 1} GROUP BY x.idx",
)
def _model_inputs(spark, sf_dir):
    found, params = encoded_windows(spark, sf_dir)
    inputs = windows.model_inputs(found, params, INPUT_NAMES, DIMS, keep=["idx"])

    def rows(name, as_text):
        return F.array_join(F.transform(name, as_text), ",").alias(name)

    def number(v):
        return F.round(F.get(v, F.lit(0)).cast("double") * 10000).cast("bigint").cast("string")

    def vector(v):
        return F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), "")

    return inputs.select("idx", *[
        rows(f"input_{f}", number if f in NFV1.numerical else vector) for f in NFV1.features
    ])


@query(
    "w10_w11_pooled_records",
    per_window_sql(
        "round(avg(r.IN_PKTS), 5) AS mean_in, round(avg(CASE WHEN r.PROTOCOL = 1 THEN 1.0 ELSE 0.0 END), 5) AS mean_proto_1, "
        "round(max(x.IN_PKTS), 5) AS last_in, CAST(max(CASE WHEN x.PROTOCOL = 3 THEN 1 ELSE 0 END) AS INT) AS last_proto_3, "
        "round(sum(r.IN_PKTS + r.OUT_PKTS + r.IN_BYTES + r.OUT_BYTES + r.FLOW_DURATION_MILLISECONDS "
        "+ CASE WHEN r.L4_SRC_PORT > 0 THEN 1 ELSE 0 END + CASE WHEN r.L4_DST_PORT > 0 THEN 1 ELSE 0 END + 1 + 1 "
        "+ CASE WHEN r.TCP_FLAGS > 0 THEN 1 ELSE 0 END), 5) AS flat_sum, "
        f"CAST({WINDOW} * (5 + (SELECT max(c) FROM c_L4_SRC_PORT) + (SELECT max(c) FROM c_L4_DST_PORT) + (SELECT max(c) FROM c_PROTOCOL) "
        "+ (SELECT max(c) FROM c_L7_PROTO) + (SELECT max(c) FROM c_TCP_FLAGS)) AS INT) AS flat_size"
    ),
)
def _pooled_records(spark, sf_dir):
    found, params = encoded_windows(spark, sf_dir)
    width = score.record_width(params)
    n = {f: p.n_levels for f, p in params.categorical.items()}
    at = len(params.numerical) + n["L4_SRC_PORT"] + n["L4_DST_PORT"]  # first position of PROTOCOL
    vectors = found.select(
        "idx", F.transform("win", lambda row: windows.record_vector(row, params)).alias("v")
    )
    pools = vectors.select(
        "idx", *[windows.pool_window(F.col("v"), how, width, WINDOW).alias(how) for how in ("mean", "last", "flatten")]
    )
    total = F.aggregate("flatten", F.lit(0.0), lambda a, v: a + v)
    return pools.select(
        "idx", F.round(F.col("mean")[0], 5).alias("mean_in"), F.round(F.col("mean")[at], 5).alias("mean_proto_1"),
        F.round(F.col("last")[0], 5).alias("last_in"), F.col("last")[at + 2].cast("int").alias("last_proto_3"),
        F.round(total, 5).alias("flat_sum"), F.size("flatten").alias("flat_size"),
    )


@query(
    "w12_window_context",
    f"""WITH i AS ({INDEXED}) SELECT e.idx, CAST(j AS INT) AS pos, r.IPV4_SRC_ADDR AS src_ip, r.IPV4_DST_ADDR AS dst_ip,
    r.L4_SRC_PORT AS src_port, r.L4_DST_PORT AS dst_port, r.PROTOCOL AS protocol, r.L7_PROTO AS l7_proto
    FROM i e, generate_series(0, {WINDOW - 1}) g(j) JOIN i r ON r.idx = e.idx - {WINDOW - 1} + j WHERE e.idx >= {WINDOW - 1}""",
)
def _window_context(spark, sf_dir):
    rows = indexed_flows(spark, sf_dir).withColumn("ctx", windows.context_struct())
    found = windows.sliding_windows(rows, ["ctx"], WINDOW)
    return found.select("idx", F.posexplode("win").alias("pos", "m")).select("idx", "pos", "m.ctx.*")
