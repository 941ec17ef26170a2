"""Streams, detection and model fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, ORDER, WINDOW, encoded_sql, params_sql, query
from flowspark.catalog.preparation import ASSEMBLED, GAP_S, comparable
from flowspark.catalog.splits import ROLES
from flowspark.catalog.windowing import COLS, KEYED_MEMBERS, encoded_windows
from flowspark.flows import flows, packets
from flowspark.operators import encode, evaluate, score, stats
from flowspark.plans import training
from flowspark.plans.detection import alert_sink, detect_stream, detect_table, table_sink
from flowspark.session import scratch_path
from flowspark.settings import VerdictSettings
from flowspark.sources import readers, writers
from flowspark.specs import NFV1
from flowspark.streaming.flows import assemble_flows_stream, drain, send_tick, tick_stream
from flowspark.streaming.windows import WindowFeed, sliding_windows_stateful


def arrive_in_parts(df, path, run, parts=3):
    """Append the table to ``path`` in ``parts`` time slices; ``run`` drains the stream after each."""
    low, high = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    slot = F.floor((F.unix_micros("ts") - low) * parts / F.lit(high - low + 1))
    for i in range(parts):
        df.filter(slot == i).write.mode("append").parquet(path)
        run(i == parts - 1)


def ddl(df) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


@query("a3_assemble_flows_stream", ASSEMBLED)
def _assemble_flows_stream(spark, sf_dir):
    path, ticks, out, state = (scratch_path(spark, n) for n in ("packets", "ticks", "flows", "state"))
    pk = packets(spark, sf_dir)
    first, last = pk.agg(F.min("ts"), F.max("ts")).first()
    send_tick(spark, ticks, first)

    def run(ended):
        if ended:
            drain(spark, ticks, last, GAP_S + 60)
        live = readers.stream_records(spark, path, ddl(pk))
        found = assemble_flows_stream(live, f"{GAP_S} seconds", "1 minute", tick_stream(spark, ticks))
        q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()

    arrive_in_parts(pk, path, run)
    return comparable(spark.read.parquet(out))


@query("w13_stream_windows", KEYED_MEMBERS)
def _stream_windows(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("flows", "windows", "state"))
    f = flows(spark, sf_dir).select("user_id", "ts", *COLS).withColumn("end_id", F.col("flow_id"))

    def sink(found, batch_id):
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    def run(last):
        live = readers.stream_records(spark, path, ddl(f))
        feed = WindowFeed(f"{state}/feed", COLS, ORDER, sink, "user_id", ["end_id"], WINDOW)
        q = live.writeStream.foreachBatch(feed).option("checkpointLocation", f"{state}/query").trigger(availableNow=True).start()
        q.awaitTermination()

    arrive_in_parts(f, path, run)
    found = spark.read.parquet(out)
    return found.select("user_id", "end_id", F.posexplode("win").alias("pos", "m")).select("user_id", "end_id", "pos", "m.*")


@query("w13_stream_windows_stateful", KEYED_MEMBERS)
def _stream_windows_stateful(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("flows", "windows", "state"))
    f = flows(spark, sf_dir).select("user_id", "ts", *COLS).withColumn("end_id", F.col("flow_id"))

    def run(last):
        live = readers.stream_records(spark, path, ddl(f))
        found = sliding_windows_stateful(live, "user_id", COLS, ORDER, WINDOW, keep=["end_id"])
        q = found.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()

    arrive_in_parts(f, path, run)
    zipped = F.arrays_zip(*[F.col(f"win_{c}") for c in COLS])
    return spark.read.parquet(out).select("user_id", "end_id", F.posexplode(zipped).alias("pos", "m")).select(
        "user_id", "end_id", "pos", *[F.col(f"m.win_{c}").alias(c) for c in COLS]
    )


# -- detection with a fixed score formula --------------------------------------------------------
SETTINGS = VerdictSettings(["Benign", "Attack"], "Benign", 0)


def mean_bytes_score(found):
    """Attack score: the window's mean of the scaled OUT_BYTES."""
    total = F.aggregate("win", F.lit(0.0), lambda a, s: a + s["OUT_BYTES"])
    with_mean = found.withColumn("_m", total / F.size("win"))
    return with_mean.withColumn("scores", F.array(1 - F.col("_m"), "_m")).drop("_m")


VERDICTS = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, flow_id) - 1 AS idx FROM ({FLOWS}) q), {params_sql('f')},
 e AS ({encoded_sql('f', ['user_id', 'idx', 'flow_id'])}),
 w AS (SELECT x.user_id, x.idx, x.flow_id, avg(r.OUT_BYTES) AS m FROM e x JOIN e r ON r.user_id = x.user_id AND r.idx BETWEEN x.idx - {WINDOW - 1} AND x.idx
  WHERE x.idx >= {WINDOW - 1} GROUP BY x.user_id, x.idx, x.flow_id)
"""
JUDGED = f"{VERDICTS} SELECT user_id, flow_id, CASE WHEN m > 1 - m THEN 'Attack' ELSE 'Benign' END AS label, round(greatest(m, 1 - m), 5) AS confidence, m > 1 - m AS is_attack FROM w"


def judged_columns(df):
    return df.select(
        "user_id", "flow_id", F.col("verdict.predicted_label").alias("label"),
        F.round("verdict.confidence", 5).alias("confidence"), "verdict.is_attack",
    )


@query("m9_detect_table", JUDGED)
def _detect_table(spark, sf_dir):
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    return judged_columns(detect_table(f, params, mean_bytes_score, SETTINGS, ORDER, ["flow_id"], WINDOW, "user_id"))


@query("m9_detect_stream", JUDGED)
def _detect_stream(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("flows", "verdicts", "state"))
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)

    def run(last):
        live = readers.stream_records(spark, path, ddl(f))
        detect_stream(
            live, params, mean_bytes_score, SETTINGS, ORDER, ["flow_id"], table_sink(out), state, WINDOW, "user_id"
        ).awaitTermination()

    arrive_in_parts(f, path, run)
    return judged_columns(spark.read.parquet(out))


ALERTS = f"""{VERDICTS} SELECT f.flow_id, 'Attack' AS attack_type, round(m, 5) AS attack_probability, IPV4_SRC_ADDR AS src_ip, L4_SRC_PORT AS src_port,
 IPV4_DST_ADDR AS dst_ip, L4_DST_PORT AS dst_port, PROTOCOL AS protocol, L7_PROTO AS l7_proto FROM w JOIN f ON f.flow_id = w.flow_id WHERE m > 1 - m"""


@query("s11_alerts", ALERTS)
def _alerts(spark, sf_dir):
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    judged = detect_table(f, params, mean_bytes_score, SETTINGS, ORDER, ["flow_id"], WINDOW, "user_id")
    out = writers.alerts(judged, ["flow_id"])
    return out.withColumn("attack_probability", F.round("attack_probability", 5))


@query("s11_alerts_stream", ALERTS)
def _alerts_stream(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("flows", "alerts", "state"))
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)

    def run(last):
        live = readers.stream_records(spark, path, ddl(f))
        detect_stream(
            live, params, mean_bytes_score, SETTINGS, ORDER, ["flow_id"], alert_sink(out, ["flow_id"]),
            state, WINDOW, "user_id",
        ).awaitTermination()

    arrive_in_parts(f, path, run, parts=2)
    found = spark.read.parquet(out).drop("batch_id")
    return found.withColumn("attack_probability", F.round("attack_probability", 5))


# -- detection with a model ------------------------------------------------------------------------
# Fixed weights: scaled numbers and the first level of two categoricals; every other weight is 0.
WEIGHTS = {"OUT_BYTES": 2.0, "IN_PKTS": -1.0, "PROTOCOL": 0.5, "L7_PROTO": -0.7}
INTERCEPT = -0.3


def stored_model(params):
    """A logistic model with ``WEIGHTS`` in the order of a record vector."""
    weights = [WEIGHTS.get(f, 0.0) for f in params.numerical]
    for f, p in params.categorical.items():
        weights += [WEIGHTS.get(f, 0.0), *[0.0] * (p.n_levels - 1)]
    return score.stored_logistic(weights, INTERCEPT)


def linear_sql(alias: str) -> str:
    terms = [f"{w} * {alias}.{f}" if f in NFV1.numerical else f"{w} * CASE WHEN {alias}.{f} = 1 THEN 1 ELSE 0 END" for f, w in WEIGHTS.items()]
    return " + ".join(terms)


MODEL_VERDICTS = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, flow_id) - 1 AS idx FROM ({FLOWS}) q), {params_sql('f')},
 e AS ({encoded_sql('f', ['user_id', 'idx', 'flow_id'])}),
 w AS (SELECT x.user_id, x.idx, x.flow_id, 1 / (1 + exp(-({INTERCEPT} + avg({linear_sql('r')})))) AS m
  FROM e x JOIN e r ON r.user_id = x.user_id AND r.idx BETWEEN x.idx - {WINDOW - 1} AND x.idx
  WHERE x.idx >= {WINDOW - 1} GROUP BY x.user_id, x.idx, x.flow_id)
SELECT user_id, flow_id, CASE WHEN m > 1 - m THEN 'Attack' ELSE 'Benign' END AS label, round(greatest(m, 1 - m), 5) AS confidence, m > 1 - m AS is_attack FROM w"""


@query("m9_detect_with_model", MODEL_VERDICTS)
def _detect_with_model(spark, sf_dir):
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    model = score.model_score(stored_model(params), params, "mean", window=WINDOW)
    return judged_columns(detect_table(f, params, model, SETTINGS, ORDER, ["flow_id"], WINDOW, "user_id"))


@query("m9_detect_with_model_stream", MODEL_VERDICTS)
def _detect_with_model_stream(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("flows", "verdicts", "state"))
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    model = score.model_score(stored_model(params), params, "mean", window=WINDOW)

    def run(last):
        live = readers.stream_records(spark, path, ddl(f))
        detect_stream(
            live, params, model, SETTINGS, ORDER, ["flow_id"], table_sink(out), state, WINDOW, "user_id"
        ).awaitTermination()

    arrive_in_parts(f, path, run, parts=2)
    return judged_columns(spark.read.parquet(out))


# -- model fitting: the fitted weights have no SQL equivalent, what is scored and counted has ---------------
@query(
    "m1_m3_train_and_evaluate",
    f"""WITH e AS (SELECT Attack FROM ({ROLES}) q WHERE role = 'eval' AND idx >= {WINDOW - 1})
    SELECT Attack AS class, count(*) AS support, CAST(NULL AS BOOLEAN) AS learned FROM e GROUP BY Attack
    UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT count(*) FROM e), unnest([NULL, true, NULL])""",
)
def _train_and_evaluate(spark, sf_dir):
    data = training.load_dataset(flows(spark, sf_dir), ORDER)
    _, report, _ = training.train_and_evaluate(data)
    # a model that always names one class has a mean recall of a third
    learned = F.when(F.col("class") == "macro avg", F.col("recall") > 0.4)
    return report.select("class", "support", learned.alias("learned"))


@query(
    "m2_m3_binary_classifier",
    f"""SELECT count(*) FILTER (WHERE Attack <> 'Benign') AS "P", count(*) FILTER (WHERE Attack = 'Benign') AS "N", count(*) AS n_scored, true AS learned
    FROM ({ROLES}) q WHERE role = 'eval' AND idx >= {WINDOW - 1}""",
)
def _binary_classifier(spark, sf_dir):
    data = training.load_dataset(flows(spark, sf_dir), ORDER)
    model = score.fit_binary_classifier(training.binary_batches(data))
    found = evaluate.binary_evaluation(score.score_positive(training.window_sets(data, role="eval"), model))
    return found.select("P", "N", (F.col("pred_P") + F.col("pred_N")).alias("n_scored"), (F.col("bal_acc") > 0.6).alias("learned"))  # half for a constant answer


@query(
    "m4_score_single_flows",
    f"""WITH f AS ({FLOWS}), {params_sql('f')}, e AS ({encoded_sql('f', ['flow_id', 'Attack'])})
    SELECT flow_id, Attack, round(1 / (1 + exp(-({INTERCEPT} + {linear_sql('e')}))), 6) AS score FROM e""",
)
def _score_single_flows(spark, sf_dir):
    f = flows(spark, sf_dir)
    params = stats.collect_params(f, NFV1)
    codes = encode.encode_codes(f, params, keep=["flow_id", "Attack"])
    vectors = score.flow_vectors(codes, params, keep=["flow_id", "Attack"])
    return score.score_positive(vectors, stored_model(params)).select("flow_id", "Attack", F.round("score", 6).alias("score"))


@query(
    "m3_score_in_batches",
    f"""WITH f AS (SELECT *, row_number() OVER (ORDER BY ts, flow_id) - 1 AS idx FROM ({FLOWS}) q), {params_sql('f')}, e AS ({encoded_sql('f', ['idx'])})
    SELECT x.idx, round(1 / (1 + exp(-({INTERCEPT} + avg({linear_sql('r')})))), 6) AS attack_score
    FROM e x JOIN e r ON r.idx BETWEEN x.idx - 7 AND x.idx WHERE x.idx >= 7 GROUP BY x.idx""",
)
def _score_in_batches(spark, sf_dir):
    found, params = encoded_windows(spark, sf_dir)
    vectors = score.window_vectors(found, params, "mean", keep=["idx"], window=WINDOW)
    scored = score.score_positive(vectors, stored_model(params))
    return scored.select("idx", F.round("score", 6).alias("attack_score"))
