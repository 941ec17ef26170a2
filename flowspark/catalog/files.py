"""Sources and sinks: what is written and read back must be the table again."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.catalog.base import (
    FLOWS, INDEXED, ORDER, WINDOW, encoded_sql, params_sql, query, rounded_features, rounded_features_sql,
)
from flowspark.catalog.encoding import DIMS, WIDTHS, fitted_code_sql
from flowspark.catalog.windowing import CODES, encoded_windows
from flowspark.flows import flows
from flowspark.operators import encode, stats, windows
from flowspark.operators.order import index_rows
from flowspark.schemas import NFV1_SCHEMA, FittedParams
from flowspark.session import scratch_path
from flowspark.sources import cache, readers, tensors, writers
from flowspark.specs import NFV1

RECORDS = [part.split()[0] for part in NFV1_SCHEMA.split(", ")]
RECORDS_SQL = ", ".join(RECORDS)


@query("s1_s6_csv_round_trip", f"SELECT flow_id, {RECORDS_SQL} FROM ({FLOWS}) q")
def _csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(flows(spark, sf_dir).select("flow_id", *RECORDS), path)
    return readers.read_flows(spark, path, schema=f"flow_id BIGINT, {NFV1_SCHEMA}")


@query("s1_first_rows_in_file_order", f"SELECT {RECORDS_SQL} FROM ({FLOWS}) q ORDER BY ts, flow_id LIMIT 500")
def _first_rows_in_file_order(spark, sf_dir):
    # written in time order, so the first rows of the files are the first in time
    path = scratch_path(spark, "csv")
    ordered = flows(spark, sf_dir).repartitionByRange(4, *ORDER).sortWithinPartitions(*ORDER)
    writers.write_csv(ordered.select(*RECORDS), path)
    return readers.read_flows(spark, path, n_rows=500)


@query("s2_read_columns", f"SELECT {', '.join(NFV1.include_fields)}, Attack FROM ({FLOWS}) q")
def _read_columns(spark, sf_dir):
    path = scratch_path(spark, "flows") + ".parquet"
    writers.write_table(flows(spark, sf_dir), path)
    return readers.read_columns(spark, path, NFV1)


@query("s3_stream_records", f"SELECT flow_id, {RECORDS_SQL} FROM ({FLOWS}) q")
def _stream_records(spark, sf_dir):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    writers.write_table(flows(spark, sf_dir).select("flow_id", *RECORDS), path)
    live = readers.stream_records(spark, path, f"flow_id BIGINT, {NFV1_SCHEMA}")
    q = live.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


@query(
    "s4_labelled_files",
    f"SELECT CASE PROTOCOL WHEN 6 THEN 'Dos_TCP_Flood' WHEN 17 THEN 'Dos_UDP_flood' ELSE 'Benign' END AS Attack, count(*) AS n_rows "
    f"FROM ({FLOWS}) q GROUP BY 1",
)
def _labelled_files(spark, sf_dir):
    root = scratch_path(spark, "labelled")
    f = flows(spark, sf_dir).select(*RECORDS)
    files = [(f"{root}/missing", "Benign")]
    for protocol, label in ((6, "Dos_TCP_Flood"), (17, "Dos_UDP_flood"), (1, "Benign")):
        path = f"{root}/p{protocol}"
        writers.write_table(f.filter(F.col("PROTOCOL") == protocol), path)
        files.append((path, label))
    return stats.label_distribution(readers.read_labelled(spark, files)).drop("percent")


@query(
    "s5_glob_merge",
    f"""SELECT {RECORDS_SQL}, row_number() OVER (ORDER BY CASE PROTOCOL WHEN 1 THEN 1 WHEN 17 THEN 2 ELSE 3 END, ts, flow_id) - 1 AS place
    FROM ({FLOWS}) q""",
)
def _glob_merge(spark, sf_dir):
    # one file a protocol, rows in time order; names sort as 1, 17, 6
    root = scratch_path(spark, "glob")
    f = flows(spark, sf_dir)
    for protocol in (1, 6, 17):
        part = f.filter(F.col("PROTOCOL") == protocol).repartitionByRange(2, *ORDER).sortWithinPartitions(*ORDER)
        writers.write_csv(part.select(*RECORDS), f"{root}/converted_{protocol}.csv")
    merged = readers.read_glob(spark, f"{root}/converted*.csv")
    return index_rows(merged, readers.FILE_ORDER, "place").drop(*readers.FILE_ORDER)


@query("s7_rotating_files", "SELECT count(*) AS n_rows, true AS within_limit FROM events")
def _rotating_files(spark, sf_dir):
    path = scratch_path(spark, "rotating")
    writers.write_csv(flows(spark, sf_dir).select("flow_id", *RECORDS), path, rows_per_file=700)
    back = spark.read.schema(f"flow_id BIGINT, {NFV1_SCHEMA}").csv(path, header=True)
    per_file = back.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 700).alias("within_limit"))


@query(
    "s8_preprocess_cache",
    f"WITH f AS ({FLOWS}), {params_sql('f')}, e AS ({encoded_sql('f', ['flow_id', 'Attack'])}) "
    f"SELECT flow_id, Attack, {rounded_features_sql()} FROM e",
)
def _preprocess_cache(spark, sf_dir):
    folder = scratch_path(spark, "cache")
    key = cache.cache_key("events", 0, {"top_k": 32}, {"evaluation_percent": 0.2})

    def build():
        f = flows(spark, sf_dir)
        params = stats.collect_params(f, NFV1)
        return encode.encode_codes(f, params, keep=["flow_id", "Attack"]), params.to_json()

    def unexpected():
        raise AssertionError("the second call must be a hit")

    cache.cached(spark, folder, key, build)
    table, text = cache.cached(spark, folder, key, unexpected)
    assert list(FittedParams.from_json(text).categorical) == NFV1.categorical
    return table.select("flow_id", "Attack", *rounded_features())


# all model inputs at fixed widths
MESSAGE_INPUTS = [f"input_{f}" for f in NFV1.features]
COUNTS = [WINDOW * DIMS.get(f, 1) for f in NFV1.features]


def messages(spark, sf_dir):
    found, params = encoded_windows(spark, sf_dir)
    inputs = windows.model_inputs(found, params, MESSAGE_INPUTS, DIMS, keep=["idx"])
    # sequence numbers start at 1
    return tensors.tensor_messages(inputs, MESSAGE_INPUTS, F.col("idx") - 6, max_bytes=MESSAGE_BYTES)


MESSAGE_BYTES = 8192


def payload_sql(f: str) -> str:
    """Thousandths of a number, or the digits of a one-hot vector, for all rows of a window."""
    if f in NFV1.numerical:
        value = f"CAST(CAST(round(r.{f} * 1000) AS BIGINT) AS VARCHAR)"
    else:
        value = f"array_to_string(list_transform(range(1, {DIMS[f]} + 1), lambda i: CASE WHEN i = {fitted_code_sql(f)} THEN '1000' ELSE '0' END), ',')"
    return f"string_agg({value}, ',' ORDER BY r.idx)"


def payload_text(messages: DataFrame, numbers: int, rows: int, dims: list[int]) -> DataFrame:
    """``payload`` as comma-joined thousandths, for comparison. Expected are ``numbers`` scaled numbers, then for each
    of ``dims`` as many one-hot vectors as ``rows``; any other payload is written number by number, with equal results.

    Functions on array elements are not compiled and round by way of decimals, so the long one-hot part does not go
    through them: the place of the first 1 in a vector leads to its text, once it is known that the part holds no other
    1 and nothing else but 0. Numbers and vectors are cut out as a generated row: inside a function on elements they
    would be cut out anew for each use.
    """
    one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    length = numbers + rows * sum(dims)
    cut = messages.select("*", F.inline(F.array(F.struct(
        F.slice("payload", 1, numbers).alias("_numbers"), F.slice("payload", numbers + 1, length - numbers).alias("_bits")
    ))))
    # The check of the numbers also keeps this step out of whole-stage code, whose one method would be too long to be
    # compiled. A float times 1000 is exact, and so is the sum that matters for its rounding.
    found = {"_scaled": F.forall("_numbers", lambda v: (v >= 0) & (v < 1e9)), "_rest": F.array_remove("_bits", one)}
    texts, ones, start = [], F.lit(0), 1
    for i, dim in enumerate(dims):
        places = [F.array_position(F.slice("_bits", start + r * dim, dim), one).cast("int") for r in range(rows)]
        found[f"_at{i}"] = F.array(*places)
        start += rows * dim
        # no 1, or a 1 at each place
        hot = [",".join("1000" if p + 1 == at else "0" for p in range(dim)) for at in range(dim + 1)]
        texts.append(F.array_join(F.transform(f"_at{i}", _entry(hot)), ","))
        ones = ones + F.size(F.array_remove(f"_at{i}", 0))
    near = F.transform("_numbers", lambda v: F.floor(v.cast("double") * 1000 + 0.5).cast("string"))
    single = F.transform("payload", lambda v: F.round(v.cast("double") * 1000).cast("bigint").cast("string"))
    expected = (
        F.col("_scaled") & (F.size("payload") == length) & (F.size("_rest") + ones == length - numbers)
        & (F.size(F.array_remove("_rest", zero)) == 0)
    )
    text = F.when(expected, F.concat_ws(",", F.array_join(near, ","), *texts)).otherwise(F.array_join(single, ","))
    return cut.withColumns(found).withColumn("payload", text).drop("_numbers", "_bits", *found)


def _entry(table: list[str]):
    return lambda at: F.get(F.lit(table), at)


@query(
    "s9_tensor_messages",
    f"""{CODES}, n AS (SELECT {WIDTHS})
    SELECT x.idx - 6 AS seq, 1 AS version, {len(COUNTS)} AS n_inputs, {sum(COUNTS)} AS total_floats, '{','.join(map(str, COUNTS))}' AS elem_counts,
    {" || ',' || ".join(payload_sql(f) for f in NFV1.features)} AS payload
    FROM e x JOIN e r ON r.idx BETWEEN x.idx - 7 AND x.idx CROSS JOIN n WHERE x.idx >= 7 GROUP BY x.idx""",
)
def _tensor_messages(spark, sf_dir):
    m = payload_text(messages(spark, sf_dir), WINDOW * len(NFV1.numerical), WINDOW, [DIMS[f] for f in NFV1.categorical])
    return m.select(
        "seq", "version", "n_inputs", "total_floats",
        F.array_join(F.col("elem_counts").cast("array<string>"), ",").alias("elem_counts"), "payload",
    )


@query(
    "s10_validate_messages",
    f"""SELECT idx - 6 AS seq, CASE WHEN (idx - 6) % 11 = 0 THEN 'version' WHEN (idx - 6) % 13 = 0 THEN 'input count'
    WHEN (idx - 6) % 17 = 0 THEN 'element count' WHEN (idx - 6) % 19 = 0 THEN 'total' ELSE 'accepted' END AS outcome
    FROM ({INDEXED}) q WHERE idx >= 7""",
)
def _validate_messages(spark, sf_dir):
    s = F.col("seq")
    m = messages(spark, sf_dir)
    broken = m.withColumns({
        "version": F.when(s % 11 == 0, 2).otherwise(F.col("version")),
        "n_inputs": F.when(s % 13 == 0, 3).otherwise(F.col("n_inputs")),
        "elem_counts": F.when(s % 17 == 0, F.array(*[F.lit(n + 1) for n in COUNTS])).otherwise(F.col("elem_counts")),
        "total_floats": F.when(s % 19 == 0, 41).otherwise(F.col("total_floats")),
    })
    checked = tensors.validate_messages(broken, COUNTS, MESSAGE_BYTES)
    bad = checked.filter("reject_reason IS NOT NULL").select("seq", F.col("reject_reason").alias("outcome"))
    # every message twice: the copies collapse
    twice = checked.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    good = tensors.accepted_messages(twice).select("seq", F.lit("accepted").alias("outcome"))
    return bad.unionByName(good)


