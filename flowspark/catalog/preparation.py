"""Renaming, labelling, filling, filtering, statistics and flow assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, INDEXED, ORDER, PACKETS, indexed_flows, query
from flowspark.flows import flows, packets
from flowspark.operators import prepare, stats
from flowspark.operators.assemble import assemble_flows
from flowspark.operators.order import first_rows
from flowspark.schemas import NFV1_SCHEMA, CategoricalParams, FittedParams, NumericParams
from flowspark.specs import NFV1

NFV1_TYPES = (
    "IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, PROTOCOL, FLOW_DURATION_MILLISECONDS, "
    "OUT_PKTS, OUT_BYTES, IN_PKTS, IN_BYTES, L7_PROTO, TCP_FLAGS"
)


def raw_flows(spark, sf_dir):
    """Flows under their raw names, with a few of the columns that get dropped."""
    back = {new: old for old, new in prepare.RAW_TO_NFV1.items()}
    df = flows(spark, sf_dir).withColumnsRenamed(back)
    return df.withColumns({
        "id": F.col("flow_id"), "vlan_id": F.lit(0), "ip_version": F.lit(4),
        "bidirectional_packets": F.col("src2dst_packets") + F.col("dst2src_packets"),
        "bidirectional_first_seen_ms": F.unix_millis("ts"),
    })


@query("p1_p2_p3_raw_to_records", f"SELECT flow_id, {NFV1_TYPES}, 'Dos_TCP_Flood' AS Attack FROM ({FLOWS}) q")
def _raw_to_records(spark, sf_dir):
    out = prepare.raw_to_nfv1(raw_flows(spark, sf_dir), "Dos_TCP_Flood")
    return out.drop("ts", "user_id")


@query(
    "p4_label_by_address",
    f"SELECT flow_id, IPV4_SRC_ADDR, CASE WHEN IPV4_SRC_ADDR = '10.0.0.7' THEN 'Dos_TCP_Flood' ELSE 'Benign' END AS Attack FROM ({FLOWS}) q",
)
def _label_by_address(spark, sf_dir):
    out = prepare.label_by_address(flows(spark, sf_dir), "10.0.0.7", "Dos_TCP_Flood")
    return out.select("flow_id", "IPV4_SRC_ADDR", "Attack")


@query(
    "p4_label_by_address_table",
    f"""SELECT f.flow_id, f.IPV4_SRC_ADDR, coalesce(t.label, 'Benign') AS Attack FROM ({FLOWS}) f
    LEFT JOIN (SELECT DISTINCT concat('10.0.0.', CAST(user_id AS STRING)) AS address,
      CASE WHEN user_id % 2 = 0 THEN 'Dos_TCP_Flood' ELSE 'Dos_UDP_flood' END AS label
      FROM events WHERE user_id % 5 = 0) t ON f.IPV4_SRC_ADDR = t.address""",
)
def _label_by_address_table(spark, sf_dir):
    f = flows(spark, sf_dir)
    bad = f.filter("user_id % 5 = 0").select(
        F.col("IPV4_SRC_ADDR").alias("address"),
        F.when(F.col("user_id") % 2 == 0, "Dos_TCP_Flood").otherwise("Dos_UDP_flood").alias("label"),
    ).distinct()
    return prepare.label_by_addresses(f, bad).select("flow_id", "IPV4_SRC_ADDR", "Attack")


@query(
    "p5_model_rows",
    f"""SELECT flow_id, IN_PKTS, OUT_PKTS, IN_BYTES, OUT_BYTES, FLOW_DURATION_MILLISECONDS, L4_SRC_PORT,
    L4_DST_PORT, PROTOCOL, CASE WHEN L7_PROTO IN ('error', 'view') THEN 'Unknown' ELSE L7_PROTO END AS L7_PROTO,
    TCP_FLAGS FROM ({FLOWS}) q""",
)
def _model_rows(spark, sf_dir):
    raw = raw_flows(spark, sf_dir)
    app = F.col("application_name")
    gaps = raw.withColumn(
        "application_name", F.when(app == "error", "").when(app == "view", None).otherwise(app)
    )
    return prepare.to_model_rows(gaps, keep=["flow_id"])


@query(
    "p6_project_spec",
    f"SELECT flow_id, {', '.join(NFV1.features)}, Attack FROM ({FLOWS}) q",
)
def _project_spec(spark, sf_dir):
    return prepare.project_spec(flows(spark, sf_dir), NFV1, keep=["flow_id"])


FILL_PARAMS = FittedParams(
    {f: NumericParams(0.0, 1.0) for f in NFV1.numerical},
    {
        "L4_SRC_PORT": CategoricalParams((1030, 1031), 2), "L4_DST_PORT": CategoricalParams((80, 443), 2),
        "PROTOCOL": CategoricalParams((6, 17), 2), "L7_PROTO": CategoricalParams(("click", "view"), 2),
        "TCP_FLAGS": CategoricalParams((), 0),
    },
)


@query(
    "p7_fill_missing",
    f"""SELECT flow_id, CASE WHEN flow_id % 7 = 0 THEN 0.0 ELSE CAST(IN_PKTS AS DOUBLE) END AS IN_PKTS,
    CASE WHEN flow_id % 11 = 0 THEN 0.0 ELSE CAST(OUT_BYTES AS DOUBLE) END AS OUT_BYTES,
    CASE WHEN flow_id % 3 = 0 THEN 'click' ELSE L7_PROTO END AS L7_PROTO,
    CASE WHEN flow_id % 4 = 0 THEN 6 ELSE PROTOCOL END AS PROTOCOL, 0 AS TCP_FLAGS FROM ({FLOWS}) q""",
)
def _fill_missing(spark, sf_dir):
    f = flows(spark, sf_dir)
    i = F.col("flow_id")
    gaps = f.withColumns({
        "IN_PKTS": F.when(i % 7 != 0, F.col("IN_PKTS")),
        "OUT_BYTES": F.when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.col("OUT_BYTES").cast("double")),
        "L7_PROTO": F.when(i % 3 != 0, F.col("L7_PROTO")),
        "PROTOCOL": F.when(i % 4 != 0, F.col("PROTOCOL")),
    }).drop("TCP_FLAGS")
    out = prepare.fill_missing(gaps, FILL_PARAMS)
    return out.select("flow_id", "IN_PKTS", "OUT_BYTES", "L7_PROTO", "PROTOCOL", "TCP_FLAGS")


@query(
    "p8_keyword_filter",
    "SELECT doc_id, lang, source FROM documents WHERE NOT (CAST(doc_id AS VARCHAR) LIKE '%99%' OR coalesce(text LIKE '%99%', false) "
    "OR coalesce(lang LIKE '%99%', false) OR coalesce(source LIKE '%99%', false) OR CAST(n_chars AS VARCHAR) LIKE '%99%' "
    "OR coalesce(text LIKE '%SSH%', false) OR coalesce(lang LIKE '%SSH%', false) OR coalesce(source LIKE '%SSH%', false))",
)
def _keyword_filter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return prepare.drop_rows_containing(docs, "99", "SSH").select("doc_id", "lang", "source")


def holds_sql(keyword: str) -> str:
    texts = [c for c in FLOW_COLUMNS if c != "ts"]
    return " OR ".join(f"coalesce(CAST({c} AS VARCHAR) LIKE '%{keyword}%', false)" for c in texts)


# every column of the flow view but the time, whose text differs between engines
FLOW_COLUMNS = ["flow_id", *[part.split()[0] for part in NFV1_SCHEMA.split(", ")], "user_id"]


@query("p8_keyword_filter_flows", f"SELECT {', '.join(FLOW_COLUMNS)} FROM ({FLOWS}) r WHERE NOT ({holds_sql('view')} OR {holds_sql('.77')})")
def _keyword_filter_flows(spark, sf_dir):
    return prepare.drop_rows_containing(flows(spark, sf_dir).select(*FLOW_COLUMNS), "view", ".77")


@query("p9_first_rows", f"SELECT flow_id, L4_SRC_PORT, Attack FROM ({FLOWS}) q ORDER BY ts, flow_id LIMIT 300")
def _first_rows(spark, sf_dir):
    return first_rows(flows(spark, sf_dir), ORDER, 300).select("flow_id", "L4_SRC_PORT", "Attack")


@query(
    "p9_first_rows_by_index",
    f"SELECT flow_id, L4_SRC_PORT, Attack FROM ({INDEXED}) q WHERE idx < 700",
)
def _first_rows_by_index(spark, sf_dir):
    out = first_rows(flows(spark, sf_dir), ORDER, 700, index_above=0)
    return out.select("flow_id", "L4_SRC_PORT", "Attack")


@query(
    "p10_clean_numbers",
    f"""SELECT flow_id, CASE WHEN flow_id % 9 = 0 OR abs(OUT_BYTES) > 1500 THEN 0.0 ELSE CAST(OUT_BYTES AS DOUBLE) END AS OUT_BYTES,
    CASE WHEN flow_id % 10 IN (0, 1) THEN 0.0 ELSE CAST(-IN_BYTES AS DOUBLE) * CASE WHEN IN_BYTES > 1500 THEN 0 ELSE 1 END END AS IN_BYTES
    FROM ({FLOWS}) q""",
)
def _clean_numbers(spark, sf_dir):
    i, nan, inf = F.col("flow_id"), F.lit(float("nan")), F.lit(float("inf"))
    f = flows(spark, sf_dir).withColumns({
        "OUT_BYTES": F.when(i % 9 == 0, nan).otherwise(F.col("OUT_BYTES").cast("double")),
        "IN_BYTES": F.when(i % 10 == 0, -inf).when(i % 10 == 1, F.lit(None)).otherwise(-F.col("IN_BYTES").cast("double")),
    })
    out = prepare.clean_numericals(f, ["OUT_BYTES", "IN_BYTES"], 1500.0)
    # -0.0 and 0.0 are one value
    return out.select("flow_id", "OUT_BYTES", (F.col("IN_BYTES") + 0.0).alias("IN_BYTES"))


# -- statistics --------------------------------------------------------------------------------
@query(
    "g1_label_distribution",
    f"SELECT Attack, count(*) AS n_rows, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM ({FLOWS}) q GROUP BY Attack",
)
def _label_distribution(spark, sf_dir):
    out = stats.label_distribution(flows(spark, sf_dir))
    return out.withColumn("percent", F.round("percent", 6))


@query(
    "g2_fit_numeric",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) - min({f}) AS DOUBLE) AS range FROM ({FLOWS}) q"
        for f in NFV1.numerical
    ),
)
def _fit_numeric(spark, sf_dir):
    return stats.fit_numeric(flows(spark, sf_dir), NFV1.numerical)


@query(
    "g2_fit_numeric_training",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) - min({f}) AS DOUBLE) AS range FROM ({INDEXED}) q "
        "WHERE idx < (SELECT count(*) - CAST(floor(count(*) * 0.2) AS BIGINT) FROM events)"
        for f in NFV1.numerical
    ),
)
def _fit_numeric_training(spark, sf_dir):
    from flowspark.operators.split import split_last_rows

    rows = split_last_rows(indexed_flows(spark, sf_dir), 0.2)
    return stats.fit_numeric(rows, NFV1.numerical, F.col("training"))


def levels_sql(caps: dict[str, int], default: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(v AS VARCHAR) AS level, n, r AS rank FROM (SELECT {f} AS v, count(*) AS n, "
        f"CAST(row_number() OVER (ORDER BY count(*) DESC, {f}) AS INT) AS r FROM ({FLOWS}) q GROUP BY {f}) g WHERE r <= {caps.get(f, default)}"
        for f in NFV1.categorical
    )


@query("g3_fit_levels", levels_sql({}, 32))
def _fit_levels(spark, sf_dir):
    return stats.fit_categorical(flows(spark, sf_dir), NFV1.categorical).drop("level_type")


@query("g4_fit_levels_fixed_caps", levels_sql(stats.FIXED_LEVEL_CAPS, 32))
def _fit_levels_fixed(spark, sf_dir):
    out = stats.fit_categorical(flows(spark, sf_dir), NFV1.categorical, caps=stats.FIXED_LEVEL_CAPS)
    return out.drop("level_type")


@query(
    "g5_class_lists",
    f"""SELECT class, first_idx, CAST(row_number() OVER (ORDER BY first_idx) - 1 AS INT) AS position, class <> 'Benign' AS is_attack
    FROM (SELECT Attack AS class, min(idx) AS first_idx FROM ({INDEXED}) q GROUP BY Attack) g""",
)
def _class_lists(spark, sf_dir):
    return stats.class_lists(indexed_flows(spark, sf_dir))


@query(
    "g6_label_codes",
    f"SELECT flow_id, Attack, CAST(dense_rank() OVER (ORDER BY Attack) - 1 AS INT) AS y FROM ({FLOWS}) q",
)
def _label_codes(spark, sf_dir):
    return stats.encode_labels(flows(spark, sf_dir)).select("flow_id", "Attack", "y")


@query(
    "g7_feature_statistics",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) AS n_values, CAST(min({f}) AS DOUBLE) AS min, CAST(max({f}) AS DOUBLE) AS max, "
        f"round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std, count(*) FILTER (WHERE {f} <> 0) AS non_zero FROM ({FLOWS}) q"
        for f in NFV1.numerical
    ),
)
def _feature_statistics(spark, sf_dir):
    out = stats.feature_statistics(flows(spark, sf_dir), NFV1.numerical)
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# -- flow assembly -----------------------------------------------------------------------------
GAP_S = 6 * 3600
ASSEMBLED = f"""
WITH k AS (SELECT *, CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_ip ELSE dst_ip END AS a_ip,
  CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_port ELSE dst_port END AS a_port,
  CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_ip ELSE src_ip END AS z_ip,
  CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN dst_port ELSE src_port END AS z_port,
  (CASE WHEN fin THEN 1 ELSE 0 END) + (CASE WHEN syn THEN 2 ELSE 0 END) + (CASE WHEN rst THEN 4 ELSE 0 END)
  + (CASE WHEN psh THEN 8 ELSE 0 END) + (CASE WHEN ack THEN 16 ELSE 0 END) + (CASE WHEN urg THEN 32 ELSE 0 END) AS bits,
  epoch_us(ts) AS us FROM ({PACKETS}) q),
g AS (SELECT *, lag(us) OVER w AS prev FROM k WINDOW w AS (PARTITION BY a_ip, a_port, z_ip, z_port, protocol ORDER BY us, packet_id)),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > {GAP_S * 1_000_000} THEN 1 ELSE 0 END)
  OVER (PARTITION BY a_ip, a_port, z_ip, z_port, protocol ORDER BY us, packet_id) AS n FROM g),
h AS (SELECT *, first_value(src_ip) OVER v AS s_ip, first_value(src_port) OVER v AS s_port FROM s
  WINDOW v AS (PARTITION BY a_ip, a_port, z_ip, z_port, protocol, n ORDER BY us, packet_id))
SELECT s_ip AS src_ip, s_port AS src_port,
 CASE WHEN s_ip = a_ip AND s_port = a_port THEN z_ip ELSE a_ip END AS dst_ip,
 CASE WHEN s_ip = a_ip AND s_port = a_port THEN z_port ELSE a_port END AS dst_port, protocol,
 count(*) FILTER (WHERE src_ip = s_ip AND src_port = s_port) AS src2dst_packets,
 CAST(coalesce(sum(bytes) FILTER (WHERE src_ip = s_ip AND src_port = s_port), 0) AS BIGINT) AS src2dst_bytes,
 count(*) FILTER (WHERE NOT (src_ip = s_ip AND src_port = s_port)) AS dst2src_packets,
 CAST(coalesce(sum(bytes) FILTER (WHERE NOT (src_ip = s_ip AND src_port = s_port)), 0) AS BIGINT) AS dst2src_bytes,
 (max(us) - min(us)) // 1000 AS bidirectional_duration_ms, min(us) AS first_us, bit_or(bits) AS tcp_flags
FROM h GROUP BY s_ip, s_port, a_ip, a_port, z_ip, z_port, protocol, n
"""


def comparable(flow_df):
    return flow_df.withColumn("first_us", F.unix_micros("first_seen")).withColumnRenamed(
        "udps.tcp_flags", "tcp_flags"
    ).drop("application_name", "first_seen")


@query("a1_a2_assemble_flows", ASSEMBLED)
def _assemble_flows(spark, sf_dir):
    return comparable(assemble_flows(packets(spark, sf_dir), GAP_S))
