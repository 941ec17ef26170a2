"""Flow and packet views over the generic ``events`` table used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The same text runs in Spark and in DuckDB.
FLOW_SQL = """
SELECT event_id AS flow_id, ts, user_id,
 concat('10.0.0.', CAST(user_id AS STRING)) AS IPV4_SRC_ADDR,
 CAST(1024 + user_id AS INT) AS L4_SRC_PORT,
 concat('10.1.0.', CAST(k AS STRING)) AS IPV4_DST_ADDR,
 CAST(CASE k % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 ELSE k END AS INT) AS L4_DST_PORT,
 CAST(CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS INT) AS PROTOCOL,
 CAST((k * 37) % 3000 AS BIGINT) AS FLOW_DURATION_MILLISECONDS,
 CAST(1 + k % 7 AS BIGINT) AS OUT_PKTS, CAST(floor(value * 10) AS BIGINT) AS OUT_BYTES,
 CAST(k % 5 AS BIGINT) AS IN_PKTS, CAST(floor(value * 4) AS BIGINT) AS IN_BYTES,
 event_type AS L7_PROTO, CAST((k * 5) % 64 AS INT) AS TCP_FLAGS,
 CASE WHEN value >= 80 THEN 'Dos_TCP_Flood' WHEN k < 10 THEN 'Dos_UDP_flood' ELSE 'Benign' END AS Attack
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

PACKET_SQL = """
SELECT event_id AS packet_id, ts,
 CASE WHEN event_id % 2 = 1 THEN b_ip ELSE a_ip END AS src_ip,
 CASE WHEN event_id % 2 = 1 THEN b_port ELSE a_port END AS src_port,
 CASE WHEN event_id % 2 = 1 THEN a_ip ELSE b_ip END AS dst_ip,
 CASE WHEN event_id % 2 = 1 THEN a_port ELSE b_port END AS dst_port,
 6 AS protocol, CAST(floor(value * 10) AS BIGINT) AS bytes,
 k % 2 = 1 AS syn, k % 3 = 1 AS ack, k % 5 = 1 AS fin, k % 7 = 1 AS rst, k % 11 = 1 AS psh,
 k % 13 = 1 AS urg
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  concat('10.0.0.', CAST(user_id AS STRING)) AS a_ip, CAST(1024 + user_id AS INT) AS a_port,
  '10.1.0.1' AS b_ip, 443 AS b_port FROM {events}) e
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, FLOW_SQL)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PACKET_SQL)


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        # stored without a time zone and read as UTC; streams and watermarks need an instant
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
        events = events.withColumn("ts", F.timestamp_micros(micros))
    return spark.sql(text.replace("{events}", "{e}"), e=events)
