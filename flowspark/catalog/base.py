"""Query registry and the SQL fragments shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.flows import FLOW_SQL, PACKET_SQL, flows
from flowspark.operators.order import index_rows
from flowspark.specs import NFV1

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

ORDER = ["ts", "flow_id"]
FLOWS = FLOW_SQL.replace("{events}", "events")
PACKETS = PACKET_SQL.replace("{events}", "events")
INDEXED = f"SELECT *, row_number() OVER (ORDER BY ts, flow_id) - 1 AS idx FROM ({FLOWS}) q"
WINDOW = 8


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def indexed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(flows(spark, sf_dir), ORDER)


def bits(vec: Column) -> Column:
    """A 0/1 vector as text, for comparison."""
    return F.array_join(F.transform(vec, lambda v: v.cast("int").cast("string")), "")


def micros(vec: Column) -> Column:
    """A numeric vector as comma-joined millionths, for comparison."""
    return F.array_join(
        F.transform(vec, lambda v: F.round(v.cast("double") * 1e6).cast("bigint").cast("string")), ","
    )


# -- SQL of the fitted encoding ----------------------------------------------------------------
def params_sql(source: str, where: str = "true") -> str:
    """CTEs ``p`` (min and range per number) and ``c_F`` (code per level) over ``source``."""
    aggs = ", ".join(
        f"CAST(min({f}) AS DOUBLE) AS lo_{f}, CAST(max({f}) - min({f}) AS DOUBLE) AS r_{f}"
        for f in NFV1.numerical
    )
    parts = [f"p AS (SELECT {aggs} FROM {source} WHERE {where})"]
    for f in NFV1.categorical:
        parts.append(
            f"c_{f} AS (SELECT v, c FROM (SELECT {f} AS v, row_number() OVER (ORDER BY count(*) DESC, {f}) AS c "
            f"FROM {source} WHERE {where} GROUP BY {f}) g WHERE c <= 32)"
        )
    return ", ".join(parts)


def encoded_sql(source: str, keep: list[str], unknown: int = 0) -> str:
    """SELECT of kept columns, scaled numbers and level codes; needs the CTEs of ``params_sql``."""
    cols = [f"s.{c}" for c in keep]
    for f in NFV1.numerical:
        cols.append(
            f"CASE WHEN r_{f} = 0 THEN 0.0 ELSE ln(greatest(s.{f} - lo_{f} + 1, 1)) / ln(r_{f} + 1) END AS {f}"
        )
    joins = ""
    for f in NFV1.categorical:
        cols.append(f"CAST(coalesce(c_{f}.c, {unknown}) AS INT) AS {f}")
        joins += f" LEFT JOIN c_{f} ON s.{f} = c_{f}.v"
    return f"SELECT {', '.join(cols)} FROM {source} s CROSS JOIN p{joins}"


def rounded_features_sql() -> str:
    return ", ".join(
        [f"round({f}, 6) AS {f}" for f in NFV1.numerical] + NFV1.categorical
    )


def rounded_features() -> list[Column]:
    return [F.round(f, 6).alias(f) for f in NFV1.numerical] + [F.col(f) for f in NFV1.categorical]


# -- score columns: fixed formulas of flow columns ----------------------------------------------
def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_id, Attack, score (attack probability) and scores (three class probabilities)."""
    raw = flows(spark, sf_dir).select(
        "flow_id", "Attack",
        (F.col("OUT_BYTES") / 1000.0).alias("s0"), (F.col("IN_PKTS") * 0.5).alias("s1"),
        (F.col("TCP_FLAGS") / 20.0).alias("s2"),
    )
    exps = raw.withColumn("t", F.greatest("s0", "s1", "s2")).select(
        "flow_id", "Attack", *[F.exp(F.col(f"s{i}") - F.col("t")).alias(f"e{i}") for i in range(3)]
    )
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return exps.withColumn("total", total).select(
        "flow_id", "Attack", F.array(*[F.col(f"e{i}") / F.col("total") for i in range(3)]).alias("scores")
    )


SCORED = f"""
SELECT flow_id, Attack, exp(s0 - t) / (exp(s0 - t) + exp(s1 - t) + exp(s2 - t)) AS p0,
 exp(s1 - t) / (exp(s0 - t) + exp(s1 - t) + exp(s2 - t)) AS p1,
 exp(s2 - t) / (exp(s0 - t) + exp(s1 - t) + exp(s2 - t)) AS p2
FROM (SELECT *, greatest(s0, s1, s2) AS t FROM
 (SELECT flow_id, Attack, CAST(OUT_BYTES AS DOUBLE) / 1000.0 AS s0, CAST(IN_PKTS AS DOUBLE) * 0.5 AS s1,
  CAST(TCP_FLAGS AS DOUBLE) / 20.0 AS s2 FROM ({FLOWS}) q) r) u
"""
CLASSES = ["Benign", "Dos_TCP_Flood", "Dos_UDP_flood"]
