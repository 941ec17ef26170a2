"""Flow and alert sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_csv(df: DataFrame, path: str, mode: str = "error", rows_per_file: int | None = None) -> None:
    """CSV with a header and no index; with ``rows_per_file`` a new file starts after so many rows."""
    writer = df.write.mode(mode).option("header", True)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def write_table(df: DataFrame, path: str, mode: str = "error", rows_per_file: int | None = None) -> None:
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def alerts(verdicts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Attack verdicts only, with the current (last) flow of the window context ``ctx``."""
    last = F.element_at("ctx", -1)
    return verdicts.filter("verdict.is_attack").select(
        *(keep or []),
        F.col("verdict.attack_type").alias("attack_type"),
        F.col("verdict.attack_probability").alias("attack_probability"),
        *[
            last[n].alias(n)
            for n in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "l7_proto")
        ],
    )
