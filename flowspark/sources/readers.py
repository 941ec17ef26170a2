"""Flow sources: files and streams, always with a declared schema."""

from __future__ import annotations

import logging
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.numeric import quoted
from flowspark.operators.order import first_rows
from flowspark.schemas import NFV1_SCHEMA
from flowspark.session import lookup_join, path_exists, small_table
from flowspark.specs import DatasetSpec

log = logging.getLogger(__name__)

# Position of a row in a set of files: name, offset of its block, row within the block.
FILE_ORDER = ["_file", "_block", "_row"]


def _with_file_order(df: DataFrame) -> DataFrame:
    # rows of one block are read in order by one task, so their ids increase with position
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def read_flows(
    spark: SparkSession, path: str, n_rows: int | None = None, schema: str = NFV1_SCHEMA,
    file_order: bool = False,
) -> DataFrame:
    """Flow CSV with a header; the first ``n_rows`` in file order on demand."""
    df = spark.read.schema(schema).csv(path, header=True)
    if n_rows is None and not file_order:
        return df
    if n_rows is not None and n_rows > 0:
        df = spark.read.schema(schema).csv(_first_files(spark, df, schema, n_rows), header=True)
    placed = _with_file_order(df)
    if n_rows is not None and n_rows > 0:
        placed = first_rows(placed, FILE_ORDER, n_rows)
    return placed if file_order else placed.drop(*FILE_ORDER)


def _first_files(spark: SparkSession, df: DataFrame, schema: str, n_rows: int) -> list[str]:
    """The files that hold the first ``n_rows`` rows: files in name order are counted, twice as many at
    each step, until they have enough."""
    files = sorted(df.inputFiles())
    found, step = 0, 1
    at = 0
    while at < len(files) and found < n_rows:
        found += spark.read.schema(schema).csv(files[at : at + step], header=True).count()
        at, step = at + step, step * 2
    return files[:at] or files


def read_glob(
    spark: SparkSession, pattern: str, schema: str = NFV1_SCHEMA
) -> DataFrame:
    """All CSV files matching a pattern; ``FILE_ORDER`` columns give the order by file name."""
    try:
        return _with_file_order(spark.read.schema(schema).csv(pattern, header=True))
    except AnalysisException as e:
        raise FileNotFoundError(f"no file matches {pattern}") from e


def read_columns(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """Only the features and the class of a Parquet or ORC table; another suffix is an error."""
    for fmt in ("parquet", "orc"):
        if path.rstrip("/").lower().endswith(f".{fmt}"):
            names = dict.fromkeys([*spec.include_fields, spec.class_column])
            return spark.read.format(fmt).load(path).select(*[quoted(n) for n in names])
    raise ValueError(f"unrecognised file type: {path}")


def read_labelled(
    spark: SparkSession, files: list[tuple[str, str]], fmt: str = "parquet",
    schema: str = NFV1_SCHEMA, label_column: str = "Attack", **options: str,
) -> DataFrame:
    """Union of files, each with its own label. Missing files are reported and left out, and so are files,
    or the parts of them, that cannot be read, wherever the damage is.

    All files are read by one scan; labels are looked up by the file's path.
    """
    labels: dict[str, str] = {}
    there = []
    for path, label in files:
        if not path_exists(spark, path):
            log.warning("no such file, skipped: %s", path)
            continue
        there.append(path)
        labels[spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/")] = label
    if not labels:
        raise ValueError("none of the files could be read")
    df = (
        spark.read.schema(schema).format(fmt).options(**options)
        .option("ignoreCorruptFiles", "true").load(there)
    )
    # the given path is the file or a folder above it, the longest one if several fit; scheme and host are left out
    where = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-zA-Z0-9]+:(//[^/]*)?", "")
    table = []
    for uri in df.inputFiles():
        path = re.sub("^[a-zA-Z0-9]+:(//[^/]*)?", "", unquote(uri))
        above = path
        while above not in labels:
            above = above.rsplit("/", 1)[0]
        table.append((path, labels[above]))
    by_file = small_table(spark, table, f"_path STRING, `{label_column}` STRING")
    placed = df.select("*", where.alias("_path"))
    names = [quoted(c) for c in df.columns if c != label_column]
    out = lookup_join(placed.select(*names, "_path"), by_file, ["_path"]).select(*names, quoted(label_column), "_path")
    held = {r[0] for r in out.groupBy(label_column, "_path").count().select("_path").collect()}
    for path in labels:
        if not any(h == path or h.startswith(f"{path}/") for h in held):
            log.warning("no rows could be read from %s", path)
    if not held:
        raise ValueError("none of the files could be read")
    return out.drop("_path")


def stream_records(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A live source: records arriving as files in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """A live source: JSON records on a Kafka topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
