"""Session helper, shared scratch tables, and size-checked lookups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows and bytes a table may have before it is no longer shipped to every executor.
MAX_LOOKUP_ROWS = 100_000
MAX_LOOKUP_BYTES = 64 * 1024 * 1024

_local_dirs: dict[str, str] = {}


def get_session(app: str = "flowspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # combine sessions of a hot conversation before the shuffle
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="flowspark-")
    return _local_dirs[app]


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/flowspark-{app}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete every scratch table made inside the scope at its end. Results that are still read later
    must be written elsewhere before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove_path(spark, path)


def read_text(path: str) -> str | None:
    """A small file, None if there is none. A path with a scheme is read through Hadoop's file systems."""
    if "://" not in path:
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read()
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if not path_exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def write_text(path: str, text: str) -> None:
    if "://" not in path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder (or ``path``) and read it back.

    Values that depend on physical placement (partition ids) are frozen by this, so a lost executor
    cannot change them, and later readers still prune columns and push filters down.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows as a local relation: no job runs to read it."""
    struct = T.StructType.fromDDL(schema)
    names = [f.name for f in struct.fields]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    arrow = pa.Table.from_arrays([pa.array(list(c)) if rows else pa.nulls(0) for c in columns], names=names)
    target = to_arrow_schema(struct)
    return spark.createDataFrame(arrow.cast(target), struct)


def fetch_small(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> DataFrame | None:
    """``df`` as a local relation, or None if it has more than ``max_rows`` rows or is too wide."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > MAX_LOOKUP_BYTES:
        return None
    return df.sparkSession.createDataFrame(table, df.schema)


def lookup_join(
    df: DataFrame, table: DataFrame, on: list[str], max_rows: int = MAX_LOOKUP_ROWS
) -> DataFrame:
    """Left join of a lookup table with unique keys; NULL keys match NULL keys.

    The table is broadcast after its size was checked. Beyond that it is an ordinary shuffle join,
    whose hot keys adaptive execution splits.
    """
    small = fetch_small(table, max_rows)
    right = F.broadcast(small) if small is not None else table
    for key in on:
        right = right.withColumnRenamed(key, f"_lk_{key}")
    cond = None
    for key in on:
        part = df[f"`{key}`"].eqNullSafe(right[f"`_lk_{key}`"])
        cond = part if cond is None else cond & part
    return df.join(right, cond, "left").drop(*[f"_lk_{k}" for k in on])


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder by ``materialize``."""
    app = spark.sparkContext.applicationId
    remove_path(spark, f"{shared_dir(spark)}/flowspark-{app}")
