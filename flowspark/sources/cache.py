"""Reuse of preprocessed tables across runs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def identifier(settings: dict) -> str:
    """A name for a set of settings: the first 40 hex digits of a digest of their sorted JSON. Entries
    are only ever read by this library."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:40]


def cache_key(dataset: str, n_rows: int, preprocessing: dict, local: dict) -> str:
    return f"{dataset}_{n_rows}_{identifier(preprocessing)}_{identifier(local)}"


def cached(
    spark: SparkSession, folder: str, key: str, build: Callable[[], tuple[DataFrame, str]]
) -> tuple[DataFrame, str]:
    """The table and metadata text stored under ``key``; ``build`` runs only on a miss.

    The metadata is written last and marks a complete entry.
    """
    data, meta = f"{folder}/{key}", f"{folder}/{key}.metadata"
    try:
        text = spark.read.text(meta, wholetext=True).first()["value"]
        return spark.read.parquet(data), text.removesuffix("\n")
    except AnalysisException:
        pass
    df, text = build()
    df.write.mode("overwrite").parquet(data)
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(meta)
    return spark.read.parquet(data), text
