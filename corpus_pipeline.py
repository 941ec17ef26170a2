"""Training corpus from ``documents``: five stages, each written before the next one reads it.

1. ``language``: texts without a language (no letters, or a score below 0.5) go.
2. ``near_duplicates``: of documents connected by five-word Jaccard similarity of 0.8, one stays.
3. ``decontaminate``: documents that hold 80 % of a benchmark item's five-word shingles go.
4. ``mixture``: sources are brought to their target weights; documents may be repeated or left out.
5. ``shards``: every row gets a shard and a place in it; equal texts stand together.

All stages but the last keep the columns of ``documents``. Rows with a null doc_id count as one document
each; of a component the row with the smallest doc_id stays, equal rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import decontaminate, language, mixing, ngram_join, sharding
from flowspark.llm.scratch import materialize

MIN_SCORE = 0.5
SHARDS = 40


def _aside(docs: DataFrame, needed: tuple[str, ...], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate`` on ``docs``, whose columns other than ``needed`` have private names meanwhile, so that
    none gives way to a column of the operator."""
    names = [c if c in needed else f"_doc{k}" for k, c in enumerate(docs.columns)]
    out = operate(docs.toDF(*names))
    return out.select(*[F.col(name).alias(c) for name, c in zip(names, docs.columns)])


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    known = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)
    return _aside(docs, ("doc_id", "text"), lambda rows: language.predict(rows, model).filter(known))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _aside(docs, ("doc_id", "text"), lambda rows: ngram_join.drop_similar(rows, size=5, percent=80))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _aside(docs, ("doc_id", "source", "text"), lambda rows: mixing.take_documents(mixing.mix(rows)))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, shards=SHARDS)


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mixture", mixture),
    ("shards", shards),
]

# language identification and label propagation are not expressible in SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
