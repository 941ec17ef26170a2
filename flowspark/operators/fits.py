"""Fits that are kept per part of the data (a day, a file) and merged, so that a new part does not rescan the old ones."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.functions.numeric import NUMERIC_FILTER, clean_numeric, quoted
from flowspark.operators.stats import count_levels, params_rows, rank_levels
from flowspark.schemas import FittedParams, require_columns
from flowspark.session import path_exists, remove_path

NUMBERS = "feature STRING, lo DOUBLE, hi DOUBLE, n BIGINT, min DOUBLE, max DOUBLE, mean DOUBLE, squares DOUBLE, non_zero BIGINT"
LEVELS = "feature STRING, level_type STRING, level STRING, as_int BIGINT, as_float DOUBLE, n BIGINT"


def partial_numbers(df: DataFrame, features: list[str], limit: float = NUMERIC_FILTER) -> DataFrame:
    """What a part says about its numbers, one row per feature (``NUMBERS``): the range after cleaning, and count, extremes,
    mean, sum of squared deviations and non-zero count before it. One pass."""
    require_columns(df, features)
    measures = {}
    for i, f in enumerate(features):
        x, clean = quoted(f).cast("double"), clean_numeric(quoted(f), limit)
        found = {
            "lo": F.min(clean), "hi": F.max(clean), "n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x),
            "squares": F.var_pop(x) * F.count(x), "non_zero": F.count_if(x != 0),
        }
        measures |= {f"{m}_{i}": c for m, c in found.items()}
    wide = df.agg(*[c.alias(n) for n, c in measures.items()])
    names = [c.split()[0] for c in NUMBERS.split(", ")][1:]
    entries = [F.struct(F.lit(f).alias("feature"), *[F.col(f"{m}_{i}").alias(m) for m in names]) for i, f in enumerate(features)]
    return wide.select(F.inline(F.array(*entries)))


def merge_ranges(numbers: DataFrame) -> DataFrame:
    """(feature, min, range) over all parts, as ``fit_numeric`` gives."""
    return numbers.groupBy("feature").agg(F.min("lo").alias("min"), (F.max("hi") - F.min("lo")).alias("range"))


def merge_statistics(numbers: DataFrame) -> DataFrame:
    """``feature_statistics`` over all parts: deviations are taken from the common mean, so no digits are lost to large means."""
    total = F.sum("n").over(Window.partitionBy("feature"))
    centred = numbers.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy("feature")) / total)
    shift = F.col("mean") - F.col("_mean")
    squares = F.sum(F.col("squares") + F.col("n") * shift * shift)
    return centred.groupBy("feature").agg(
        F.sum("n").alias("n_values"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("_mean").alias("mean"),
        F.sqrt(squares / F.sum("n")).alias("std"), F.sum("non_zero").alias("non_zero"),
    )


def merge_levels(levels: DataFrame) -> DataFrame:
    """Counted levels of all parts, as ``count_levels`` gives."""
    keys = ["feature", "level_type", "level", "as_int", "as_float"]
    return levels.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, "n")


class FitStore:
    """Fits of parts below ``path``. ``add`` reads the rows of its part only; everything else reads what was kept, which is
    one row per number and one per level that occurs, for each part.

    A part that is added again replaces itself. A part counts once it is whole: its numbers are written last. Columns
    keep their type from part to part; a categorical feature with another one is refused when parts are merged.
    """

    def __init__(self, spark: SparkSession, path: str, numerical: list[str], categorical: list[str], limit: float = NUMERIC_FILTER):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), limit
        self.numerical, self.categorical = list(numerical), list(categorical)

    def add(self, part: str, rows: DataFrame) -> None:
        home = f"{self.path}/{quote(part, safe='')}"
        remove_path(self.spark, f"{home}/numbers")
        count_levels(rows, self.categorical).write.mode("overwrite").parquet(f"{home}/levels")
        partial_numbers(rows, self.numerical, self.limit).write.mode("overwrite").parquet(f"{home}/numbers")

    def remove(self, part: str) -> None:
        remove_path(self.spark, f"{self.path}/{quote(part, safe='')}")

    def parts(self) -> list[str]:
        """Names of the parts that are whole."""
        home = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(home):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(home))
        return [unquote(n) for n in names if path_exists(self.spark, f"{self.path}/{n}/numbers/_SUCCESS")]

    def _kept(self, table: str, schema: str, parts: list[str] | None) -> DataFrame:
        there = self.parts()
        missing = set(parts or []) - set(there)
        if missing:
            raise ValueError(f"parts that were not added: {sorted(missing)}")
        chosen = there if parts is None else parts
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{quote(p, safe='')}/{table}" for p in chosen])

    def numbers(self, parts: list[str] | None = None) -> DataFrame:
        return self._kept("numbers", NUMBERS, parts).filter(F.col("feature").isin(self.numerical))

    def levels(self, parts: list[str] | None = None) -> DataFrame:
        """All levels with their counts over the chosen parts (all without a choice)."""
        return merge_levels(self._kept("levels", LEVELS, parts).filter(F.col("feature").isin(self.categorical)))

    def ranked_levels(self, top_k: int = 32, caps: dict[str, int] | None = None, parts: list[str] | None = None) -> DataFrame:
        wanted = {f: k for f, k in (caps or {}).items() if f in self.categorical}
        return rank_levels(self.levels(parts), wanted, top_k)

    def statistics(self, parts: list[str] | None = None) -> DataFrame:
        return merge_statistics(self.numbers(parts))

    def params(self, top_k: int = 32, caps: dict[str, int] | None = None, parts: list[str] | None = None, **settings) -> FittedParams:
        """Fitted parameters over the chosen parts; at most features x ``top_k`` values come to the driver."""
        rows = params_rows(merge_ranges(self.numbers(parts)), self.ranked_levels(top_k, caps, parts)).collect()
        kinds = [r["feature"] for r in rows]
        twice = sorted({f for f in kinds if kinds.count(f) > 1})
        if twice:
            raise ValueError(f"features whose type differs between parts: {twice}")
        found = FittedParams.from_rows(rows, top_k=top_k, **settings)
        return FittedParams(
            {f: found.numerical[f] for f in self.numerical if f in found.numerical},
            {f: found.categorical[f] for f in self.categorical if f in found.categorical},
            found.window_size, top_k, found.clip_numerical,
        )
