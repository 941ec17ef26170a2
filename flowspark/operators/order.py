"""Row positions at scale: global index, index inside groups, and exact "first m by hash".

None of these sends all rows, or all rows of one group, through a single task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from flowspark.session import (
    fetch_small, lookup_join, materialize, remove_path, scratch_path, small_table,
)

PART, POS = "_part", "_pos"
_POS_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id


@dataclass(frozen=True)
class OrderedRows:
    """Rows range-partitioned and sorted by ``order``.

    ``rows`` carries ``_part`` and ``_pos``; ``first_idx`` holds the global position of the first
    row of each non-empty part, ``n`` the number of rows, and ``per_part`` any further aggregates.
    """

    rows: DataFrame
    order: list[str]
    first_idx: dict[int, int]
    n: int
    per_part: dict[int, dict]
    path: str

    def release(self) -> None:
        """Delete the written rows once nothing reads them any more."""
        remove_path(self.rows.sparkSession, self.path)

    def __enter__(self) -> OrderedRows:
        return self

    def __exit__(self, *failure: object) -> None:
        self.release()

    def part_table(self, values: dict[int, object], name: str, dtype: str) -> DataFrame:
        """A lookup table with one value per part."""
        return small_table(self.rows.sparkSession, sorted(values.items()), f"{PART} INT, {name} {dtype}")

    def indexed(self, idx: str = "idx") -> DataFrame:
        offsets = self.part_table(self.first_idx, "_first", "BIGINT")
        joined = self.rows.join(F.broadcast(offsets), PART)
        return joined.withColumn(idx, F.col("_first") + F.col(POS)).drop("_first")


# Estimated input bytes per range of a global sort. Spark samples at most a million order keys, so beyond
# some ten thousand ranges they become less even, by about the root of ranges / million.
PART_BYTES = 256 * 1024 * 1024


def input_bytes(df: DataFrame) -> int | None:
    """Estimated bytes that the plan reads: the sum over its leaves, whatever is joined on top."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        size = int(str(leaves.next().stats().sizeInBytes()))
        if size >= 1 << 60:
            return None
        total += size
    return total


def parts_for(df: DataFrame) -> int:
    """One range per core, or more when the size of the input asks for it."""
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fewest = min(configured, spark.sparkContext.defaultParallelism)
    size = input_bytes(df)
    return configured if size is None else max(fewest, -(-size // PART_BYTES))


def order_rows(
    df: DataFrame, order: list[str], partitions: int | None = None,
    per_part: list[Column] | None = None,
) -> OrderedRows:
    """Sort globally with one range shuffle and write the result to the shared folder.

    Range bounds come from a sample of the full ``order`` tuple, so parts stay even however skewed
    its leading column is; the tuple must be unique. One row per part goes to the driver, with the
    aggregates in ``per_part``.
    """
    n_parts = partitions or parts_for(df)
    placed = (
        df.repartitionByRange(n_parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)))
    )
    path = scratch_path(df.sparkSession, "ordered")
    rows = materialize(placed, "ordered", path)
    found = rows.groupBy(PART).agg(F.count("*").alias("n"), *(per_part or [])).collect()
    sizes = sorted(found, key=lambda r: r[PART])
    ends = list(accumulate(r["n"] for r in sizes))
    first_idx = {r[PART]: end - r["n"] for r, end in zip(sizes, ends)}
    extras = {r[PART]: r.asDict() for r in sizes}
    return OrderedRows(rows, list(order), first_idx, ends[-1] if ends else 0, extras, path)


def index_rows(
    df: DataFrame, order: list[str], idx: str = "idx", partitions: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``."""
    return order_rows(df, order, partitions).indexed(idx).drop(PART, POS)


def index_and_count(df: DataFrame, order: list[str], idx: str = "idx") -> tuple[DataFrame, int]:
    """``index_rows`` and the number of rows, which the index knows."""
    ordered = order_rows(df, order)
    return ordered.indexed(idx).drop(PART, POS), ordered.n


def rank_rows(df: DataFrame, order: list[str], idx: str) -> DataFrame:
    """``index_rows`` for a table that is usually tiny (classes, labels): ranked locally when it
    is, by range otherwise."""
    small = fetch_small(df)
    if small is None:
        return index_rows(df, order, idx)
    return small.withColumn(idx, F.row_number().over(W.Window.orderBy(*order)).cast("bigint") - 1)


def index_in_groups(
    df: DataFrame, groups: list[str], order: list[str], pos: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row inside its group.

    The global index over (group, order) minus the group's first index: a group may span many
    tasks, so a hot one costs no more than its share of rows.
    """
    ordered = index_rows(df, [*groups, *order], "_gidx")
    starts = ordered.groupBy(*groups).agg(F.min("_gidx").alias("_start"))
    joined = lookup_join(ordered, starts, groups)
    return joined.withColumn(pos, F.col("_gidx") - F.col("_start")).drop("_gidx", "_start")


# Rows of the index that one step of ``subset_positions`` numbers together.
SUBSET_CHUNK = 1 << 16


def subset_positions(
    df: DataFrame, groups: list[str], idx: str = "idx", pos: str = "pos"
) -> DataFrame:
    """The 0-based position of each row among the rows of its group, in index order, for a table that
    has been indexed already and then filtered.

    Rows are counted per group and chunk of the index; a row's position is the count of the chunks
    before plus its rank in the chunk. No new sort of the table, and no group meets in one task.
    """
    chunk = F.floor(F.col(idx) / SUBSET_CHUNK)
    chunked = df.withColumn("_chunk", chunk)
    lead = W.Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    before = (
        chunked.groupBy(*groups, "_chunk").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(lead), F.lit(0))).drop("_n")
    )
    inside = F.row_number().over(W.Window.partitionBy(*groups, "_chunk").orderBy(idx)) - 1
    ranked = chunked.withColumn("_in", inside)
    joined = lookup_join(ranked, before, [*groups, "_chunk"])
    return joined.withColumn(pos, F.col("_before") + F.col("_in")).drop("_chunk", "_in", "_before")


def rows_at_positions(
    df: DataFrame, wanted: DataFrame, groups: list[str], idx: str = "idx", pos: str = "pos"
) -> DataFrame:
    """``wanted`` (the groups, pos and others) with the ``idx`` of the row at each position of its group, where
    positions are those of ``subset_positions``.

    Counts per group and chunk of the index tell the chunk that holds a position; only the rows of these
    chunks are numbered, so a few positions of a large table cost one pass of counting.
    """
    chunked = df.select(*groups, idx, F.floor(F.col(idx) / SUBSET_CHUNK).alias("_chunk"))
    in_group = W.Window.partitionBy(*groups)
    lead = in_group.orderBy("_chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = chunked.groupBy(*groups, "_chunk").agg(F.count("*").alias("_n")).select(
        *groups, F.coalesce(F.sum("_n").over(lead), F.lit(0)).alias(pos), F.lit(0).alias("_asks"), "_chunk"
    )
    asked = wanted.select(*groups, F.col(pos).cast("bigint").alias(pos), F.lit(1).alias("_asks")).distinct()
    # the last chunk that starts at the position or before; chunks and positions asked for are few
    upto = in_group.orderBy(pos, "_asks").rowsBetween(W.Window.unboundedPreceding, 0)
    begun = F.when(F.col("_asks") == 0, F.struct(F.col("_chunk").alias("c"), F.col(pos).alias("before")))
    needed = (
        starts.unionByName(asked, allowMissingColumns=True).withColumn("_at", F.last(begun, True).over(upto))
        .filter("_asks = 1 AND _at IS NOT NULL")
        .select(*groups, F.col("_at.c").alias("_chunk"), F.col("_at.before").alias("_before")).distinct()
    )
    held = lookup_join(chunked, needed, [*groups, "_chunk"]).filter("_before IS NOT NULL")
    inside = F.row_number().over(W.Window.partitionBy(*groups, "_chunk").orderBy(idx)) - 1
    numbered = held.select(*groups, idx, (F.col("_before") + inside).alias(pos))
    return numbered.join(wanted, [*groups, pos])


def hash_key(col, seed: int):
    """Seeded random-looking order key of an id: lower-case md5 hex, equal in every engine."""
    col = F.col(col) if isinstance(col, str) else col
    return F.md5(F.concat(F.lit(f"{seed}-"), col.cast("string")).cast("binary"))


def flag_first_by_hash(
    df: DataFrame, id_col: str, seed: int, quota: int | dict | Callable[[dict], dict],
    group: str | None = None, where: Column | None = None, flag: str = "picked",
    prefix_digits: int = 4,
) -> DataFrame:
    """Flag exactly ``quota`` rows (per value of ``group`` if ``quota`` is a dict): the first ones by
    (hash of id, id) among the rows satisfying ``where``. Ids must be unique. A function as ``quota``
    gets the number of rows per group.

    Counts per hash prefix locate the prefix that holds the last flagged row, longer prefixes are counted
    inside it until few rows share one; only that sliver is ranked, which yields a threshold per group. Flagging itself is a map-only comparison, so the
    table is never shuffled.
    """
    where = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    label = F.col(group).cast("string") if group else F.lit("all")
    keyed = df.filter(where).select(
        label.alias("_g"), hash_key(id_col, seed).alias("_h"), F.col(id_col).alias("_id")
    )
    if isinstance(quota, dict):
        keyed = keyed.filter(F.col("_g").isin([str(k) for k in quota]))
    prefix = F.substring("_h", 1, prefix_digits)
    counts = keyed.groupBy("_g", prefix.alias("_b")).agg(F.count("*").alias("_n"))
    scratch = scratch_path(df.sparkSession, "prefixes")
    if callable(quota):
        # one scan for the totals and the prefixes
        counts = materialize(counts, "prefixes", scratch)
        totals = counts.groupBy("_g").agg(F.sum("_n").alias("n")).collect()
        quota = quota({r["_g"]: r["n"] for r in totals})
    quotas = {str(k): int(v) for k, v in quota.items()} if isinstance(quota, dict) else {"all": int(quota)}

    thresholds = _hash_thresholds(keyed, counts, prefix_digits, {g: m for g, m in quotas.items() if m > 0})
    remove_path(df.sparkSession, scratch)
    # groups without a threshold have fewer rows than their quota: all are taken
    full = [g for g, m in quotas.items() if m > 0 and g not in thresholds]
    limit, limit_id = F.lit(None).cast("string"), F.lit(None).cast(dict(df.dtypes)[id_col])
    for g, (h, i) in thresholds.items():
        limit = F.when(F.col("_g") == g, F.lit(h)).otherwise(limit)
        limit_id = F.when(F.col("_g") == g, F.lit(i)).otherwise(limit_id)
    below = (F.col("_h") < limit) | ((F.col("_h") == limit) & (F.col(id_col) <= limit_id))
    picked = where & F.coalesce(below | F.col("_g").isin(full), F.lit(False))
    hashed = df.withColumns({"_h": hash_key(id_col, seed), "_g": label})
    return hashed.withColumn(flag, picked).drop("_h", "_g")


# Most rows of a group that are ranked to find its threshold.
SLIVER_ROWS = 1_000_000


def _hash_thresholds(
    keyed: DataFrame, counts: DataFrame, digits: int, quotas: dict[str, int]
) -> dict[str, tuple]:
    """(hash, id) of the last row within the quota, per group that has so many rows."""
    spark = keyed.sparkSession
    upto = W.Window.partitionBy("_g").orderBy("_b").rowsBetween(W.Window.unboundedPreceding, 0)
    need = quotas
    while True:
        wanted = F.broadcast(small_table(spark, list(need.items()), "_g STRING, _m BIGINT"))
        cuts = (
            counts.join(wanted, "_g")
            .withColumn("_end", F.sum("_n").over(upto))
            # the prefix in which the m-th row falls
            .filter((F.col("_end") >= F.col("_m")) & (F.col("_end") - F.col("_n") < F.col("_m")))
            .select("_g", "_b", "_n", (F.col("_m") - F.col("_end") + F.col("_n")).alias("_need"))
        )
        found = [(r["_g"], r["_b"], r["_need"], r["_n"]) for r in cuts.collect()]
        if not found:
            return {}
        table = F.broadcast(small_table(spark, [f[:3] for f in found], "_g STRING, _b STRING, _need BIGINT"))
        slivers = keyed.withColumn("_b", F.substring("_h", 1, digits)).join(table, ["_g", "_b"])
        if max(f[3] for f in found) <= SLIVER_ROWS or digits >= 32:
            break
        digits = min(32, digits + 4)
        need = {f[0]: f[2] for f in found}
        counts = slivers.groupBy("_g", F.substring("_h", 1, digits).alias("_b")).agg(F.count("*").alias("_n"))
    by_hash = W.Window.partitionBy("_g", "_b").orderBy("_h", "_id")
    ranked = slivers.withColumn("_rank", F.row_number().over(by_hash))
    last = ranked.filter(F.col("_rank") == F.col("_need")).select("_g", "_h", "_id").collect()
    return {r["_g"]: (r["_h"], r["_id"]) for r in last}


def first_rows(df: DataFrame, order: list[str], n: int, index_above: int = 100_000) -> DataFrame:
    """The first ``n`` rows in ``order``: a top-n for small n, the global index for large n."""
    if n <= index_above:
        return df.orderBy(*order).limit(n)
    return index_rows(df, order, "_idx").filter(F.col("_idx") < n).drop("_idx")


def shuffle_rows(df: DataFrame, id_col: str, seed: int, idx: str = "idx") -> DataFrame:
    """A seeded random order, written as a row index."""
    keyed = df.withColumn("_hash", hash_key(id_col, seed))
    return index_rows(keyed, ["_hash", id_col], idx).drop("_hash")
