"""Sharding (3): balanced label propagation.

Documents start in shards by hash. In each round the members of a group of linked documents are counted
by shard; the strongest shard with places left becomes the wish of all members in weaker ones (ties by a
hash of group and shard, so a group agrees). Wishes are granted under quotas: as many documents may go from shard i to j
as want to go from j to i, and the free places of j are shared among all that want them. Which ones
go is decided by a hash of document and round. A final deal makes the sizes exact: each shard keeps its
documents up to its capacity, linked ones first, and what is over fills the places left elsewhere.

Per round only counts by group and shard, and the shard-by-shard table of wishes, leave the joins; a group
with a third of all documents is counted before it is shuffled and fills several shards.

Results for odd input: a null text has 16 bytes, a null checksum and no links; rows with equal doc_id and
text move together but are dealt one by one; an empty table gives an empty result; other columns are kept
out.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.order import PART, POS, order_rows
from flowspark.llm.scratch import materialize
from flowspark.session import small_table

ROUNDS = 5


def _unit(*columns) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def propagate(linked: DataFrame, shards: int, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``linked`` (node columns, group, weight, shard) after the rounds.

    ``linked`` has one row per node with its group; ``weight`` is the number of rows the node stands for.
    """
    spark = linked.sparkSession
    linked = materialize(linked, "labels")
    keys = [c for c in linked.columns if c not in ("group", "weight", "shard")]
    strength = F.struct("n", F.xxhash64("group", "shard").alias("h"), "shard")
    for step in range(rounds):
        tally = materialize(linked.groupBy("group", "shard").agg(F.sum("weight").alias("n")), "tally")
        found = tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()
        load = [0] * shards
        for r in found:
            load[r["shard"]] = r["n"]
        # a group fills its strongest shard that has places left and leaves those that are stronger alone
        open_shards = [s for s in range(shards) if load[s] < capacity]
        best = F.max(F.when(F.col("shard").isin(open_shards), strength)).over(Window.partitionBy("group"))
        wishes = tally.withColumn("_best", best).filter(F.col("_best") > strength).select(
            F.col("group").alias("_g"), F.col("shard").alias("_s"), "n", F.col("_best.shard").alias("wish")
        )
        # at most shards * shards numbers
        moves = {(r["_s"], r["wish"]): r["n"] for r in wishes.groupBy("_s", "wish").agg(F.sum("n").alias("n")).collect()}
        if not moves:
            return linked
        wanted = [sum(n for (_, j), n in moves.items() if j == s) for s in range(shards)]
        share = []
        for (i, j), n in moves.items():
            swap = min(n, moves.get((j, i), 0))
            free = max(0, capacity - load[j]) * n / wanted[j]
            share.append((i, j, min(1.0, (swap + free) / n)))
        quotas = small_table(spark, share, "_s INT, wish INT, share DOUBLE")
        granted = wishes.drop("n").join(F.broadcast(quotas), ["_s", "wish"])
        moved = linked.join(
            granted, (linked["group"] == granted["_g"]) & (linked["shard"] == granted["_s"]), "left"
        ).withColumn(
            "shard", F.when(_unit(F.lit(step), *keys) < F.col("share"), F.col("wish")).otherwise(F.col("shard"))
        )
        linked = materialize(moved.select(*keys, "group", "weight", "shard"), "labels")
    return linked


def deal(rows: DataFrame, order: list[str], shards: int, n: int) -> DataFrame:
    """``rows`` with a wished ``shard`` in final ``shard`` and ``slot``; shard sizes differ by one at most.

    One distributed sort by shard and ``order`` gives every row its place; the rest is arithmetic on
    the counts per shard.
    """
    spark = rows.sparkSession
    found = order_rows(rows, ["shard", *order])
    placed = found.indexed("_idx").drop(PART, POS)
    count = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    sizes = [count.get(s, 0) for s in range(shards)]
    places = [n // shards + (s < n % shards) for s in range(shards)]
    kept = [min(a, b) for a, b in zip(sizes, places)]
    first = [0, *accumulate(sizes)]
    over = [0, *accumulate(a - k for a, k in zip(sizes, kept))]
    room = [0, *accumulate(p - k for p, k in zip(places, kept))]
    table = small_table(
        spark, [(s, first[s], kept[s], over[s]) for s in range(shards)],
        "shard INT, _first BIGINT, _kept BIGINT, _over BIGINT",
    )
    free = [(s, room[s], room[s + 1], kept[s]) for s in range(shards) if room[s + 1] > room[s]]
    pos = F.col("_idx") - F.col("_first")
    placed = placed.join(F.broadcast(table), "shard").withColumn(
        "_rest", F.when(pos >= F.col("_kept"), F.col("_over") + pos - F.col("_kept"))
    )
    # at most ``shards`` intervals of the free places
    to, slot = F.col("shard"), pos
    for s, low, high, k in free:
        here = (F.col("_rest") >= low) & (F.col("_rest") < high)
        to = F.when(here, F.lit(s)).otherwise(to)
        slot = F.when(here, F.col("_rest") - low + k).otherwise(slot)
    return placed.withColumns({"_to": to, "slot": slot}).drop("shard", "_idx", "_first", "_kept", "_over", "_rest").withColumnRenamed("_to", "shard")


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """doc_id, size (bytes of the text + 16), text_crc32, law, shard, slot, grown_shard and
    wished_shard (after the rounds, before the final deal) of every row; the law is ``rows``.

    Documents with equal texts are linked.
    """
    narrow = materialize(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
            F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("_text"),
        ).withColumn("_start", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_text"), F.lit(shards)).cast("int")),
        "narrow",
    )
    group = ["_text", "text_crc32", "size"]
    with_text = narrow.filter("text_crc32 IS NOT NULL")
    groups = with_text.groupBy(*group).agg(F.count("*").alias("members")).filter("members > 1").select(
        *group, F.xxhash64(*group).alias("group")
    )
    nodes = with_text.join(groups, group).groupBy("doc_id", *group, "group").agg(
        F.count("*").alias("weight"), F.first("_start").alias("shard")
    )
    n = narrow.count()
    labels = propagate(nodes, shards, -(-n // shards) if n else 0, rounds).select(
        F.col("doc_id").alias("_d"), *[F.col(c).alias(f"{c}_g") for c in group], F.col("shard").alias("_label"), "group"
    )
    same = narrow["doc_id"].eqNullSafe(labels["_d"])
    for c in group:
        same = same & (narrow[c] == labels[f"{c}_g"])
    wished = (
        narrow.join(labels, same, "left")
        .withColumn("shard", F.coalesce("_label", "_start"))
        .withColumn("_single", F.col("group").isNull())
        .select("doc_id", "size", "text_crc32", "_text", "shard", F.col("shard").alias("wished_shard"), "_single")
    )
    # whole groups stand together, so a full shard gives up single documents first
    out = deal(wished, ["_single", "_text", "doc_id", "size"], shards, n)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "wished_shard",
    )
