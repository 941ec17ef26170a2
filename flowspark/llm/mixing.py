"""Mixing sources to target weights (1): Sainte-Lague apportionment of equal-token blocks.

Every source has a target in tokens (words). Blocks of ``block`` words are apportioned to sources in the
ratio of their targets, seat by seat to the highest quotient target / (2 k + 1), and a source's blocks to
its shards in the same way. A shard orders its documents by a seeded hash into one stream of words and
takes a run of as many blocks as its quota says, from a seeded place on and around the end; a quota
beyond the stream takes it whole as often as it fits first. All expressions are native.

A shard holds about ``shard_rows`` documents, so no source, however large, is ordered in one task. Seats are
found by their divisor: counts of the quotients above a few thresholds, narrowed from bounds that hold for
any shares, leave a handful of quotients to compare, however many shards or sources there are.

Results for odd input: a null or blank text has size 0 and nothing of it is taken; a null source is a
source of its own, last in order; rows with equal doc_id and text are interchangeable, and each has its own
place; an empty table gives an empty result; sources of size 0 get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.scratch import materialize
from flowspark.session import lookup_join

WEIGHTS = (3, 1, 2)
BLOCK = 16
SHARD_ROWS = 2000
_ROUNDS, _THRESHOLDS = 1, 31  # counts of quotients above so many thresholds, so many times
_EPS = 1e-9  # more than the rounding of a quotient


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _stream_name() -> Column:
    """A name for the source and shard of a row; a null source has one of its own."""
    return F.concat_ws("/", F.col("_shard").cast("string"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))


def source_targets(sizes: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_rows, weight, target) from one row per source with source and source_size.

    ``percent`` of all tokens is shared by weight; a target stops at ``most`` times its source's size and
    the excess is shared again. With sources sorted by size per weight, the stopped ones come first: the
    share per weight is the first at which the next source does not stop.
    """
    everything = Window.partitionBy()
    pick = F.lit(weights[-1])
    for k, w in reversed(list(enumerate(weights[:-1]))):
        pick = F.when(F.col("_place") % len(weights) == k, F.lit(w)).otherwise(pick)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    upto = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * percent / 100
    return (
        sizes.withColumn("_place", F.row_number().over(by_name) - 1)
        .withColumn("weight", pick)
        .withColumn("_ratio", F.col("source_size") / F.col("weight"))
        .withColumn("_left", total - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        # the share per weight if exactly the sources before this one stop
        .withColumn("_share", F.col("_left") / F.col("_open"))
        .withColumn("_level", F.min(F.when(
            F.col("_share") <= most * F.col("_ratio"), F.struct("_ratio", "_place", "_share")
        )).over(everything)["_share"])
        .withColumn("target", F.least(
            (most * F.col("source_size")).cast("double"),
            F.coalesce(F.col("_level") * F.col("weight"), (most * F.col("source_size")).cast("double")),
        ))
        .drop("_place", "_ratio", "_left", "_open", "_share", "_level")
    )


def _with(parts: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """``parts`` with the columns of its group; null is a group as well."""
    return lookup_join(parts, groups, group) if group else parts.crossJoin(F.broadcast(groups))


def _seats_above(share: str, threshold: Column) -> Column:
    """How many quotients share / (2 k + 1) are at least ``threshold``."""
    return F.floor((F.col(share) / threshold + 1) / 2)


def apportion(parts: DataFrame, group: list[str], key: list[str], share: str, seats: Column) -> DataFrame:
    """``parts`` with ``quota``: ``seats`` (an aggregate over the group) by highest quotients share / (2 k + 1),
    ties by ``key``, which is unique in the group. ``parts`` is read several times and should be a written table.

    With n parties, sum A and S seats, the quotients above A / (2 S + n) are at least S and those above
    A / (2 S - n) fewer, so the last winning quotient lies between, and at most 2 n others do. Counting the
    quotients above some thresholds in between narrows this by that factor each round.
    """
    live = parts.filter(F.col(share) > 0)
    n, total, s = F.col("_n"), F.col("_all"), F.col("_seats")
    bounds = (
        live.groupBy(*group)
        .agg(F.sum(share).alias("_all"), F.count("*").alias("_n"), F.max(share).alias("_max"), seats.alias("_seats"))
        .filter("_seats > 0")
        .select(
            *group, "_seats", (total / (2 * s + n) * (1 - _EPS)).alias("_low"),
            # no quotient is above the largest share
            (F.least(F.col("_max"), F.when(2 * s > n, total / (2 * s - n)).otherwise(F.col("_max"))) * (1 + _EPS)).alias("_high"),
        )
    )
    for _ in range(_ROUNDS):
        step = F.pow(F.col("_high") / F.col("_low"), F.lit(1.0 / (_THRESHOLDS + 1)))
        marks = [F.col("_low") * F.pow(step, F.lit(float(j))) for j in range(1, _THRESHOLDS + 1)]
        counted = _with(live.select(*group, share), bounds, group).filter("_low IS NOT NULL").groupBy(*group, "_seats", "_low", "_high").agg(
            *[F.sum(_seats_above(share, m)).alias(f"_c{j}") for j, m in enumerate(marks)]
        )
        low, high = F.col("_low"), F.col("_high")
        for j, m in enumerate(marks):
            low = F.when(F.col(f"_c{j}") >= s, m).otherwise(low)
        for j, m in reversed(list(enumerate(marks))):
            high = F.when(F.col(f"_c{j}") < s, m).otherwise(high)
        bounds = counted.select(*group, "_seats", low.alias("_low"), high.alias("_high"))
    # quotients well above the upper bound have won; those around the bounds are compared
    sized = _with(live, bounds, group).filter("_low IS NOT NULL").select(
        *group, *key, share, "_seats", _seats_above(share, F.col("_high") * (1 + _EPS)).alias("_sure"),
        _seats_above(share, F.col("_low") * (1 - _EPS)).alias("_last"),
    )
    sure = sized.groupBy(*group).agg((F.max("_seats") - F.sum("_sure")).alias("_rest"))
    listed = sized.filter("_last > _sure").withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_last") - 1)))
    order = Window.partitionBy(*group).orderBy((F.col(share) / (2 * F.col("_k") + 1)).desc(), *key)
    won = (
        _with(listed.select(*group, *key, share, "_k"), sure, group)
        .withColumn("_rank", F.row_number().over(order)).filter("_rank <= _rest")
        .groupBy(*group, *key).agg(F.count("*").alias("_won"))
    )
    quotas = lookup_join(sized.select(*group, *key, "_sure"), won, [*group, *key]).select(
        *group, *key, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota")
    )
    names = [*group, *key]
    renamed = quotas.withColumnsRenamed({c: f"_r{c}" for c in names})
    match = F.lit(True)
    for c in names:
        match = match & parts[c].eqNullSafe(renamed[f"_r{c}"])
    joined = parts.join(renamed, match, "left").drop(*[f"_r{c}" for c in names])
    return joined.withColumn("quota", F.coalesce("quota", F.lit(0)).cast("bigint"))


def sizes_of(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, _h): all that the mix needs of the documents."""
    return docs.select("doc_id", "source", words_in("text").alias("size"), _place_hash(seed).alias("_h"))


def _place_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def quotas(
    narrow: DataFrame, percent: int, most: int, weights: tuple[int, ...], block: int, shard_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Sources with their number of shards, and shards (by name) with their quota of blocks."""
    sizes = materialize(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "sources"
    )
    targets = materialize(source_targets(sizes, percent, most, weights), "targets")
    seats = F.round(F.sum("target") / block).cast("bigint")
    # rows of one source spread over enough shards
    by_source = materialize(
        apportion(targets, [], ["source"], "target", seats)
        .withColumn("_shards", F.ceil(F.col("n_rows") / shard_rows)).withColumnRenamed("source", "_source"),
        "quotas",
    )
    shards = materialize(
        narrow.join(by_source, narrow["source"].eqNullSafe(by_source["_source"]))
        .withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards")))
        .groupBy("source", "_shard").agg(
            F.sum("size").alias("_shard_size"), F.first("quota").alias("_source_quota"),
        ),
        "shards",
    )
    per_shard = apportion(shards, ["source"], ["_shard"], "_shard_size", F.first("_source_quota"))
    return by_source, materialize(
        per_shard.select(_stream_name().alias("_key"), "_shard_size", F.col("quota").alias("_quota")), "shard-quotas"
    )


def mix(
    docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS,
    block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = 1, narrow: bool = False,
) -> DataFrame:
    """``docs`` (doc_id, source, text and others) with size, source_size, target and taken: the words the
    mix takes of the document, repeats counted. With ``narrow`` only doc_id and source of the other columns
    are returned, and the texts are read once."""
    sizes = materialize(sizes_of(docs, seed), "sizes")
    by_source, per_shard = quotas(sizes, percent, most, weights, block, shard_rows)
    if narrow:
        kept, rows = ["doc_id", "source"], sizes
    else:
        kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
        rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({"size": words_in("text"), "_h": _place_hash(seed)})
    placed = (
        rows.join(
            by_source.select("_source", "source_size", "target", "_shards"), rows["source"].eqNullSafe(by_source["_source"])
        )
        .withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards"))).drop("_source")
        .withColumn("_key", _stream_name())
    )
    # texts are dealt out once: the stream and the quota have the same key
    stream = Window.partitionBy("_key").orderBy("_h", "doc_id", "size")
    upto = stream.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_from", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    placed = placed.join(per_shard, "_key")
    # rounding to blocks never takes more than ``most`` passes
    whole = F.least(F.col("_quota") * block, most * F.col("_shard_size"))
    passes = F.when(F.col("_shard_size") > 0, F.floor(whole / F.col("_shard_size"))).otherwise(F.lit(0))
    # the stream is taken whole ``passes`` times, and a run of the rest from a seeded block on
    blocks = F.greatest(F.ceil(F.col("_shard_size") / block), F.lit(1))
    begin = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "_shard"), blocks) * block
    run = whole - passes * F.col("_shard_size")

    def overlap(low: Column, high: Column) -> Column:
        part = F.least(F.col("_from") + F.col("size"), high) - F.greatest(F.col("_from"), low)
        return F.greatest(part, F.lit(0))

    end = begin + run
    taken = passes * F.col("size") + overlap(begin, F.least(end, F.col("_shard_size"))) + overlap(
        F.lit(0), end - F.col("_shard_size")
    )
    columns = [F.col(f"`{c}`") for c in kept]
    return placed.select(*columns, "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def take_documents(mixed: DataFrame) -> DataFrame:
    """The mix as whole documents: each as often as at least half of another copy of it is taken. Only
    the two documents at the ends of a shard's run are taken in part."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0))
    out = mixed.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")
