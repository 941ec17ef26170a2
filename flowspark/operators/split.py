"""Training/evaluation splits, class balancing and balanced batch plans."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.numeric import int_div, quoted
from flowspark.operators.order import (
    flag_first_by_hash, rows_at_positions, shuffle_rows, subset_positions,
)
from flowspark.operators.stats import is_positive
from flowspark.schemas import require_columns
from flowspark.session import MAX_LOOKUP_ROWS, small_table


# -- splits ----------------------------------------------------------------------------------
def split_last_rows(
    df: DataFrame, percent: float, n_rows: int | None = None, idx: str = "idx"
) -> DataFrame:
    """``training`` is false for the last int(n * percent) rows (none if that is 0)."""
    n = df.count() if n_rows is None else n_rows
    return df.withColumn("training", F.col(idx) < F.lit(n - int(n * percent)))


def split_random_rows(
    df: DataFrame, percent: float, seed: int, window: int = 8, n_rows: int | None = None,
    idx: str = "idx",
) -> DataFrame:
    """int(n * percent) evaluation rows drawn without replacement among idx >= window."""
    n = df.count() if n_rows is None else n_rows
    quota = int(n * percent)
    if quota > max(n - window, 0):
        raise ValueError("more evaluation rows asked for than rows after the first window")
    flagged = flag_first_by_hash(df, idx, seed, quota, where=F.col(idx) >= window, flag="_eval")
    return flagged.withColumn("training", ~F.col("_eval")).drop("_eval")


def split_filter_column(
    df: DataFrame, test_column: str, window: int = 8, idx: str = "idx"
) -> DataFrame:
    """Evaluation rows hold the rarest value of the test column (ties: the smallest) at idx > window.

    The test column must be the last one besides the index; it is removed.
    """
    data_columns = [c for c in df.columns if c != idx]
    if data_columns[-1] != test_column:
        raise ValueError(f"the test column must be the last one and named {test_column!r}")
    counts = df.filter(quoted(test_column).isNotNull()).groupBy(quoted(test_column).alias("v")).agg(F.count("*").alias("n"))
    rarest = counts.orderBy("n", "v").select("v").first()
    is_eval = F.lit(False)
    if rarest is not None:
        is_eval = F.coalesce(quoted(test_column) == F.lit(rarest["v"]), F.lit(False)) & (F.col(idx) > window)
    return df.withColumn("training", ~is_eval).drop(test_column)


def selectable_multiclass(n_rows: int, percent: float, window: int = 8, idx: str = "idx") -> Column:
    """All rows but the first window and the window from int(n * (1 - percent)) on."""
    start = int(n_rows * (1 - percent))
    i = F.col(idx)
    return (i >= window) & ~((i >= start) & (i < start + window))


def selectable_binary(n_rows: int, window: int = 8, idx: str = "idx") -> Column:
    """Only window <= idx < n - window."""
    i = F.col(idx)
    return (i >= window) & (i < n_rows - window)


def index_sets(df: DataFrame, selectable: Column, eval_needs_selectable: bool = True) -> DataFrame:
    """``role``: 'train' and 'eval' rows usable as window ends, else 'none'.

    Training rows of the class sets must be selectable; evaluation rows only in the multi-class
    variant. The sets stay filters on the table, no index list is built.
    """
    ev = ~F.col("training")
    if eval_needs_selectable:
        ev = ev & selectable
    return df.withColumn(
        "role",
        F.when(F.col("training") & selectable, "train").when(ev, "eval").otherwise("none"),
    )


# -- balancing -------------------------------------------------------------------------------
def balance_down(
    df: DataFrame, id_col: str, attack: str, benign: str = "Benign", seed: int = 42,
    label: str = "Attack",
) -> DataFrame:
    """Both classes cut to the smaller count by hash rank; rows of other labels vanish."""
    require_columns(df, [label])
    two = df.filter(F.col(label).isin(attack, benign))

    def smaller(counts: dict[str, int]) -> dict[str, int]:
        return dict.fromkeys((attack, benign), min(counts.get(attack, 0), counts.get(benign, 0)))

    flagged = flag_first_by_hash(two, id_col, seed, smaller, group=label)
    return flagged.filter("picked").drop("picked")


def balance_up(
    df: DataFrame, id_col: str, attack: str, benign: str = "Benign", seed: int = 42,
    label: str = "Attack",
) -> DataFrame:
    """The smaller class repeated target // n times plus target % n rows picked by hash; ``copy``
    numbers the repeats. Rows of other labels vanish."""
    require_columns(df, [label])
    two = df.filter(F.col(label).isin(attack, benign))
    times: dict[str, int] = {}

    def remainder(counts: dict[str, int]) -> dict[str, int]:
        n = {c: counts.get(c, 0) for c in (attack, benign)}
        if min(n.values()) == 0:
            raise ValueError("both classes need at least one row")
        target = max(n.values())
        times.update({c: target // n[c] for c in n})
        return {c: target % n[c] for c in n}

    flagged = flag_first_by_hash(two, id_col, seed, remainder, group=label)
    whole = F.when(F.col(label) == attack, F.lit(times[attack])).otherwise(F.lit(times[benign]))
    copies = (whole + F.col("picked").cast("int")).cast("int")
    return repeat_rows(flagged, copies, max(times.values()) + 1, id_col).drop("picked")


# Most copies of a row that one step makes in a task.
COPIES_AT_ONCE = 1000


def repeat_rows(df: DataFrame, copies: Column, most: int, id_col: str) -> DataFrame:
    """Every row ``copies`` times, numbered from 1 in ``copy``; ``most`` bounds the copies. Beyond
    ``COPIES_AT_ONCE`` blocks of copies are spread over the tasks before they are unfolded."""
    if most <= COPIES_AT_ONCE:
        return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    blocks = F.sequence(F.lit(0), F.ceil(copies / COPIES_AT_ONCE).cast("int") - 1)
    spread = df.withColumn("_copies", copies).filter("_copies > 0").withColumn("_block", F.explode(blocks))
    spread = spread.repartition(id_col, "_block")
    first = F.col("_block") * COPIES_AT_ONCE + 1
    last = F.least(F.col("_copies"), (F.col("_block") + 1) * COPIES_AT_ONCE)
    return spread.withColumn("copy", F.explode(F.sequence(first, last))).drop("_copies", "_block")


def balance(
    df: DataFrame, id_col: str, attack: str, benign: str = "Benign", strategy: str = "downsample",
    seed: int = 42, label: str = "Attack",
) -> DataFrame:
    """Balance two classes and put the rows into a seeded random order (column ``idx``)."""
    if strategy == "downsample":
        out = balance_down(df, id_col, attack, benign, seed, label).withColumn("copy", F.lit(1))
    elif strategy == "upsample":
        out = balance_up(df, id_col, attack, benign, seed, label)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    key = F.concat_ws("-", F.col(id_col).cast("string"), F.col("copy").cast("string"))
    return shuffle_rows(out.withColumn("_copy_key", key), "_copy_key", seed).drop("_copy_key")


# -- batch plans -----------------------------------------------------------------------------
def class_rows(df: DataFrame, cls: str, idx: str = "idx") -> DataFrame:
    """(class, idx): training rows, as ``plan_batches`` takes them from a table of any size."""
    return df.filter(F.col("role") == "train").select(F.col(cls).cast("string").alias("class"), idx)


def class_positions(df: DataFrame, cls: str, idx: str = "idx") -> DataFrame:
    """(class, pos, idx): training rows numbered inside their class in row order."""
    return subset_positions(class_rows(df, cls, idx), ["class"], idx)


def batch_shares(classes: list[str], batch_size: int) -> dict[str, int]:
    """int(B / C) rows per class, the last class takes the rest."""
    share = batch_size // len(classes)
    shares = {c: share for c in classes[:-1]}
    shares[classes[-1]] = batch_size - (len(classes) - 1) * share
    return shares


def binary_shares(batch_size: int) -> dict[str, int]:
    """Half the batch malicious (rounded down), first in the batch; the rest benign."""
    m = int(0.5 * batch_size)
    return {"malicious": m, "benign": batch_size - m}


def plan_batches(
    positions: DataFrame, shares: dict[str, int], steps: int, mode: str = "sequential",
    seed: int = 42,
) -> DataFrame:
    """(step, slot, class, idx): which row fills each slot of each batch.

    ``sequential`` advances a cursor per class: at step s it stands at (s * m) mod (L - m) for m
    rows per step out of L. ``replace`` draws with replacement by hash; ``distinct`` draws without
    replacement inside a batch by a seeded affine permutation of 0..L-1.

    ``positions`` are the rows of ``class_positions`` or of ``class_rows``; the latter are numbered only
    where the plan needs them. The plan has steps * batch rows, known beforehand; it is broadcast only when
    small.
    """
    spark = positions.sparkSession
    sizes = {
        r["class"]: r["n"]
        for r in positions.filter(F.col("class").isin(list(shares)))
        .groupBy("class").agg(F.count("*").alias("n")).collect()
    }
    need_more = {c: m for c, m in shares.items() if sizes.get(c, 0) <= m}
    if need_more and mode == "sequential":
        raise ValueError(f"classes need more rows than their share of a batch: {need_more}")
    if mode == "distinct" and any(sizes.get(c, 0) < m for c, m in shares.items()):
        raise ValueError("a class has fewer rows than its share of a batch")
    batch = sum(shares.values())
    slots = []
    for c, m in shares.items():
        if m > 0 and not sizes.get(c):
            raise ValueError(f"no training rows for class {c!r}")
        slots += [(len(slots) + k, c, sizes[c], m, k) for k in range(m)]
    by_slot = F.broadcast(small_table(spark, slots, "slot BIGINT, class STRING, n BIGINT, m BIGINT, k BIGINT"))
    numbered = spark.range(steps * batch).select(
        int_div(F.col("id"), batch).alias("step"), F.pmod(F.col("id"), F.lit(batch)).alias("slot")
    )
    plan = numbered.join(by_slot, "slot")
    if mode == "sequential":
        pos = F.pmod(F.col("step") * F.col("m"), F.col("n") - F.col("m")) + F.col("k")
    elif mode == "replace":
        pos = F.pmod(hash_number(seed, F.col("step"), F.col("slot")), F.col("n"))
    elif mode == "distinct":
        shift = hash_number(seed, F.col("step"), F.col("class"))
        pos = affine_position(F.col("k"), F.col("n"), shift, list(sizes.values()))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    plan = plan.select("step", "slot", "class", pos.cast("bigint").alias("pos"))
    if "pos" not in positions.columns:
        return rows_at_positions(positions, plan, ["class"]).select("step", "slot", "class", "idx")
    if steps * batch <= MAX_LOOKUP_ROWS:
        plan = F.broadcast(plan)
    return positions.join(plan, ["class", "pos"]).select("step", "slot", "class", "idx")


def hash_number(seed: int, *parts: Column) -> Column:
    """Non-negative number below 2^60 from a seeded md5; the same in every engine."""
    text = F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


# Multipliers of the affine permutation (primes).
_PRIMES = (2654435761, 2246822519, 3266489917)


def multiplier_for(sizes: list[int]) -> int:
    """A multiplier coprime with every size, so that x -> a*x + b mod n is a bijection."""
    for p in _PRIMES:
        if all(math.gcd(p, n) == 1 for n in sizes if n):
            return p
    product = math.lcm(*[n for n in sizes if n])
    a = _PRIMES[0] + int(hashlib.md5(str(product).encode()).hexdigest()[:8], 16)
    while math.gcd(a, product) != 1:
        a += 1
    return a


def affine_position(x: Column, n: Column, shift: Column, sizes: list[int]) -> Column:
    """Position of the x-th draw without replacement from 0..n-1. Decimals avoid overflow."""
    a = F.lit(multiplier_for(sizes)).cast("decimal(19,0)")
    big = a * x.cast("decimal(18,0)") + F.pmod(shift, n).cast("decimal(18,0)")
    return (big % n.cast("decimal(38,0)")).cast("bigint")


def binary_class(label: Column, benign: str = "Benign") -> Column:
    return F.when(is_positive(label, benign), "malicious").otherwise("benign")
