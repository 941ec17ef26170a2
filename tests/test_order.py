import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators.order import (
    first_rows, flag_first_by_hash, index_in_groups, index_rows, order_rows, shuffle_rows,
)
from flowspark.session import lookup_join


def skewed(spark, n=2000, hot=0.6):
    """One key holds most rows, and all of them share one timestamp."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(20)}"
        rows.append((i, key, 5 if key == "hot" else rng.randrange(10)))
    return spark.createDataFrame(rows, "id BIGINT, key STRING, t INT"), rows


def test_index_is_dense_and_ordered_despite_ties(spark):
    df, rows = skewed(spark)
    got = {r["id"]: r["idx"] for r in index_rows(df, ["t", "id"], partitions=7).collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert got == want


def test_hot_key_is_spread_over_parts(spark):
    df, rows = skewed(spark)
    ordered = order_rows(df, ["key", "id"], partitions=8)
    sizes = [r["count"] for r in ordered.rows.groupBy("_part").count().collect()]
    assert ordered.n == len(rows) and max(sizes) < 0.3 * len(rows)


def test_index_of_empty_table(spark):
    df = spark.createDataFrame([], "id BIGINT")
    assert index_rows(df, ["id"]).count() == 0
    assert order_rows(df, ["id"]).n == 0


def test_index_in_groups_with_null_group(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "b")], "id INT, g STRING")
    got = {r["id"]: r["pos"] for r in index_in_groups(df, ["g"], ["id"]).collect()}
    assert got == {1: 0, 3: 1, 2: 0, 4: 1, 5: 0}


def md5(seed, i):
    return hashlib.md5(f"{seed}-{i}".encode()).hexdigest()


@pytest.mark.parametrize("quota", [0, 1, 37, 499, 500, 900])
@pytest.mark.parametrize("digits", [1, 4])
def test_first_by_hash_is_exact(spark, quota, digits):
    df = spark.range(500)
    got = {r["id"] for r in flag_first_by_hash(df, "id", 3, quota, prefix_digits=digits).filter("picked").collect()}
    want = set(sorted(range(500), key=lambda i: (md5(3, i), i))[:quota])
    assert got == want


def test_first_by_hash_per_group_with_condition(spark):
    df = spark.range(600).withColumn("g", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    out = flag_first_by_hash(df, "id", 9, {"a": 20, "b": 7}, group="g", where=F.col("id") >= 100)
    assert out.count() == 600
    got = {r["id"] for r in out.filter("picked").collect()}
    a = [i for i in range(100, 600) if i % 3 == 0]
    b = [i for i in range(100, 600) if i % 3]
    order = lambda v: sorted(v, key=lambda i: (md5(9, i), i))
    assert got == set(order(a)[:20]) | set(order(b)[:7])


def test_first_rows_both_ways(spark):
    df, rows = skewed(spark, 300)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))[:40]]
    for limit in (0, 100_000):
        got = sorted(r["id"] for r in first_rows(df, ["t", "id"], 40, index_above=limit).collect())
        assert got == sorted(want)


def test_shuffle_is_a_permutation(spark):
    got = shuffle_rows(spark.range(200), "id", 1).collect()
    assert sorted(r["idx"] for r in got) == list(range(200))
    assert [r["id"] for r in sorted(got, key=lambda r: r["idx"])] != list(range(200))


@pytest.mark.parametrize("max_rows", [1, 1000])
def test_lookup_join_broadcast_and_shuffle_agree(spark, max_rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "a")], "id INT, k STRING")
    table = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k STRING, v INT")
    out = lookup_join(df, table, ["k"], max_rows=max_rows)
    assert out.columns == ["id", "k", "v"]
    assert {r["id"]: r["v"] for r in out.collect()} == {1: 10, 2: 20, 3: None, 4: 10}
