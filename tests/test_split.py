import pytest
from pyspark.sql import functions as F

from flowspark.operators import split


def table(spark, n=200):
    label = F.when(F.col("id") % 10 < 7, "Benign").when(F.col("id") % 10 < 9, "A").otherwise("B")
    return spark.range(n).select(F.col("id").alias("idx"), label.alias("Attack"))


def eval_rows(df):
    return {r["idx"] for r in df.filter("NOT training").collect()}


def test_last_rows(spark):
    df = table(spark)
    assert eval_rows(split.split_last_rows(df, 0.1)) == set(range(180, 200))
    assert eval_rows(split.split_last_rows(df, 0.001)) == set()  # int(n * p) = 0: no evaluation rows


def test_random_rows_are_exact_and_skip_the_first_window(spark):
    df = table(spark)
    got = eval_rows(split.split_random_rows(df, 0.3, 1, 8))
    assert len(got) == 60 and min(got) >= 8
    assert got == eval_rows(split.split_random_rows(df, 0.3, 1, 8))
    assert got != eval_rows(split.split_random_rows(df, 0.3, 2, 8))
    with pytest.raises(ValueError):
        split.split_random_rows(df, 1.0, 1, 8)


def test_filter_column_takes_the_rarest_value(spark):
    df = table(spark, 40).withColumn("is_test", F.when(F.col("idx") % 4 == 0, 1).when(F.col("idx") % 4 == 2, 2).otherwise(3))
    df = df.select("Attack", "is_test", "idx")
    out = split.split_filter_column(df, "is_test", 8)
    assert "is_test" not in out.columns
    assert eval_rows(out) == {i for i in range(9, 40) if i % 4 == 0}  # tie of 1 and 2: the smaller
    with pytest.raises(ValueError):
        split.split_filter_column(df, "Attack", 8)


def test_selectable_and_roles(spark):
    df = split.split_last_rows(table(spark, 100), 0.2)
    multi = split.index_sets(df, split.selectable_multiclass(100, 0.2, 8))
    roles = {k: {r["idx"] for r in multi.filter(F.col("role") == k).collect()} for k in ("train", "eval")}
    assert roles == {"train": set(range(8, 80)), "eval": set(range(88, 100))}
    binary = split.index_sets(df, split.selectable_binary(100, 8), eval_needs_selectable=False)
    roles = {k: {r["idx"] for r in binary.filter(F.col("role") == k).collect()} for k in ("train", "eval")}
    assert roles == {"train": set(range(8, 80)), "eval": set(range(80, 100))}


@pytest.mark.parametrize("strategy,want", [("downsample", 40), ("upsample", 140)])
def test_balance_counts(spark, strategy, want):
    flows = table(spark).withColumnRenamed("idx", "fid")
    out = split.balance(flows, "fid", "A", strategy=strategy)
    counts = {r["Attack"]: r["count"] for r in out.groupBy("Attack").count().collect()}
    assert counts == {"A": want, "Benign": want}  # rows of label B vanish
    assert sorted(r["idx"] for r in out.collect()) == list(range(2 * want))
    if strategy == "upsample":
        copies = {r["fid"]: r["count"] for r in out.filter("Attack = 'A'").groupBy("fid").count().collect()}
        assert sorted(copies.values()) == [3] * 20 + [4] * 20


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        split.balance(table(spark), "idx", "A", strategy="both")


def loop_plan(rows, shares, steps):
    """The cursor loop the closed form replaces."""
    cursor, out = dict.fromkeys(shares, 0), set()
    for step in range(steps):
        slot = 0
        for c, m in shares.items():
            for i in rows[c][cursor[c]: cursor[c] + m]:
                out.add((step, slot, c, i))
                slot += 1
            cursor[c] = (cursor[c] + m) % (len(rows[c]) - m)
    return out


def test_sequential_plan_equals_the_cursor_loop(spark):
    df = table(spark, 150).withColumn("role", F.lit("train"))
    pos = split.class_positions(df, "Attack")
    shares = split.batch_shares(["A", "B", "Benign"], 20)
    assert shares == {"A": 6, "B": 6, "Benign": 8}
    rows = {c: [i for i in range(150) if ("Benign" if i % 10 < 7 else "A" if i % 10 < 9 else "B") == c] for c in shares}
    got = {tuple(r) for r in split.plan_batches(pos, shares, 30).select("step", "slot", "class", "idx").collect()}
    assert got == loop_plan(rows, shares, 30)


def test_random_plans(spark):
    df = table(spark, 150).withColumn("role", F.lit("train"))
    pos = split.class_positions(df, "Attack")
    shares = {"A": 10, "Benign": 30}
    rows = split.plan_batches(pos, shares, 12, "distinct", 5).collect()
    assert len(rows) == 12 * 40
    for s in range(12):
        assert len({r["idx"] for r in rows if r["step"] == s}) == 40
    assert split.plan_batches(pos, shares, 12, "replace", 5).count() == 12 * 40
    with pytest.raises(ValueError):
        split.plan_batches(pos, {"B": 15}, 2)  # needs more rows than the share
    with pytest.raises(ValueError):
        split.plan_batches(pos, {"nope": 5}, 2, "replace")


def test_multiplier_is_coprime_even_for_its_own_multiples():
    import math

    sizes = [2654435761 * 2, 2246822519 * 3, 3266489917 * 5]
    a = split.multiplier_for(sizes)
    assert all(math.gcd(a, n) == 1 for n in sizes)


def test_affine_positions_do_not_overflow(spark):
    n = 10**15
    x = F.lit(n - 1).cast("bigint")
    r = spark.range(1).select(split.affine_position(x, F.lit(n).cast("bigint"), F.lit(12345).cast("bigint"), [n]).alias("p")).first()
    assert r["p"] == (split.multiplier_for([n]) * (n - 1) + 12345) % n


def test_rows_at_positions_number_only_some_chunks(spark, monkeypatch):
    from flowspark.operators import order

    monkeypatch.setattr(order, "SUBSET_CHUNK", 16)
    rows = spark.range(1000).select(F.col("id").alias("idx"), F.when(F.col("id") % 7 == 0, "B").otherwise("A").alias("class"))
    every = {(r["class"], r["pos"]): r["idx"] for r in order.subset_positions(rows, ["class"]).collect()}
    wanted = [("A", 0, "x"), ("A", 0, "y"), ("A", 500, "x"), ("B", 142, "z"), ("B", 5, "x"), ("A", 10**6, "none"), ("C", 0, "none")]
    table = spark.createDataFrame(wanted, "class string, pos bigint, tag string")
    found = order.rows_at_positions(rows, table, ["class"])
    got = {(r["class"], r["pos"], r["tag"], r["idx"]) for r in found.collect()}
    assert got == {(c, p, t, every[c, p]) for c, p, t in wanted if t != "none"}
