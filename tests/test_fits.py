"""Merged fits and sketches against single fits and plain counting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import fits, sketches, stats
from flowspark.operators.fits import FitStore
from flowspark.session import remove_path

DDL = "a DOUBLE, b BIGINT, p INT, s STRING, f DOUBLE"


def rows(seed, n):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return [
        (pick(None, math.nan, 2e9, rng.uniform(-50, 50), 1e6 + rng.random()), rng.randrange(100), pick(None, 6, 17, rng.randrange(30)),
         pick(None, "", "x", f"s{rng.randrange(9)}"), pick(None, 0.5, 1.5, 10.0)) for _ in range(n)
    ]


def plain(df):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()), key=repr)


def test_three_parts_are_one_fit(spark, tmp_path):
    data = {f"day {i}/x": rows(i, 50 + 20 * i) for i in range(3)}
    store = FitStore(spark, str(tmp_path / "fits"), ["a", "b"], ["p", "s", "f"])
    assert store.parts() == [] and store.levels().count() == 0
    for name, part in data.items():
        raw = str(tmp_path / "raw")
        spark.createDataFrame(part, DDL).write.mode("overwrite").parquet(raw)
        store.add(name, spark.read.schema(DDL).parquet(raw))
        remove_path(spark, raw)  # no later step can read the rows again
    assert store.parts() == sorted(data)
    whole = spark.createDataFrame([r for part in data.values() for r in part], DDL)
    assert plain(fits.merge_ranges(store.numbers())) == plain(stats.fit_numeric(whole, ["a", "b"]))
    for caps in (None, {"s": 2}):
        assert plain(store.ranked_levels(5, caps)) == plain(stats.fit_categorical(whole, ["p", "s", "f"], 5, caps=caps))
    params = store.params(5)
    assert params.features == ["a", "b", "p", "s", "f"] and params.numerical["b"].min == min(r[1] for p in data.values() for r in p)
    finite = ["b"]
    got = {r["feature"]: r for r in store.statistics().collect()}
    for r in stats.feature_statistics(whole, finite).collect():
        g = got[r["feature"]]
        assert (g["n_values"], g["min"], g["max"], g["non_zero"]) == (r["n_values"], r["min"], r["max"], r["non_zero"])
        assert math.isclose(g["mean"], r["mean"], rel_tol=1e-12) and math.isclose(g["std"], r["std"], rel_tol=1e-12)
    # what is kept does not grow with the rows
    assert store.numbers().count() == 2 * 3


def test_parts_replace_themselves_and_half_written_ones_do_not_count(spark, tmp_path):
    store = FitStore(spark, str(tmp_path / "fits"), ["b"], ["s"])
    store.add("one", spark.createDataFrame(rows(1, 30), DDL))
    store.add("two", spark.createDataFrame(rows(2, 30), DDL))
    store.add("two", spark.createDataFrame(rows(3, 40), DDL))
    both = spark.createDataFrame(rows(1, 30) + rows(3, 40), DDL)
    assert plain(store.ranked_levels()) == plain(stats.fit_categorical(both, ["s"]))
    assert plain(store.ranked_levels(parts=["one"])) == plain(stats.fit_categorical(spark.createDataFrame(rows(1, 30), DDL), ["s"]))
    remove_path(spark, str(tmp_path / "fits" / "two" / "numbers"))
    assert store.parts() == ["one"]
    with pytest.raises(ValueError):
        store.levels(["two"])
    store.remove("one")
    assert store.parts() == []


def test_large_means_lose_no_digits(spark, tmp_path):
    store = FitStore(spark, str(tmp_path / "fits"), ["a"], [])
    values = [[1e9 + i * 0.001 for i in range(k * 100, k * 100 + 100)] for k in range(3)]
    for k, v in enumerate(values):
        numbers = fits.partial_numbers(spark.createDataFrame([(x,) for x in v], "a double"), ["a"])
        numbers.write.parquet(str(tmp_path / "n" / str(k)))
    del store
    found = fits.merge_statistics(spark.read.parquet(str(tmp_path / "n" / "*"))).first()
    flat = [x for v in values for x in v]
    mean = math.fsum(flat) / 300
    std = math.sqrt(math.fsum((x - mean) ** 2 for x in flat) / 300)
    assert math.isclose(found["std"], std, rel_tol=1e-6)


def test_a_type_that_changes_is_refused(spark, tmp_path):
    store = FitStore(spark, str(tmp_path / "fits"), [], ["s"])
    with pytest.raises(Exception):
        store.add("none", spark.createDataFrame([(1,)], "other int"))
    store = FitStore(spark, str(tmp_path / "fits2"), ["b"], ["s"])
    store.add("one", spark.createDataFrame([(1, "x")], "b int, s string"))
    store.add("two", spark.createDataFrame([(1, 5)], "b int, s int"))
    with pytest.raises(ValueError):
        store.params()


def levels_frame(spark, n=4000):
    rng = random.Random(5)
    heavy = [f"h{i}" for i in range(8)]
    data = [(rng.choice(heavy) if rng.random() < 0.6 else f"rare{rng.randrange(10**9)}", rng.choice([1, 1, 1, 2, 2, None]), rng.randrange(2000), rng.choice([0.5, 2.5])) for _ in range(n)]
    return spark.createDataFrame(data, "s string, p int, flat int, f double")


def test_frequent_levels_are_exact(spark, monkeypatch):
    df = levels_frame(spark)
    full = []
    monkeypatch.setattr(sketches, "fit_categorical", lambda d, f, k: full.extend(f) or stats.fit_categorical(d, f, k))
    got = sketches.frequent_levels(df, ["s", "p", "flat", "f"], top_k=5, tracked=128)
    assert plain(got) == plain(stats.fit_categorical(df, ["s", "p", "flat", "f"], 5))
    # flat frequencies prove nothing, the others do
    assert full == ["flat"]
    assert sketches.frequent_levels(df.limit(0), ["s", "p"], 5, 128).count() == 0
    with pytest.raises(ValueError):
        sketches.frequent_levels(df, ["s"], 500, 128)


def test_few_levels_leave_the_tasks(spark):
    df = levels_frame(spark)
    one = sketches.sketch_levels(df, ["s"], 128)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" in plan and "hashpartitioning" not in plan
    found = one.select(F.size(F.call_function("approx_top_k_estimate", F.col("_s0"), F.lit(128))).alias("n")).first()
    assert 8 <= found["n"] <= 128 < df.select("s").distinct().count()


@pytest.mark.parametrize("bracket", [1, 20, 10_000])
def test_quantiles_are_exact(spark, bracket):
    rng = random.Random(6)
    data = [(rng.choice([0.0, 7.0, rng.gauss(0, 100), float(rng.randrange(10)), 1e300, -1e300]),) for _ in range(3000)]
    df = spark.createDataFrame(data + [(None,), (math.nan,)], "v double")
    shares = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    ordered = sorted(v for v, in data)
    want = {q: ordered[max(1, math.ceil(round(q * 3000, 6))) - 1] for q in shares}
    got = {r["share"]: r["value"] for r in sketches.exact_quantiles(df, "v", shares, sketch_k=64, bracket=bracket).collect()}
    assert got == want


def test_quantiles_of_little(spark):
    one = spark.createDataFrame([(3.0,)] * 50, "v double")
    assert [tuple(r) for r in sketches.exact_quantiles(one, "v", [0.5, 1.0], bracket=1).collect()] == [(0.5, 3.0), (1.0, 3.0)]
    assert [tuple(r) for r in sketches.exact_quantiles(one.limit(0), "v", [0.5]).collect()] == [(0.5, None)]
    with pytest.raises(ValueError):
        sketches.exact_quantiles(one, "v", [1.5])
