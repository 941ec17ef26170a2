"""Grouping sets and differences of captures against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.operators.summaries import capture_changes, cube_sets, grouping_sets, multiset_difference, rollup_sets


def test_cube_with_nulls_and_distinct(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.randrange(9), rng.choice(["h", "i", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "x string, y int, v int, host string")
    got = grouping_sets(df, ["x", "y"], cube_sets(["x", "y"]), {"n": F.lit(1), "total": F.col("v")}, {"hosts": "host"})
    want = set()
    for gid, pick in ((0, (0, 1)), (1, (0,)), (2, (1,)), (3, ())):
        for key in {tuple(r[i] for i in pick) for r in rows}:
            member = [r for r in rows if tuple(r[i] for i in pick) == key]
            values = dict(zip(pick, key))
            want.add((values.get(0), values.get(1), gid, len(member), sum(r[2] for r in member), len({r[3] for r in member} - {None})))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    # the copies for the sets are made of sums, not of rows
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("Aggregate")
    assert grouping_sets(df.limit(0), ["x"], rollup_sets(["x"]), {"n": F.lit(1)}).count() == 0
    with pytest.raises(ValueError):
        grouping_sets(df, ["x"], [("z",)], {"n": F.lit(1)})


def test_differences_are_those_of_multisets(spark):
    rng = random.Random(2)
    side = lambda n: [(rng.choice(["a", None]), rng.choice([1, 2, None])) for _ in range(n)]
    left, right = side(40), side(25)
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    a, b = Counter(left), Counter(right)
    got = multiset_difference(make(left), make(right))
    # one shuffle, looked at before the plan is run
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {(k, v, max(a[k, v] - b[k, v], 0), max(b[k, v] - a[k, v], 0), min(a[k, v], b[k, v])) for k, v in {*a, *b}}
    assert {tuple(r) for r in got.collect()} == want
    changes = {r["k"]: (r["n_removed"], r["n_added"], r["changed"]) for r in capture_changes(make(left), make(right), ["k"]).collect()}
    for k in ("a", None):
        gone, come = (sum(w[i] for w in want if w[0] == k) for i in (2, 3))
        assert changes[k] == (gone, come, gone > 0 and come > 0)
    with pytest.raises(ValueError):
        multiset_difference(make(left), make(right).withColumnRenamed("v", "w"))
