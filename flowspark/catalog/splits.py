"""Splits, balancing and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import FLOWS, INDEXED, ORDER, WINDOW, indexed_flows, query
from flowspark.flows import flows
from flowspark.operators import split, stats
from flowspark.operators.order import index_and_count, shuffle_rows

N = "(SELECT count(*) FROM events)"
EVAL_N = f"CAST(floor({N} * 0.2) AS BIGINT)"
LAST = f"SELECT *, idx < {N} - {EVAL_N} AS training FROM ({INDEXED}) i"


def last_split(spark, sf_dir):
    rows, n = index_and_count(flows(spark, sf_dir), ORDER)
    return split.split_last_rows(rows, 0.2, n), n


@query("x1_split_last_rows", f"SELECT flow_id, idx, training FROM ({LAST}) q")
def _split_last_rows(spark, sf_dir):
    return last_split(spark, sf_dir)[0].select("flow_id", "idx", "training")


RANDOM = f"""SELECT i.*, NOT (i.idx >= {WINDOW} AND coalesce(r.rn, {N} + 1) <= {EVAL_N}) AS training FROM ({INDEXED}) i
 LEFT JOIN (SELECT idx, row_number() OVER (ORDER BY md5(concat('42-', CAST(idx AS STRING))), idx) AS rn
  FROM ({INDEXED}) j WHERE idx >= {WINDOW}) r ON i.idx = r.idx"""


@query("x2_split_random_rows", f"SELECT flow_id, idx, training FROM ({RANDOM}) q")
def _split_random_rows(spark, sf_dir):
    out = split.split_random_rows(indexed_flows(spark, sf_dir), 0.2, 42, WINDOW)
    return out.select("flow_id", "idx", "training")


@query(
    "x3_split_filter_column",
    f"""SELECT flow_id, idx, NOT (L7_PROTO = (SELECT L7_PROTO FROM ({FLOWS}) f GROUP BY L7_PROTO ORDER BY count(*), L7_PROTO LIMIT 1)
    AND idx > {WINDOW}) AS training FROM ({INDEXED}) q""",
)
def _split_filter_column(spark, sf_dir):
    rows = indexed_flows(spark, sf_dir).select("flow_id", "Attack", F.col("L7_PROTO").alias("is_test"), "idx")
    return split.split_filter_column(rows, "is_test", WINDOW).drop("Attack")


START = f"CAST(floor({N} * (1 - 0.2)) AS BIGINT)"
MULTI = f"(idx >= {WINDOW} AND NOT (idx >= {START} AND idx < {START} + {WINDOW}))"
BINARY = f"(idx >= {WINDOW} AND idx < {N} - {WINDOW})"


@query("x4_x5_selectable", f"SELECT idx, {MULTI} AS multiclass, {BINARY} AS \"binary\" FROM ({INDEXED}) q")
def _selectable(spark, sf_dir):
    rows, n = last_split(spark, sf_dir)
    return rows.select(
        "idx", split.selectable_multiclass(n, 0.2, WINDOW).alias("multiclass"),
        split.selectable_binary(n, WINDOW).alias("binary"),
    )


ROLES = f"""SELECT *, CASE WHEN training AND {MULTI} THEN 'train' WHEN NOT training AND {MULTI} THEN 'eval' ELSE 'none' END AS role
 FROM ({LAST}) l"""
BINARY_ROLES = f"""SELECT *, CASE WHEN training AND {BINARY} THEN 'train' WHEN NOT training THEN 'eval' ELSE 'none' END AS role
 FROM ({LAST}) l"""


def multiclass_roles(spark, sf_dir):
    rows, n = last_split(spark, sf_dir)
    return split.index_sets(rows, split.selectable_multiclass(n, 0.2, WINDOW))


def binary_roles(spark, sf_dir):
    rows, n = last_split(spark, sf_dir)
    return split.index_sets(rows, split.selectable_binary(n, WINDOW), eval_needs_selectable=False)


@query("x6_index_sets", f"SELECT idx, Attack, role FROM ({ROLES}) q")
def _index_sets(spark, sf_dir):
    return multiclass_roles(spark, sf_dir).select("idx", "Attack", "role")


@query("x6_index_sets_binary", f"SELECT idx, Attack, role FROM ({BINARY_ROLES}) q")
def _index_sets_binary(spark, sf_dir):
    return binary_roles(spark, sf_dir).select("idx", "Attack", "role")


@query("g10_eval_sizes", f"SELECT Attack, count(*) AS n_eval FROM ({ROLES}) q WHERE role = 'eval' GROUP BY Attack")
def _eval_sizes(spark, sf_dir):
    return stats.eval_sizes(multiclass_roles(spark, sf_dir))


# -- balancing ---------------------------------------------------------------------------------
RANKED = f"""SELECT *, row_number() OVER (PARTITION BY Attack ORDER BY md5(concat('42-', CAST(flow_id AS STRING))), flow_id) AS rn,
 count(*) OVER (PARTITION BY Attack) AS n FROM ({FLOWS}) q WHERE Attack IN ('Benign', 'Dos_TCP_Flood')"""


@query("x7_balance_down", f"SELECT flow_id, Attack FROM (SELECT *, min(n) OVER () AS t FROM ({RANKED}) r) s WHERE rn <= t")
def _balance_down(spark, sf_dir):
    return split.balance_down(flows(spark, sf_dir), "flow_id", "Dos_TCP_Flood").select("flow_id", "Attack")


@query(
    "x8_balance_up",
    f"""SELECT flow_id, Attack, CAST(copy AS INT) AS copy FROM (SELECT *, max(n) OVER () AS t FROM ({RANKED}) r) s,
    generate_series(1, t // n + CASE WHEN n < t AND rn <= t % n THEN 1 ELSE 0 END) g(copy)""",
)
def _balance_up(spark, sf_dir):
    return split.balance_up(flows(spark, sf_dir), "flow_id", "Dos_TCP_Flood").select("flow_id", "Attack", "copy")


@query(
    "x9_shuffle",
    f"SELECT flow_id, row_number() OVER (ORDER BY md5(concat('42-', CAST(flow_id AS STRING))), flow_id) - 1 AS idx FROM ({FLOWS}) q",
)
def _shuffle(spark, sf_dir):
    return shuffle_rows(flows(spark, sf_dir), "flow_id", 42).select("flow_id", "idx")


@query(
    "x7_x9_balance_and_shuffle",
    f"""SELECT flow_id, Attack, row_number() OVER (ORDER BY md5(concat('42-', CAST(flow_id AS STRING), '-1'))) - 1 AS idx
    FROM (SELECT *, min(n) OVER () AS t FROM ({RANKED}) r) s WHERE rn <= t""",
)
def _balance_and_shuffle(spark, sf_dir):
    out = split.balance(flows(spark, sf_dir), "flow_id", "Dos_TCP_Flood")
    return out.select("flow_id", "Attack", "idx")


# -- batch plans -------------------------------------------------------------------------------
# as many batches as the table has rows for
BATCH = 32
STEPS = f"({N} // {BATCH})"


def positions_sql(roles: str, cls: str) -> str:
    return (
        f"SELECT class, idx, row_number() OVER (PARTITION BY class ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY class) AS n "
        f"FROM (SELECT {cls} AS class, idx FROM ({roles}) q WHERE role = 'train') t"
    )


def shares_sql(shares: dict[str, int]) -> str:
    """(c, m, f): class, rows per batch and first slot."""
    first, rows = 0, []
    for c, m in shares.items():
        rows.append(f"('{c}', {m}, {first})")
        first += m
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(c, m, f)"


# classes in order of first appearance; the last one takes the rest of the batch
CLASS_SHARES = f"""SELECT c, CASE WHEN k = n - 1 THEN {BATCH} - (n - 1) * ({BATCH} // n) ELSE {BATCH} // n END AS m, k * ({BATCH} // n) AS f
 FROM (SELECT Attack AS c, row_number() OVER (ORDER BY min(idx)) - 1 AS k, count(*) OVER () AS n FROM ({INDEXED}) z GROUP BY Attack) y"""


def plan_sql(roles: str, cls: str, shares: str, pos: str) -> str:
    return f"""WITH p AS ({positions_sql(roles, cls)}),
    s AS (SELECT v.c AS class, v.m, v.f, (SELECT max(n) FROM p WHERE p.class = v.c) AS n FROM ({shares}) v),
    plan AS (SELECT step, f + k AS slot, class, m, n, k FROM s, generate_series(0, {STEPS} - 1) a(step), generate_series(0, {BATCH}) b(k) WHERE k < m)
    SELECT plan.step, plan.slot, plan.class, p.idx FROM plan JOIN p ON p.class = plan.class AND p.pos = {pos}"""


SEQUENTIAL = "(plan.step * plan.m) % (plan.n - plan.m) + plan.k"


def number_sql(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


BINARY_SHARES = shares_sql({"malicious": 16, "benign": 16})


def _class_order(rows):
    return [r["class"] for r in stats.class_lists(rows).orderBy("position").collect()]


def _steps(rows):
    return rows.count() // BATCH


@query(
    "x10_batches_binary",
    plan_sql(BINARY_ROLES, "CASE WHEN Attack <> 'Benign' THEN 'malicious' ELSE 'benign' END", BINARY_SHARES, SEQUENTIAL),
)
def _batches_binary(spark, sf_dir):
    rows = binary_roles(spark, sf_dir).withColumn("side", split.binary_class(F.col("Attack")))
    return split.plan_batches(split.class_rows(rows, "side"), split.binary_shares(BATCH), _steps(rows))


BINARY_DISTINCT = (
    f"CAST((2654435761::HUGEINT * plan.k + {number_sql('''concat('42-', CAST(plan.step AS STRING), '-', plan.class)''')} % plan.n) % plan.n AS BIGINT)"
)


@query(
    "x10_batches_binary_random",
    plan_sql(BINARY_ROLES, "CASE WHEN Attack <> 'Benign' THEN 'malicious' ELSE 'benign' END", BINARY_SHARES, BINARY_DISTINCT),
)
def _batches_binary_random(spark, sf_dir):
    rows = binary_roles(spark, sf_dir).withColumn("side", split.binary_class(F.col("Attack")))
    return split.plan_batches(
        split.class_rows(rows, "side"), split.binary_shares(BATCH), _steps(rows), mode="distinct"
    )


@query("x11_batches_multiclass", plan_sql(ROLES, "Attack", CLASS_SHARES, SEQUENTIAL))
def _batches_multiclass(spark, sf_dir):
    rows = multiclass_roles(spark, sf_dir)
    shares = split.batch_shares(_class_order(rows), BATCH)
    return split.plan_batches(split.class_rows(rows, "Attack"), shares, _steps(rows))


MULTI_RANDOM = f"{number_sql('''concat('42-', CAST(plan.step AS STRING), '-', CAST(plan.slot AS STRING))''')} % plan.n"


@query("x11_batches_multiclass_random", plan_sql(ROLES, "Attack", CLASS_SHARES, MULTI_RANDOM))
def _batches_multiclass_random(spark, sf_dir):
    rows = multiclass_roles(spark, sf_dir)
    shares = split.batch_shares(_class_order(rows), BATCH)
    return split.plan_batches(
        split.class_rows(rows, "Attack"), shares, _steps(rows), mode="replace"
    )
