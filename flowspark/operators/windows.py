"""Windows of consecutive flows over an indexed table (column ``idx``: dense, 0-based)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from flowspark.functions.categorical import one_hot_fitted
from flowspark.functions.numeric import int_div, quoted
from flowspark.operators.order import order_rows
from flowspark.operators.split import affine_position, hash_number
from flowspark.schemas import FittedParams, require_columns
from flowspark.session import MAX_LOOKUP_ROWS, fetch_small

# Rows per chunk. A chunk fits the in-memory buffer of a window task and dwarfs the halo.
CHUNK_ROWS = 4096


def sliding_windows(
    df: DataFrame, cols: list[str], window: int = 8, keep: list[str] | None = None,
    key: str | None = None, chunk: int = CHUNK_ROWS, ends: Column | None = None, idx: str = "idx",
) -> DataFrame:
    """``win``: the last ``window`` rows up to each row (structs of ``cols``), once full.

    The index is cut into chunks of equal size and each chunk also receives the last ``window - 1``
    rows of the one before, so no task sees more than a chunk at a time. With ``key`` the index must
    follow (key, time); windows reaching into another key are dropped, and a hot key simply spans
    many chunks. ``ends`` restricts the rows windows end at.
    """
    require_columns(df, [*cols, *(keep or []), idx])
    if window > chunk:
        raise ValueError("the window must not be longer than a chunk")
    c = int_div(F.col(idx), chunk)
    in_tail = F.pmod(F.col(idx), F.lit(chunk)) >= chunk - (window - 1)
    member = F.array(c) if window == 1 else F.when(in_tail, F.array(c, c + 1)).otherwise(F.array(c))
    carried = [F.col(idx), F.struct(*[quoted(n) for n in cols]).alias("_row")]
    carried += [quoted(n) for n in keep or [] if n != idx]
    if key:
        carried.append(quoted(key).alias("_key"))
    if ends is not None:
        carried.append(ends.alias("_end"))
    halo = df.select(*carried, F.explode(member).alias("_chunk"))
    by_idx = W.Window.partitionBy("_chunk").orderBy(idx)
    frame = by_idx.rowsBetween(-(window - 1), 0)
    out = halo.withColumn("win", F.collect_list("_row").over(frame))
    full = (int_div(F.col(idx), chunk) == F.col("_chunk")) & (F.size("win") == window)
    if key:
        out = out.withColumn("_key0", F.first("_key").over(frame))
        full = full & F.col("_key0").eqNullSafe(F.col("_key"))
    if ends is not None:
        full = full & F.col("_end")
    names = [idx, *[n for n in keep or [] if n != idx]]
    return out.filter(full).select(*[quoted(n) for n in names], "win")


def keyed_index(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Index following (key, order), the input of keyed ``sliding_windows``."""
    return order_rows(df, [key, *order]).indexed().drop("_part", "_pos")


def strided_windows(
    df: DataFrame, cols: list[str], window: int = 8, stride: int | None = None, idx: str = "idx"
) -> DataFrame:
    """Windows starting at 0, s, 2s, ... that fit in the table; the default stride is ``window``."""
    stride = stride or window
    require_columns(df, [*cols, idx])
    if stride >= window:
        # every row belongs to at most one window: one grouping, no halo
        slot = int_div(F.col(idx), stride)
        rows = df.filter(F.pmod(F.col(idx), F.lit(stride)) < window).select(
            slot.alias("window_id"), idx, F.struct(*[quoted(n) for n in cols]).alias("_row")
        )
        grouped = rows.groupBy("window_id").agg(
            F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("_row").alias("r")))).alias("a")
        )
        full = grouped.filter(F.size("a") == window)
        return full.select(
            "window_id", (F.col("window_id") * stride).alias("start_idx"),
            F.transform("a", lambda x: x["r"]).alias("win"),
        )
    start = F.col(idx) - (window - 1)
    slid = sliding_windows(df, cols, window, ends=F.pmod(start, F.lit(stride)) == 0, idx=idx)
    return slid.select(
        int_div(start, stride).alias("window_id"), start.alias("start_idx"), "win"
    )


def pad_window(win: Column, window: int, zero: Column) -> Column:
    """Zero rows after the data when there are fewer than ``window`` rows."""
    missing = F.greatest(F.lit(window) - F.size(win), F.lit(0))
    return F.concat(win, F.array_repeat(zero, missing))


def zero_row(schema, cols: list[str]) -> Column:
    types = {f.name: f.dataType for f in schema.fields}
    return F.struct(*[F.lit(0).cast(types[n]).alias(n) for n in cols])


def edge_window(
    df: DataFrame, cols: list[str], window: int = 8, from_end: bool = True, strict: bool = False,
    batch: int = 1, order: list[str] | None = None,
) -> DataFrame:
    """The last (or first) ``window`` rows in ``order`` (default: the index) as one window, repeated
    ``batch`` times.

    Fewer rows: zero padding, or an error with ``strict``. A top-n: each task keeps ``window`` rows, the
    table is neither sorted nor indexed for it.
    """
    order = order or ["idx"]
    require_columns(df, [*cols, *order])
    sort = [F.col(c).desc() if from_end else F.col(c).asc() for c in order]
    row = F.struct(*[quoted(c) for c in cols]).alias("r")
    rows = df.select(*order, row).orderBy(*sort).limit(window)
    key = F.struct(F.struct(*order).alias("i"), "r").alias("x")
    one = rows.agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["r"]).alias("win"))
    if strict:
        found = one.select(F.size("win")).first()[0]
        if found < window:
            raise ValueError(f"need at least {window} rows, got {found}")
    padded = one.select(pad_window(F.col("win"), window, zero_row(df.schema, cols)).alias("win"))
    return padded.select(F.explode(F.sequence(F.lit(0), F.lit(batch - 1))).alias("b"), "win")


def windows_at(
    df: DataFrame, targets: DataFrame, cols: list[str], window: int = 8, keep: list[str] | None = None,
    idx: str = "idx", max_rows: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Windows ending at the rows of ``targets``. Rows are marked by their index, which is unique.

    While the targets' windows have at most ``max_rows`` rows, these rows alone are picked out of the table,
    which is not shuffled for it; for more targets all rows go through ``sliding_windows``.
    """
    marks = targets.select(F.col(idx).alias("_target")).distinct()
    few = fetch_small(marks, max_rows // window)
    if few is None:
        marked = df.join(marks, df[idx] == marks["_target"], "left")
        return sliding_windows(marked, cols, window, keep=keep, ends=F.col("_target").isNotNull(), idx=idx)
    require_columns(df, [*cols, *(keep or []), idx])
    kept = [n for n in keep or [] if n != idx]
    members = few.select("_target", F.explode(F.sequence(F.col("_target") - (window - 1), F.col("_target"))).alias("_member"))
    picked = df.select(
        F.col(idx).alias("_member"), F.struct(*[quoted(n) for n in cols]).alias("_row"),
        F.struct(F.col(idx).alias("_i"), *[quoted(n) for n in kept]).alias("_keep"),
    ).join(F.broadcast(members), "_member")
    found = picked.groupBy("_target").agg(
        F.sort_array(F.collect_list(F.struct("_member", F.col("_row").alias("r")))).alias("_rows"),
        F.max_by("_keep", "_member").alias("_keep"),
    )
    return found.filter((F.size("_rows") == window) & (F.col("_keep._i") == F.col("_target"))).select(
        F.col("_target").alias(idx), *[F.col("_keep")[n].alias(n) for n in kept],
        F.transform("_rows", lambda x: x["r"]).alias("win"),
    )


def random_context_windows(
    targets: DataFrame, context: DataFrame, rows: DataFrame, cols: list[str], n_context: int,
    window: int = 8, batch: int = 128, seed: int = 42, idx: str = "idx",
) -> DataFrame:
    """Windows of ``window - 1`` random training rows followed by the target row.

    ``targets`` (ordinal, idx) numbers the target rows densely; ``context`` (pos, idx) the training
    rows. Inside a batch of ``batch`` targets all context rows differ: slot numbers go through a
    seeded permutation of the positions. Both joins are on unique keys.
    """
    if batch * window > n_context:
        raise ValueError("a batch needs batch * window training rows")
    step = int_div(F.col("ordinal"), batch)
    x = F.pmod(F.col("ordinal"), F.lit(batch)) * window
    slots = targets.select(
        F.col(idx).alias("target"),
        step.alias("_step"), x.alias("_x"),
        F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("slot"),
    )
    drawn = affine_position(
        F.col("_x") + F.col("slot"), F.lit(n_context).cast("bigint"),
        hash_number(seed, F.col("_step")), [n_context],
    )
    draws = slots.filter(F.col("slot") < window - 1).select("target", "slot", drawn.alias("pos"))
    picked = draws.join(context.select("pos", idx), "pos").select("target", "slot", idx)
    own = targets.select(F.col(idx).alias("target"), F.lit(window - 1).alias("slot"), idx)
    members = picked.unionByName(own)
    data = rows.select(idx, F.struct(*[quoted(c) for c in cols]).alias("_row"))
    filled = members.join(data, idx)
    return filled.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("slot", F.col("_row").alias("r")))).alias("a")
    ).select(F.col("target").alias(idx), F.transform("a", lambda v: v["r"]).alias("win"))


# -- expressions on windows ------------------------------------------------------------------
def feature_wise(win: Column, features: list[str]) -> list[Column]:
    """One array per feature, in declared order, matched by exact name."""
    return [F.transform(win, _field(f)).alias(f) for f in features]


def _field(name: str):
    return lambda s: s[name]


def model_inputs(
    windows: DataFrame, params: FittedParams, input_names: list[str] | None = None,
    dims: dict[str, int] | None = None, keep: list[str] | None = None, prefix: str = "input_",
    valid: Column | None = None, unknown_flag: bool = True,
) -> DataFrame:
    """Model inputs of encoded windows (numbers and level codes): numeric (W, 1), categorical
    (W, dim), in the model's input order. One-hot vectors are built here, after the shuffle.

    ``valid`` is the number of real rows when the window was padded: padding rows carry no
    unknown flag.
    """
    def number(f: str):
        return lambda s: F.array(s[f].cast("float"))

    def vector(f: str, width: int, expected: int):
        def build(s: Column, i: Column) -> Column:
            vec = one_hot_fitted(s[f], width, expected, unknown_flag)
            if valid is None:
                return vec
            return F.when(i < valid, vec).otherwise(F.array_repeat(F.lit(0.0).cast("float"), expected))

        return build

    inputs = {f"{prefix}{f}": F.transform("win", number(f)) for f in params.numerical}
    for f, p in params.categorical.items():
        expected = (dims or {}).get(f, p.n_levels)
        inputs[f"{prefix}{f}"] = F.transform("win", vector(f, p.n_levels, expected))
    order = input_names or list(inputs)
    missing = [n for n in order if n not in inputs]
    if missing:
        raise ValueError(f"missing model inputs: {missing}")
    return windows.select(*[quoted(c) for c in keep or []], *[inputs[n].alias(n) for n in order])


def record_vector(row: Column, params: FittedParams, dims: dict[str, int] | None = None) -> Column:
    """One vector per flow: numbers, then the one-hot parts, concatenated."""
    numbers = F.array(*[row[f].cast("double") for f in params.numerical])
    parts = [numbers]
    for f, p in params.categorical.items():
        expected = (dims or {}).get(f, p.n_levels)
        parts.append(one_hot_fitted(row[f], p.n_levels, expected, dtype="double"))
    # flatten copies whole parts, also inside a function on array elements, where concat goes through each number
    return F.flatten(F.array(*parts))


def pool_window(vectors: Column, how: str, width: int, window: int) -> Column:
    """A window of vectors as one: the last flow, all flows one after the other, or their mean."""
    if how == "last":
        return F.element_at(vectors, -1)
    if how == "flatten":
        return F.flatten(vectors)
    if how == "mean":
        zero = F.array_repeat(F.lit(0.0), width)
        total = F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        return F.transform(total, lambda s: s / F.lit(float(window)))
    raise ValueError(f"unknown pooling {how!r}")


# Flow record column -> name in the window context.
CONTEXT_FIELDS = {
    "IPV4_SRC_ADDR": "src_ip", "IPV4_DST_ADDR": "dst_ip", "L4_SRC_PORT": "src_port",
    "L4_DST_PORT": "dst_port", "PROTOCOL": "protocol", "L7_PROTO": "l7_proto",
}


def context_struct() -> Column:
    """Addresses, ports and protocols of a flow, carried through a window for alerts."""
    return F.struct(*[quoted(c).alias(n) for c, n in CONTEXT_FIELDS.items()])


def last_label(win: Column, field: str) -> Column:
    """A window's label is that of its last flow."""
    return F.element_at(F.transform(win, lambda s: s[field]), -1)
