"""Repeated passages of a fixed length, found from sparse suffixes.

Every window of ``window`` units (words or bytes) picks one *anchor*: the start of the ``gram``-unit
string with the smallest hash inside it, the leftmost of equals. Equal windows pick the same anchor,
so only suffixes that start at an anchor need to be dealt out, about 2 in ``window - gram`` positions.
Consecutive windows of one document with equal anchor strings form a *stretch*: starts ``lo`` to
``hi``, text ``lo`` to ``hi + window``. Stretches partition the windows of a document; a periodic text is
one long stretch, which may repeat itself (``own``).

Stretches with the same text are first counted inside each task, so a group of copies or a passage in a
third of all documents is one row per task from there on. One shuffle by anchor then decides most
stretches: an anchor seen once repeats nothing, stretches with the same text repeat as a whole. Only
different stretches with the same anchor need their text, one copy of each; ``compare`` (a suffix tree
or a suffix array per shard) decides their windows.

The prefixes that part the suffixes vary in length: a group whose different stretches hold more than
``GROUP_UNITS`` is not compared but parted again, by grams of twice the length, until every group fits.
Stretches are cut anew at each length. At the length of the window a group is one text, held as one row
with its count, so the parting ends whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.keys import KEY
from flowspark.llm.text import (
    mix, prefix_sums, range_hash, row_chunks, texts_of, word_bounds, word_hashes,
)
from flowspark.session import remove_path, scratch_path
from flowspark.llm.scratch import materialize

PIECE = 1 << 19  # units per array step; longer texts are cut into pieces that share window - 1 units
_INDEX_BITS = np.uint64(24)
SHARD_BYTES = 1 << 20  # text compared at once in a task
HELD_STRETCHES = 1_000_000  # stretches a task counts at once
GROUP_UNITS = 1 << 19  # units in the different stretches of one prefix; a larger group gets longer prefixes
TEXT_BYTES = 1 << 22  # text of stretches sent on at once


@dataclass(frozen=True)
class Units:
    """What a text consists of: ``words`` or bytes."""

    words: bool
    window: int
    gram: int

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of all texts and the n + 1 offsets into them."""
        if not self.words:
            return data[bounds[0] : bounds[-1]], bounds - bounds[0]
        starts, ends, first = word_bounds(data, bounds)
        return word_hashes(data, starts, ends), first


def stretches(units: np.ndarray, window: int, gram: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, lo, hi, anchor hash, text hash, own) of every stretch; lo and hi count from 0 in units.

    A gram as long as the window is the window, so each is a stretch of its own.
    """
    n_starts = len(units) - window + 1
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    if n_starts <= 0:
        return none
    sums = prefix_sums(units)
    at = np.arange(len(units) - gram + 1)
    grams = range_hash(sums, at, at + gram)
    low = (np.uint64(1) << _INDEX_BITS) - np.uint64(1)
    key = (grams & ~low) | at.astype(np.uint64)
    span, need = 1, window - gram + 1
    while span * 2 <= need:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < need:
        key = np.minimum(key[: n_starts], key[need - span : need - span + n_starts])
    anchor = (key[:n_starts] & low).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(n_starts), "right") - 1
    inside = np.arange(n_starts) + window <= bounds[text + 1]
    starts = np.flatnonzero(inside)
    if len(starts) == 0:
        return none
    a, t = anchor[starts], text[starts]
    g = grams[a]
    new = np.ones(len(starts), bool)
    if gram < window:
        new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(starts) - 1)
    lo, hi = starts[first], starts[last]
    if gram == window:  # the anchor is the text already; a second name makes 128 bits of it
        sums = prefix_sums(mix(units.astype(np.uint64) + np.uint64(77)))
    return t[first], lo, hi, g[first], range_hash(sums, lo, hi + window), a[first] != a[last]


def _pieces(units: np.ndarray, bounds: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, offset in it, units, bounds) of pieces of bounded size that share no window."""
    for first, last in row_chunks(bounds, PIECE):
        a, b = int(bounds[first]), int(bounds[last])
        if b - a <= PIECE or last > first + 1:
            yield first, 0, units[a:b], bounds[first : last + 1] - a
            continue
        for start in range(0, b - a - window + 1, PIECE):
            part = units[a + start : min(b, a + start + PIECE + window - 1)]
            yield first, start, part, np.array([0, len(part)])


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def find_stretches(docs: DataFrame, units: Units) -> DataFrame:
    """One row per stretch of ``docs`` (k1, k2, base, copies, text): a text that starts at unit ``base`` of its
    document and stands for ``copies`` texts. lo and hi count from the document's start; ``copies`` is now
    that of all stretches of the same text that the task holds at once, ``first`` true for one of them."""
    schema = (
        "k1 bigint, k2 bigint, base int, lo int, hi int, anchor bigint, body bigint, own boolean, "
        "copies bigint, first boolean"
    )

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        anchor, body = (table.column(c).to_numpy() for c in ("anchor", "body"))
        order = np.lexsort((body, anchor))
        a, b = anchor[order], body[order]
        start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        stands = table.column("copies").to_numpy()[order]
        copies, first = np.empty(len(a), np.int64), np.zeros(len(a), bool)
        copies[order] = np.repeat(np.add.reduceat(stands, start), np.diff(np.append(start, len(a))))
        first[order[start]] = True
        table = table.drop(["copies"]).append_column("copies", pa.array(copies))
        table = table.append_column("first", pa.array(first))
        yield from table.to_batches(max_chunksize=50_000)

    def run(batches):
        held, rows = [], 0
        for batch in pieces(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_STRETCHES:
                yield from counted(held)
                held, rows = [], 0
        if held:
            yield from counted(held)

    def pieces(batches):
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            for first, last in row_chunks(bounds):
                found, offsets = units.of(data, bounds[first : last + 1])
                for text, start, part, cut in _pieces(found, offsets, units.window):
                    t, lo, hi, anchor, body, own = stretches(part, units.window, units.gram, cut)
                    if len(t) == 0:
                        continue
                    rows = pa.array(t + text + first)
                    base = batch.column("base").take(rows)
                    shift = start - cut[t] + base.to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("k1").take(rows), batch.column("k2").take(rows), base,
                            pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)),
                            pa.array(_signed(anchor)), pa.array(_signed(body)), pa.array(own),
                            batch.column("copies").take(rows),
                        ],
                        names=["k1", "k2", "base", "lo", "hi", "anchor", "body", "own", "copies"],
                    )

    return docs.select("k1", "k2", "base", "copies", "text").mapInArrow(run, schema)


def repeated_stretches(found: DataFrame, units: Units) -> DataFrame:
    """Stretches that may repeat, of those that stand for their task's copies, with ``alike`` (copies in
    the task), ``copies`` (in all), ``held`` (units in the different texts with the anchor) and ``compare``
    (its text is needed to decide its or another's windows)."""
    same = Window.partitionBy("anchor", "body")
    anchor = Window.partitionBy("anchor")
    return (
        found.filter("first").drop("first").withColumnRenamed("copies", "alike").repartition("anchor")
        .withColumn("copies", F.sum("alike").over(same))
        .withColumn("nth", F.row_number().over(same.orderBy("k1", "k2", "lo")))
        .withColumn("total", F.sum("alike").over(anchor))
        .withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(anchor))
        .withColumn("held", F.sum(F.expr(f"CASE WHEN nth = 1 THEN hi - lo + {units.window}L END")).over(anchor))
        .withColumn("open", F.min("copies").over(anchor) == 1)
        .filter("total > 1 OR own")
        .withColumn("compare", F.expr("nth = 1 AND open AND (kinds > 1 OR own)"))
        .drop("nth", "total", "open", "own", "kinds")
    )


def stretch_texts(sources: DataFrame, keys: list[str], wanted: DataFrame, units: Units) -> DataFrame:
    """The text of each wanted stretch as bytes; words are joined by one space. ``sources`` has one row per
    ``keys`` with the text that the stretches were found in."""
    parts = F.collect_list(F.struct("base", "anchor", "lo", "hi", "copies", "held")).alias("parts")
    joined = sources.join(wanted.groupBy(*keys).agg(parts), keys)
    schema = "k1 bigint, k2 bigint, lo int, hi int, anchor bigint, copies bigint, held bigint, body binary"
    names = ["k1", "k2", "lo", "hi", "anchor", "copies", "held", "body"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for k1, k2, text, parts in zip(*(batch.column(c) for c in ("k1", "k2", "text", "parts"))):
                raw = text.as_py()
                raw = raw.encode() if isinstance(raw, str) else raw
                whole = raw.split() if units.words else raw
                key = k1.as_py(), k2.as_py()
                for p in parts.as_py():
                    part = whole[p["lo"] - p["base"] : p["hi"] - p["base"] + units.window]
                    body = b" ".join(part) if units.words else part
                    rows.append((*key, p["lo"], p["hi"], p["anchor"], p["copies"], p["held"], body))
                    size += len(body)
                    if len(rows) >= 5000 or size >= TEXT_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return joined.mapInArrow(run, schema)


SPAN = "k1 bigint, k2 bigint, lo int, hi int"


def _runs(flags: np.ndarray, group: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first, last) of the maximal runs of consecutive flagged positions of a group."""
    at = np.flatnonzero(flags)
    if len(at) == 0:
        return at, at, at
    g, p = group[at], pos[at]
    new = np.ones(len(at), bool)
    new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    return g[new], p[new], p[last]


def compare_stretches(texts: DataFrame, units: Units, compare: Callable) -> DataFrame:
    """Windows of once-only stretches that occur in another stretch of the same anchor.

    ``compare(bodies)`` gets the stretches of whole anchor groups, about ``SHARD_BYTES`` at a time, and
    returns (group, position, repeated) arrays for all windows; a window of a stretch with further
    copies is left to the caller.
    """

    def decide(batch: pa.Table):
        stretch, pos, repeated = compare(batch.column("body").to_pylist())
        copies = batch.column("copies").to_numpy()
        g, lo, hi = _runs(repeated & (copies[stretch] == 1), stretch, pos)
        rows = pa.array(g)
        base = batch.column("lo").to_numpy()[g]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("k1").combine_chunks().take(rows),
                batch.column("k2").combine_chunks().take(rows),
                pa.array((base + lo).astype(np.int32)), pa.array((base + hi).astype(np.int32)),
            ],
            names=["k1", "k2", "lo", "hi"],
        )

    def run(batches):
        # rows come sorted by anchor; a shard is cut between anchors only
        kept, size = [], 0
        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(kept)
            anchors = table.column("anchor").to_numpy()
            change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            if len(change) == 0:
                continue
            # as many shards as the bytes ask for
            marks = np.unique(change[np.searchsorted(
                change, np.linspace(0, change[-1], max(2, size // SHARD_BYTES + 1))[1:].astype(np.int64), "left"
            ).clip(max=len(change) - 1)])
            first = 0
            for mark in marks:
                yield decide(table.slice(first, mark - first))
                first = int(mark)
            rest = table.slice(first).combine_chunks()
            kept, size = rest.to_batches(), rest.nbytes
        if kept:
            yield decide(pa.Table.from_batches(kept))

    return texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN)


def repeated_spans(
    docs: DataFrame, units: Units, compare: Callable, group_units: int = GROUP_UNITS
) -> DataFrame:
    """Per document (k1, k2) the unmerged ranges of units in repeated windows: array of (a, b),
    b exclusive. ``docs`` has text and a row key."""
    spark, span = docs.sparkSession, ["k1", "k2", "lo", "hi"]
    keys, sources = KEY, docs.select(*KEY, "text").dropDuplicates(KEY)
    searched = docs.select(*KEY, F.lit(0).alias("base"), F.lit(1).cast("bigint").alias("copies"), "text")
    parts, paths = [], []
    while True:
        stretch, repeated, known_at, texts_at = (
            scratch_path(spark, n) for n in ("stretches", "repeated", "known", "stretch-texts")
        )
        found = materialize(find_stretches(searched, units), "stretches", stretch)
        hits = materialize(repeated_stretches(found, units), "repeated", repeated)
        known = materialize(found.filter("copies > 1").select(*span), "known", known_at)
        remove_path(spark, stretch)
        parts += [known, hits.filter("alike = 1 AND copies > 1").select(*span)]
        paths += [repeated, known_at]
        if units.gram == units.window:
            break
        texts = stretch_texts(sources, keys, hits.filter("compare"), units)
        texts = materialize(texts, "stretch-texts", texts_at)
        paths.append(texts_at)
        parts.append(compare_stretches(texts.filter(F.col("held") <= group_units), units, compare))
        large = texts.filter(F.col("held") > group_units)
        if large.isEmpty():
            break
        # one text per stretch, so a stretch is known by its document and start
        keys = [*KEY, "base"]
        searched = large.select(*KEY, F.col("lo").alias("base"), "copies", F.col("body").alias("text"))
        sources = searched.drop("copies")
        units = replace(units, gram=min(2 * units.gram, units.window))
    ranges = F.struct(F.col("lo").alias("a"), (F.col("hi") + units.window).alias("b")).alias("s")
    spans = (
        reduce(DataFrame.unionByName, parts).select("k1", "k2", ranges)
        .groupBy("k1", "k2").agg(F.collect_list("s").alias("spans"))
    )
    spans = materialize(spans, "spans")
    # the tables on the way have served
    for path in paths:
        remove_path(spark, path)
    return spans


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, non-adjacent ranges covering the same units."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``spans``; null where nothing repeats."""
    return docs.join(spans, KEY, "left")
