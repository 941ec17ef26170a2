"""Suffix-array dedup (10): repeated byte strings by induced sorting.

Anchors deal the text out to shards (``repeats``), so that equal strings of ``window`` bytes meet in
one shard; a group too large for one is parted again by longer strings. A shard's suffix array is built by induced sorting: suffixes are classed as smaller (S) or
larger (L) than their successor, leftmost S substrings are sorted and named, recursively while names
repeat, and the order of all suffixes is induced from them in linear passes. The passes run on whole
buckets with arrays; only the recursion on names uses plain lists. Common prefixes are computed in text
order: at places whose left neighbours differ by comparison, elsewhere one less than the place before.

Results for odd input: a null text has no bytes; a text shorter than ``window`` keeps all; repeated
rows repeat each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowspark.llm.keys import row_key
from flowspark.llm.repeats import Units, merge_spans, repeated_spans, with_spans

GRAM = 40
_FEW_BUCKETS = 1024


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the one that starts a place later; the last is S."""
    n = len(text)
    if n == 1:
        return np.ones(1, bool)
    rises = np.append(text[:-1] != text[1:], True)
    up = np.append(text[:-1] < text[1:], True)
    nearest = np.flatnonzero(rises)
    return up[nearest[np.searchsorted(nearest, np.arange(n))]]


def _place(found: np.ndarray, chars: np.ndarray, edge: np.ndarray, out: np.ndarray, step: int) -> None:
    """Put ``found`` in order at the moving edges of their buckets."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    sizes = np.diff(np.append(first, len(c)))
    nth = np.arange(len(c)) - np.repeat(first, sizes)
    if step > 0:
        out[edge[c] + nth] = found[order]
    else:
        out[edge[c] - 1 - nth] = found[order]
    edge[c[first]] += step * sizes


def _induce_arrays(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost S ones, a bucket at a time."""
    n, sigma = len(text), len(ends)
    starts = np.append(0, ends[:-1])
    out = np.full(n, -1, np.int64)
    heads, tails = starts.copy(), ends.copy()
    _place(lms[::-1], text[lms[::-1]], tails, out, -1)
    for c in range(sigma):
        at = starts[c]
        parts = True
        while parts:
            parts = heads[c] > at
            batch = out[at : heads[c]]
            at = heads[c]
            if not parts:  # the larger ones are done; now the leftmost S suffixes of the bucket
                batch = out[tails[c] : ends[c]]
            before = batch[batch > 0] - 1
            before = before[~s_type[before]]
            if len(before):
                _place(before, text[before], heads, out, 1)
                # an S suffix leads to no larger one of its own bucket
    tails = ends.copy()
    for c in range(sigma - 1, -1, -1):
        at = ends[c]
        parts = True
        while parts:
            parts = tails[c] < at
            batch = out[tails[c] : at][::-1]
            at = tails[c]
            if not parts:
                batch = out[starts[c] : heads[c]][::-1]
            before = batch[batch > 0] - 1
            before = before[s_type[before]]
            if len(before):
                _place(before, text[before], tails, out, -1)
    return out


def _induce_lists(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for many small buckets."""
    n, t = len(text), text.tolist()
    before = np.append(-1, text[:-1])
    # bucket of the place before, where that is an L (or S) suffix; the last entry serves empty places
    larger = np.append(np.where(np.append(True, s_type[:-1]), -1, before), -1).tolist()
    smaller = np.append(np.where(np.append(False, s_type[:-1]), before, -1), -1).tolist()
    out = [-1] * n
    tails = ends.tolist()
    for p in reversed(lms.tolist()):
        c = t[p]
        tails[c] -= 1
        out[tails[c]] = p
    heads = np.append(0, ends[:-1]).tolist()
    for p in out:  # sees what the loop itself puts further on
        c = larger[p]
        if c >= 0:
            h = heads[c]
            out[h] = p - 1
            heads[c] = h + 1
    tails = ends.tolist()
    for p in reversed(out):
        c = smaller[p]
        if c >= 0:
            h = tails[c] - 1
            out[h] = p - 1
            tails[c] = h
    return np.array(out, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative numbers that end in a single smallest one."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    sigma = int(text.max()) + 1
    ends = np.cumsum(np.bincount(text, minlength=sigma))
    s_type = classify(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    induce = _induce_arrays if sigma <= _FEW_BUCKETS else _induce_lists
    order = induce(text, s_type, lms, ends)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = order[is_lms[order]]
    # name the leftmost S substrings, each up to and including the start of the next
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = ranked[:-1], ranked[1:]
    same = length[a] == length[b]
    pairs = np.flatnonzero(same)
    if len(pairs):
        sizes = length[a[pairs]]
        begin = np.cumsum(sizes) - sizes
        inner = np.arange(sizes.sum()) - np.repeat(begin, sizes)
        equal = text[np.repeat(a[pairs], sizes) + inner] == text[np.repeat(b[pairs], sizes) + inner]
        same[pairs] = np.logical_and.reduceat(equal, begin)
    names = np.append(0, np.cumsum(~same))
    if names[-1] + 1 < len(lms):
        name_of = np.empty(n, np.int64)
        name_of[ranked] = names
        ranked = lms[suffix_array(name_of[lms])]
    return induce(text, s_type, ranked, ends)


def permuted_common_prefixes(
    text: np.ndarray, order: np.ndarray, left: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """In text order: each suffix's predecessor in ``order`` (-1 for none), and their common prefix
    within the next separator; ``left`` is each place's distance to it."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = (before > 0) & (at > 0)
    i = np.flatnonzero(reducible)
    reducible[i] = (text[i - 1] == text[before[i] - 1]) & (left[i - 1] > 0)
    fixed = np.flatnonzero(~reducible)
    common = np.zeros(n, np.int64)
    live = fixed[before[fixed] >= 0]
    limit = np.minimum(left[live], left[before[live]])
    packed = np.zeros(n + 8, np.uint64)
    padded = np.append(text.astype(np.uint64) & np.uint64(255), np.zeros(16, np.uint64))
    for j in range(8):
        packed |= padded[j : j + n + 8] << np.uint64(8 * j)
    done = np.zeros(len(live), np.int64)
    active = np.flatnonzero(limit > 0)
    while len(active):
        p, q = live[active] + done[active], before[live[active]] + done[active]
        differ = packed[p] ^ packed[q]
        low = differ & (~differ + np.uint64(1))  # lowest differing bit
        same = np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        done[active] += same
        active = active[(same == 8) & (done[active] < limit[active])]
    common[live] = np.minimum(done, limit)
    source = np.maximum.accumulate(np.where(reducible, -1, at))
    return before, np.maximum(common[source] - (at - source), 0)


def compare_bytes(window: int):
    """Comparison of stretches of bytes for ``repeats``."""

    def compare(bodies: list[bytes]):
        sizes = np.array([len(b) for b in bodies], np.int64)
        stretch = np.repeat(np.arange(len(bodies)), sizes)
        text = np.ones(int(sizes.sum()) + len(bodies) + 1, np.int64)
        text[np.arange(len(stretch)) + stretch] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + 2
        text[-1] = 0
        stops = np.flatnonzero(text < 2)
        left = stops[np.searchsorted(stops, np.arange(len(text)))] - np.arange(len(text))
        before, common = permuted_common_prefixes(text, suffix_array(text), left)
        repeated = common >= window
        repeated[before[repeated]] = True
        windows = sizes - window + 1
        group = np.repeat(np.arange(len(bodies)), windows)
        pos = np.arange(len(group)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = np.cumsum(sizes) - sizes + np.arange(len(bodies))
        return group, pos, repeated[first[group] + pos]

    return compare


def repeated_bytes(docs: DataFrame, window: int = 200) -> DataFrame:
    """``docs`` (doc_id, text) with its row key and ``spans``: array of byte ranges (a, b), b exclusive, to
    remove; ranges may overlap, null where nothing repeats."""
    keyed = docs.select("doc_id", "text").withColumns(row_key())
    units = Units(False, window, min(GRAM, window))
    return with_spans(keyed, repeated_spans(keyed, units, compare_bytes(window)))


def drop_repeated_bytes(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes left) and kept_sha256.

    A byte goes if a string of ``window`` bytes that covers it also starts at another place.
    """
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                raw = (text.as_py() or "").encode()
                kept, at = [], 0
                merged = merge_spans([(s["a"], s["b"]) for s in spans.as_py() or ()])
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                body = b"".join([*kept, raw[at:]])
                out.append((
                    doc_id.as_py(), len(raw), len(raw) - len(body), len(merged), body,
                    hashlib.sha256(body).hexdigest(),
                ))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    return repeated_bytes(docs, window).select("doc_id", "text", "spans").mapInArrow(run, schema)
