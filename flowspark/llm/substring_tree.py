"""Substring dedup (4): suffix trees over words, partitioned by prefix.

Suffixes are grouped by a prefix: the gram at the anchor of their window (``repeats``). Whole groups
are packed into shards of bounded size, one subtree each. Prefixes vary in length: where the suffixes of
one hold too much text, it is extended from 8 words to 16, 32 and at last the window, until each group
fits; at the window a subtree is one leaf with a count. A subtree is held as its sorted leaves and the common
prefixes of neighbours. Its internal nodes of depth ``window`` or more are the maximal runs of leaves
whose common prefixes reach that depth; all windows below such a node repeat.

Results for odd input: a null, empty or short text has no window and keeps every word; repeated rows
repeat each other's windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowspark.llm.keys import row_key
from flowspark.llm.repeats import Units, merge_spans, repeated_spans, with_spans
from flowspark.llm.text import word_bounds, word_hashes

GRAM = 8


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs, equal pairs alike."""
    return np.unique(first * np.int64(len(first) + 1) + second, return_inverse=True)[1].astype(np.int64)


def subtree(units: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the suffix tree in order, and the common prefix of each with the leaf before it,
    exact below twice the largest power of two within ``depth``."""
    levels = [np.unique(units, return_inverse=True)[1].astype(np.int64)]
    span = 1
    while span * 2 <= depth:
        last = levels[-1]
        shifted = np.append(last[span:] + 1, np.zeros(min(span, len(last)), np.int64))[: len(last)]
        levels.append(_ranks(last, shifted))
        span *= 2
    shifted = np.append(levels[-1][span:] + 1, np.zeros(min(span, len(units)), np.int64))[: len(units)]
    leaves = np.argsort(_ranks(levels[-1], shifted), kind="stable")
    a, b = leaves[:-1].copy(), leaves[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in [len(levels) - 1, *range(len(levels) - 1, -1, -1)]:
        ok = (a < len(units)) & (b < len(units))
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        step = np.where(ok, 1 << level, 0)
        a, b, common = a + step, b + step, common + step
    return leaves, np.append(0, common) if len(leaves) else common


def deep_nodes(leaves: np.ndarray, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last leaf (places in ``leaves``) of the topmost internal nodes of this depth."""
    deep = np.append(common >= depth, False)
    first = np.flatnonzero(~deep[:-1] & deep[1:])
    last = np.flatnonzero(deep[:-1] & ~deep[1:])
    return first, last


def compare_words(window: int):
    """Comparison of stretches of words for ``repeats``."""

    def compare(bodies: list[bytes]):
        sizes = np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        bounds = np.append(0, np.cumsum(sizes))
        starts, ends, first = word_bounds(data, bounds)
        ids = np.unique(word_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64)
        # every stretch ends in a mark of its own
        stretch = np.repeat(np.arange(len(bodies)), np.diff(first))
        units = np.empty(len(ids) + len(bodies), np.int64)
        units[np.arange(len(ids)) + stretch] = ids + len(bodies)
        units[first[1:] + np.arange(len(bodies))] = np.arange(len(bodies))
        leaves, common = subtree(units, window)
        top, bottom = deep_nodes(leaves, common, window)
        below = np.zeros(len(leaves) + 1, np.int64)
        np.add.at(below, top, 1)
        np.add.at(below, bottom + 1, -1)
        repeated = np.zeros(len(units), bool)
        repeated[leaves] = np.cumsum(below[:-1]) > 0
        windows = np.diff(first) - window + 1
        group = np.repeat(np.arange(len(bodies)), windows)
        pos = np.arange(len(group)) - np.repeat(np.cumsum(windows) - windows, windows)
        return group, pos, repeated[(first[:-1] + np.arange(len(bodies)))[group] + pos]

    return compare


def repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` (doc_id, text) with its row key and ``spans``: array of word ranges (a, b), b exclusive, to
    remove; ranges may overlap, null where nothing repeats."""
    keyed = docs.select("doc_id", "text").withColumns(row_key())
    units = Units(True, window, min(GRAM, window))
    return with_spans(keyed, repeated_spans(keyed, units, compare_words(window)))


def drop_repeated_words(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts at another place.
    """
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans"))):
                words = (text.as_py() or "").encode().split()
                kept, at = [], 0
                for a, b in merge_spans([(s["a"], s["b"]) for s in spans.as_py() or ()]):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                body = b" ".join(kept)
                out.append((
                    doc_id.as_py(), len(words), len(words) - len(kept), body.decode(),
                    hashlib.sha256(body).hexdigest(),
                ))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return repeated_words(docs, window).select("doc_id", "text", "spans").mapInArrow(run, schema)
