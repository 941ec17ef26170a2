"""Benchmark decontamination (9): size-partitioned MinHash containment search.

Test items are partitioned by size (number of distinct five-word shingles) into powers of two. In a
partition whose largest item has u shingles, an item's sketch is its smallest
``u - ceil(u * percent / 100) + 1`` shingle hashes. A document that holds ``percent`` of an item's
shingles lacks fewer than that many, so it holds at least one of the sketch, however long the document
is and wherever the shingles stand: the search loses nothing. Candidates are then compared by the
shingles themselves.

The items are fetched once and travel to the tasks while they hold at most ``MAX_ITEM_WORDS`` words
in all; beyond that sketch and document hashes meet in a shuffle join.

Results for odd input: items or documents that are null or blank match nothing; an item of fewer than
five words is one shingle of all its words and is looked for as such; repeated items or documents give
their own rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.keys import KEY, row_key
from flowspark.llm.text import gram_hashes, row_chunks, texts_of, word_bounds, word_hashes
from flowspark.llm.scratch import materialize

SIZE = 5
MAX_ITEM_WORDS = 2_000_000
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
ITEM = "item_id bigint, n_item_shingles bigint, n_common bigint"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def grams_of(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _hash_of(grams: list[bytes]) -> np.ndarray:
    """Hashes of shingles, as ``gram_hashes`` gives them in a text."""
    out = np.empty(len(grams), np.uint64)
    for k, gram in enumerate(grams):
        data = np.frombuffer(gram, np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        hashes = word_hashes(data, starts, ends)
        out[k] = gram_hashes(hashes, len(hashes))[0]
    return out


def sketches(items: list[tuple[int, str]], percent: int) -> list[tuple[int, int, int, int, frozenset[bytes]]]:
    """(item number, item_id, gram size, sketch hashes, shingles) of every item that has words."""
    sized = []
    for item_id, text in items:
        words = words_of(text)
        if words:
            size = min(SIZE, len(words))
            sized.append((item_id, size, frozenset(grams_of(words, size))))
    largest = defaultdict(int)
    for _, size, grams in sized:
        part = (size, len(grams).bit_length())
        largest[part] = max(largest[part], len(grams))
    out = []
    for item_id, size, grams in sized:
        u = largest[size, len(grams).bit_length()]
        hashes = np.sort(_hash_of(sorted(grams)))
        out.append((item_id, size, hashes[: u - -(-u * percent // 100) + 1], grams))
    return out


def _search(docs: DataFrame, items: list[tuple[int, str]], percent: int, names: list[str]) -> DataFrame:
    found = sketches(items, percent)
    by_size = {}
    for size in {s for _, s, _, _ in found}:
        numbers = [k for k, f in enumerate(found) if f[1] == size]
        owner = np.concatenate([np.full(len(found[k][2]), k) for k in numbers])
        hashes = np.concatenate([found[k][2] for k in numbers])
        order = np.argsort(hashes, kind="stable")
        by_size[size] = (hashes[order], owner[order])
    shared = docs.sparkSession.sparkContext.broadcast((found, by_size))

    def run(batches):
        items, index = shared.value
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            out = []
            for first, last in row_chunks(bounds):
                starts, ends, begin = word_bounds(data, bounds[first : last + 1])
                words = word_hashes(data, starts, ends, lower=True)
                candidates = set()
                for size, (hashes, owner) in index.items():
                    grams = gram_hashes(words, size)
                    low = np.searchsorted(hashes, grams, "left")
                    hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == grams)
                    doc = np.searchsorted(begin, hit, "right") - 1
                    ok = hit + size <= begin[doc + 1]
                    for g, d in zip(hit[ok].tolist(), doc[ok].tolist()):
                        k = int(low[g])
                        while k < len(hashes) and hashes[k] == grams[g]:
                            candidates.add((d, size, int(owner[k])))
                            k += 1
                at = None
                for d, size, k in sorted(candidates):
                    if at != (d, size):
                        text = data[bounds[first + d] : bounds[first + d + 1]].tobytes()
                        at, grams = (d, size), grams_of(text.translate(_LOWER).split(), size)
                    item_id, _, _, wanted = items[k]
                    common = len(wanted & grams)
                    if common * 100 >= percent * len(wanted):
                        out.append((first + d, item_id, len(wanted), common))
            if out:
                rows, *values = (pa.array(c, pa.int64()) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in names), *values],
                    names=[*names, "item_id", "n_item_shingles", "n_common"],
                )

    return docs.select(*names, "text").mapInArrow(run, _schema(docs, names))


def _schema(docs: DataFrame, names: list[str]) -> str:
    return ", ".join([*(f"{c} {dict(docs.dtypes)[c]}" for c in names), ITEM])


def _grams_table(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, size, gram) of all distinct shingles, for each of the sizes; native expressions."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = []
    for size in sizes:
        grams = F.transform(
            F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.array_join(F.slice("w", i, size), " ")
        )
        parts.append(
            rows.select(key, words.alias("w")).filter(F.size("w") >= size)
            .select(key, F.size("w").alias("words"), F.lit(size).alias("size"), F.explode(F.array_distinct(grams)).alias("gram"))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _search_large(docs: DataFrame, items: DataFrame, percent: int, names: list[str]) -> DataFrame:
    """The same search as joins, for a test set too large to send to the tasks."""
    rows = docs.select(F.struct(*(column.alias(k) for k, column in row_key().items())).alias("d"), *names, "text")
    item_rows = items.select(
        F.struct(*(column.alias(k) for k, column in row_key("item_id").items())).alias("i"), "item_id", "text"
    )
    grams = _grams_table(item_rows, "i", [*range(1, SIZE + 1)])
    # a row that stands several times counts once; its results are given to each of its rows at the end
    grams = grams.filter(f"size = {SIZE} OR words = size").select("i", "size", "gram").distinct()
    per_item = grams.groupBy("i", "size").agg(F.collect_list(F.struct(F.xxhash64("gram").alias("h"), "gram")).alias("g"))
    per_item = per_item.withColumn("part", F.length(F.bin(F.size("g"))))
    largest = per_item.groupBy("size", "part").agg(F.max(F.size("g")).alias("u"))
    sketch = per_item.join(largest, ["size", "part"]).withColumn(
        "k", F.col("u") - F.ceil(F.col("u") * percent / 100) + 1
    )
    index = sketch.select("i", "size", F.explode(F.slice(F.sort_array("g"), 1, F.col("k").cast("int"))).alias("s"))
    index = index.select("i", "size", F.col("s.gram").alias("gram"))
    # one row of each (doc_id, text) is enough: shingles are made of it alone
    once = rows.dropDuplicates(["d"])
    held = materialize(_grams_table(once, "d", [*range(1, SIZE + 1)]).select("d", "size", "gram"), "doc-grams")
    candidates = held.join(index, ["size", "gram"]).select("d", "i").distinct()
    common = (
        candidates.join(grams, "i").join(held, ["d", "size", "gram"])
        .groupBy("d", "i").agg(F.count("*").alias("n_common"))
    )
    sizes = per_item.select("i", F.size("g").cast("bigint").alias("n_item_shingles"))
    found = common.join(sizes, "i").filter(F.col("n_common") * 100 >= percent * F.col("n_item_shingles"))
    return found.join(rows.select("d", *names), "d").join(item_rows.select("i", "item_id"), "i").select(
        *names, "item_id", "n_item_shingles", "n_common"
    )


def _found(
    docs: DataFrame, items: DataFrame, percent: int, max_item_words: int, names: list[str]
) -> DataFrame:
    """The columns ``names`` of a document with the item it holds; ``docs`` has doc_id and text as well."""
    blanks = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    n = items.agg(F.coalesce(F.sum(blanks), F.lit(0)) + F.count("*")).first()[0]
    if n > max_item_words:
        return _search_large(docs, items, percent, names)
    rows = items.select("item_id", "text").collect()  # bounded by the line above
    found = [(r["item_id"], r["text"]) for r in rows]
    if not any(words_of(t) for _, t in found):
        return docs.sparkSession.createDataFrame([], _schema(docs, names))
    return _search(docs, found, percent, names)


def contained_items(
    docs: DataFrame, items: DataFrame, percent: int = 80, max_item_words: int = MAX_ITEM_WORDS
) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_common) of every document that holds at least ``percent`` of
    an item's shingles. ``docs`` has doc_id and text, ``items`` item_id and text."""
    return _found(docs, items, percent, max_item_words, ["doc_id"])


def drop_contaminated(
    docs: DataFrame, items: DataFrame, percent: int = 80, max_item_words: int = MAX_ITEM_WORDS
) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns stay. A row is known by doc_id and text,
    so other rows with its doc_id, or without any, stay."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = {c: f"_row_{c}" for c in KEY}
    keyed = docs.withColumns({names[c]: column for c, column in row_key().items()})
    held = keyed.select("doc_id", "text", *names.values())
    bad = _found(held, items, percent, max_item_words, [*names.values()]).select(*names.values()).distinct()
    return keyed.join(bad, [*names.values()], "left_anti").select(*columns)
