"""N-gram Jaccard join (5): prefixes of token combinations.

Tokens are the distinct five-word shingles of a text. Two sets with Jaccard similarity of at least
``percent`` / 100 share all but ``slack(n)`` of a set's ``n`` tokens, so any slack + 1 of them hold a
shared one. The steps:

1. Equal sets become one class. 2. With tokens in hash order, a class stays in the search only if
enough of its first slack + n / 20 + 1 tokens also stand among the first tokens of other classes.
3. For these, document counts order all tokens from rare to frequent; the prefix is read in this
order. Rare tokens are indexed alone. Frequent ones fall into ``CLASSES`` token classes and are
indexed as pairs within their class; each class hides one token, so the prefix is extended until
single tokens and class members less one add up to slack + 1. Small sets, which might not reach
that, are also indexed by single tokens. 4. Members of an index entry are compared with its most central
member, the one with the smallest part of tokens that no other set has. Then members of different
components are paired, if two bounds allow it: tokens that only one of them has at all, and the bits
in which their parity sketches differ, both count against the overlap. Two members that both have more
than a ninth of such tokens are never similar, so only the others start pairs: very many texts around one
shared passage meet these few, not each other. Every comparison is exact.

Results for odd input: a text of fewer than five words is one shingle; null or blank texts have no
set and are linked with nothing; rows with the same doc_id count as one document; a component without any
doc_id is known by a number from 2**62 on; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.components import components
from flowspark.llm.keys import KEY, row_key
from flowspark.llm.text import mix, row_chunks, shingle_sets, texts_of
from flowspark.session import lookup_join, remove_path, scratch_path
from flowspark.llm.scratch import materialize

RARE = 32  # most sets with a token that is indexed alone
CLASSES = 32
# Sets below SINGLES_BELOW are indexed by single tokens, from PAIRS_FROM on by the classes: one below
# PAIRS_FROM has no similar set of SINGLES_BELOW or more, and every set from PAIRS_FROM on reaches its cover.
PAIRS_FROM, SINGLES_BELOW = 42, 53
SKETCH = 8  # longs of a parity sketch
HELD_TOKENS = 1_000_000  # tokens of the sets that a task counts at once


def slack(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that a similar set may lack."""
    return n - -(-n * percent // 100)


def _set_name(tokens: np.ndarray) -> tuple[int, int]:
    h1 = np.add.reduce(mix(tokens + np.uint64(1)))
    h2 = np.add.reduce(mix(tokens ^ np.uint64(0x5555555555555555)))
    return int(h1.view(np.int64)), int(h2.view(np.int64))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of 64 * SKETCH bins. Two sets differ in at least as many
    tokens as their sketches in bits."""
    bins = np.bincount((tokens % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bins.astype(np.uint8)).view(np.int64)


def shingles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (name of the set), and the first tokens in hash order, counted among
    the sets that a task holds at once: ``known`` of them stand in several of its sets, ``lone`` are the
    others, ``shown`` the known ones that this set shows to other tasks.

    A set of many copies, or a token of very many sets, is one row per task from there on.
    """
    schema = "doc_id bigint, n int, h1 bigint, h2 bigint, known int, lone array<bigint>, shown array<bigint>"

    def counted(held):
        ids = pa.concat_arrays([h[0] for h in held])
        sets = [x for h in held for x in h[1]]
        names = [(*_set_name(t), k) if k else (0, 0, 0) for t, k in sets]
        prefixes, seen = [], set()
        for (tokens, n), name in zip(sets, names):
            fresh = n > 0 and name not in seen
            seen.add(name)
            prefixes.append(tokens[: slack(n, percent) + n // 20 + 1] if fresh else tokens[:0])
        owner = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
        flat = np.concatenate(prefixes)
        _, first, at, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        several = count[at] > 1
        shows = several & (first[at] == np.arange(len(flat)))

        def lists(mask):
            ends = np.searchsorted(owner[mask], np.arange(len(prefixes) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[mask].view(np.int64)))

        h1, h2, n = zip(*names)
        known = np.bincount(owner[several], minlength=len(prefixes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                ids, pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(known),
                lists(~several), lists(shows),
            ],
            names=["doc_id", "n", "h1", "h2", "known", "lone", "shown"],
        )

    def run(batches):
        held, size_held = [], 0
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            for first, last in row_chunks(bounds):
                sets = [(t, len(t)) for t in shingle_sets(data, bounds[first : last + 1], size)]
                held.append((batch.column("doc_id").slice(first, last - first), sets))
                size_held += sum(k for _, k in sets)
                if size_held >= HELD_TOKENS:
                    yield from counted(held)
                    held, size_held = [], 0
        if held:
            yield from counted(held)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _node() -> Column:
    """A class is known by its smallest doc_id; one without any by a number from 2**62 on."""
    name = F.xxhash64(F.min("h1"), F.min("h2")).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    return F.coalesce(F.min("doc_id"), name).alias("node")


def classes_in_search(sets: DataFrame) -> DataFrame:
    """(node, h1, h2) of the classes that share enough first tokens with other classes."""
    by_token = Window.partitionBy("token")
    lone = sets.select("h1", F.explode("lone").alias("token"), F.lit(True).alias("asks"))
    shown = sets.select("h1", F.explode("shown").alias("token"), F.lit(False).alias("asks"))
    found = (
        lone.unionByName(shown)
        .withColumn("low", F.min("h1").over(by_token)).withColumn("high", F.max("h1").over(by_token))
        .filter("asks AND low <> high").select("h1", F.lit(1).alias("k"))
    )
    # copies in several tasks count more than once, which only keeps a class in
    shared = found.unionByName(sets.filter("known > 0").select("h1", F.col("known").alias("k")))
    shared = shared.groupBy("h1").agg(F.sum("k").alias("shared"))
    classes = sets.filter("n > 0").groupBy("h1", "h2", "n").agg(_node())
    # a similar set has at least 4/5 of the tokens, and the one whose prefix ends first sets the count
    return classes.join(shared, "h1").filter("shared >= n div 25 + 1").select("node", "h1", "h2", "n")


def class_tokens(docs: DataFrame, sets: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, tokens, sketch) of the wanted classes."""
    rows = sets.select("doc_id", "h1", "h2").join(wanted, ["h1", "h2"])
    # one document of each class
    chosen = rows.groupBy("node", "h1", "h2").agg(F.min("doc_id").alias("id"))
    texts = docs.select("doc_id", "text").join(chosen, docs["doc_id"].eqNullSafe(chosen["id"]))
    schema = "node bigint, n int, tokens array<bigint>, sketch array<bigint>"

    def run(batches):
        for batch in batches:
            data, bounds = texts_of(batch.column("text"))
            for first, last in row_chunks(bounds):
                names = batch.slice(first, last - first)
                names = zip(*(names.column(c).to_pylist() for c in ("node", "h1", "h2")))
                # rows that share the doc_id may have another text
                found = [
                    (node, t) for (node, *name), t in zip(names, shingle_sets(data, bounds[first : last + 1], size))
                    if len(t) and (*name,) == _set_name(t)
                ]
                if not found:
                    continue
                ends = np.append(0, np.cumsum([len(t) for _, t in found])).astype(np.int32)
                tokens = np.concatenate([t for _, t in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node for node, _ in found], pa.int64()),
                        pa.array(np.diff(ends), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens)),
                        pa.array([_sketch(t) for _, t in found], pa.list_(pa.int64())),
                    ],
                    names=["node", "n", "tokens", "sketch"],
                )

    return texts.select("node", "h1", "h2", "text").mapInArrow(run, schema).dropDuplicates(["node", "n", "sketch", "tokens"])


def entries_of(n: int, counts: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set of ``n`` tokens; ``tokens`` are those that other sets have too."""
    order = np.lexsort((tokens, counts))
    tokens, frequent = mix(tokens[order].view(np.uint64)), counts[order] > RARE
    need = slack(n, percent) + 1 - (n - len(tokens))
    if need <= 0:
        return tokens[:0]
    out = []
    if n < SINGLES_BELOW:
        out.append(tokens[:need])
    if n >= PAIRS_FROM:
        kind = np.where(frequent, (tokens % np.uint64(CLASSES)).astype(np.int64), -1)
        counted = np.ones(len(tokens), np.int64)
        kinds, at = np.unique(kind, return_index=True)
        counted[at[kinds >= 0]] = 0
        stop = int(np.searchsorted(np.cumsum(counted), need)) + 1
        out.append(tokens[:stop][~frequent[:stop]])
        for k in kinds[kinds >= 0]:
            members = np.sort(tokens[:stop][kind[:stop] == k])
            i, j = np.triu_indices(len(members), 1)
            out.append(mix(members[i] + mix(members[j])))
    return np.unique(np.concatenate(out))


def index_entries(tokens: DataFrame, percent: int) -> DataFrame:
    """(entry, node, n, alone) for the classes of ``tokens``; alone counts the tokens of no other set."""
    by_token = Window.partitionBy("token")
    shared = (
        tokens.select("node", "n", F.explode("tokens").alias("token"))
        .withColumn("sets", F.count("*").over(by_token))
        .filter("sets > 1")
        .groupBy("node", "n").agg(F.collect_list(F.struct("sets", "token")).alias("shared"))
    )
    schema = "entry bigint, node bigint, n int, alone int"

    def run(batches):
        for batch in batches:
            lists = batch.column("shared")
            ends = lists.offsets.to_numpy()
            flat = lists.values
            counts, names = flat.field("sets").to_numpy(), flat.field("token").to_numpy()
            for k, (node, n) in enumerate(zip(batch.column("node").to_pylist(), batch.column("n").to_pylist())):
                part = slice(ends[k], ends[k + 1])
                found = entries_of(n, counts[part], names[part], percent)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.view(np.int64)), pa.array(np.full(len(found), node)),
                            pa.array(np.full(len(found), n, np.int32)),
                            pa.array(np.full(len(found), n - (ends[k + 1] - ends[k]), np.int32)),
                        ],
                        names=["entry", "node", "n", "alone"],
                    )

    return shared.mapInArrow(run, schema)


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = tokens.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    return (
        pairs.join(right, "b").join(left, "a")
        .filter(both * 100 >= (F.col("na") + F.col("nb") - both) * percent)
        .select("a", "b")
    )


def _may_link(percent: int, other: str = "2") -> Column:
    """False for pairs that sizes and lone tokens rule out: an upper bound of the overlap is too small."""
    a, b = (F.col(f"n{x}") - F.col(f"alone{x}") for x in ("", other))
    most = F.least(a, b)
    return most * 100 >= (F.col("n") + F.col(f"n{other}") - most) * percent


def _sketches_fit(percent: int) -> Column:
    bits = F.lit(0)
    for k in range(SKETCH):
        bits = bits + F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch2")[k]))
    total = F.col("n") + F.col("n2")
    return (total - bits) * (100 + percent) >= total * (2 * percent)


def meetings(placed: DataFrame, percent: int) -> DataFrame:
    """Members of one entry and of different components that may be similar, once each, the second one's columns
    ending in 2.

    Of N tokens that two sets have together, A in one set of all only, at most N - A are in both, counted twice;
    a similarity of ``percent`` needs A * (100 + percent) <= N * (100 - percent). One of them then has no
    larger part of its own tokens alone, and stands first.
    """
    few = F.expr(f"alone * {100 + percent}L <= n * {100 - percent}L")
    first = placed.withColumn("few", few).filter("few").drop("few")
    other = placed.withColumn("few", few)
    other = other.select("entry", *(F.col(c).alias(f"{c}2") for c in other.columns if c != "entry"))
    once = (F.col("root") != F.col("root2")) & (~F.col("few2") | (F.col("root") < F.col("root2")))
    return first.join(other, "entry").filter(once).drop("few2")


def similar_classes(tokens: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all similar classes, and their components (node, root)."""
    entries = materialize(index_entries(tokens, percent), "entries")
    by_entry = Window.partitionBy("entry")
    central = F.struct((F.col("alone") / F.col("n")).alias("part"), "node", "n", "alone")
    hub = (
        entries.withColumn("hub", F.min(central).over(by_entry))
        .select(
            F.col("hub.node").alias("a"), F.col("hub.n").alias("n2"), F.col("hub.alone").alias("alone2"),
            F.col("node").alias("b"), "n", "alone",
        )
        .filter((F.col("a") != F.col("b")) & _may_link(percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    links = materialize(verified(hub, tokens, percent), "links")
    found = components(links, "a", "b")
    placed = (
        entries.join(found, "node", "left")
        .select("entry", "node", "n", "alone", F.coalesce("root", "node").alias("root"))
        .withColumn("low", F.min("root").over(by_entry))
        .withColumn("high", F.max("root").over(by_entry))
        .filter("low <> high").drop("low", "high")
        .join(tokens.select("node", "sketch"), "node")
    )
    placed = materialize(placed, "placed")
    rest = (
        meetings(placed, percent).filter(_may_link(percent) & _sketches_fit(percent))
        .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    )
    more = materialize(verified(rest, tokens, percent), "links")
    links = links.unionByName(more)
    return links, components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "a", "b")


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    if percent < 80:
        raise ValueError("the bounds of the prefixes hold from 80 percent on")
    path = scratch_path(docs.sparkSession, "shingles")
    prefixes = materialize(shingles(docs, size, percent), "shingles", path)
    wanted = materialize(classes_in_search(prefixes), "classes")
    # the prefixes have served; the names of the sets go on
    sets = materialize(prefixes.select("doc_id", "n", "h1", "h2"), "sets")
    remove_path(docs.sparkSession, path)
    tokens = materialize(class_tokens(docs, sets, wanted, size), "tokens")
    _, found = similar_classes(tokens, percent)
    classes = sets.filter("n > 0").groupBy("h1", "h2").agg(_node())
    roots = classes.join(found, "node", "left").select(
        "h1", "h2", F.coalesce("root", "node").alias("component_id")
    )
    rows = sets.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "h1", "h2")
    joined = rows.join(roots, ["h1", "h2"], "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of the smallest doc_id. Rows without a
    set stay, equal ones once.

    A row is known by doc_id and text: rows without doc_id, and rows whose doc_id others have as well, are
    told apart by numbers from 2**62 on, so no text is lost to another one's doc_id; they give way to rows
    that are alone with their doc_id.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = [f"_row_{c}" for c in KEY]
    keyed = docs.withColumns({f"_row_{c}": column for c, column in row_key().items()})
    shared = (
        keyed.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1 OR doc_id IS NULL")
        .select(F.col("doc_id").alias("_shared"))
    )
    # numbers follow tasks, so they are written before they are used
    numbers = materialize(
        keyed.join(shared, keyed["doc_id"].eqNullSafe(shared["_shared"]), "left_semi").select(*names).distinct()
        .withColumn("_row_number", F.monotonically_increasing_id() + F.lit(1 << 62)),
        "row-numbers",
    )
    keyed = lookup_join(keyed, numbers, names).withColumn("_row_name", F.coalesce("_row_number", "doc_id"))
    found = similar_documents(keyed.select(F.col("_row_name").alias("doc_id"), "text"), size, percent)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_row_name")).distinct()
    # rows with one key are equal in doc_id and text
    first = F.row_number().over(Window.partitionBy("_row_name").orderBy(F.xxhash64(*columns)))
    return keyed.join(stay, "_row_name", "left_semi").withColumn("_row_nth", first).filter("_row_nth = 1").select(*columns)
