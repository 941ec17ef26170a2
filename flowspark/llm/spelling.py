"""Spelling variant grouping (11): Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced letter makes one of the other. A word's own edits are
probed against Bloom filters of the vocabulary, one per word length, of 64-bit blocks: a word of L letters
probes its deletions in the filter of L - 1, and at each place the smaller letters of the alphabet in the filter
of L. So each pair is met from one side only, and exactly once. Hashes of edits follow from the word's own hash
without building the text; only positives become text and are shuffled to a join with the vocabulary, which
removes the false ones.

The filters take ``BITS`` bits a word and travel to the tasks. Beyond ``max_bytes`` they are cut by hash into
groups of at most that size, and each group is sent and probed in turn; results do not depend on it.

The form of a word is its near word of largest count (ties: the smallest in code-point order), if that is
``ratio`` times its own or more; following forms leads to its root. A form's count grows by ``ratio`` at each
step, so the largest count bounds the way, and rounds of pointer doubling end it.

Results for odd input: a null or empty text has no words; a null doc_id reads as an empty one; repeated rows
count again; a very long run is a word like others (it is probed only if words of its length or of one less
exist); an empty table gives an empty result; other columns are ignored. A vocabulary given by the caller
has distinct words of letters of ``LETTERS`` only, and counts above zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.scratch import materialize
from flowspark.llm.text import BASE, mix, powers

RUN = "[a-zÀ-ÿ]"
LETTERS = bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0xC0, 0x100))  # of RUN, in Latin-1
BITS, HASHES = 24, 5
MAX_FILTER_BYTES = 32 * 1024 * 1024
_CHUNK = 1 << 20  # edits hashed at once
_NUMBER = np.zeros(256, np.int64)  # 1 for the first letter
_NUMBER[list(LETTERS)] = np.arange(1, len(LETTERS) + 1)


# -- vocabulary -------------------------------------------------------------------------------
def drop_letter(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run without the letter that its checksum names, where ``every`` divides the checksum."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    place = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def count_words(
    docs: DataFrame, least_letters: int = 7, least_n: int = 2,
    spell: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(word, n): runs of letters in ``text`` with A-Z lower-cased. ``spell`` gives the word for (doc_id, run),
    which must not be longer than the run."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a shorter run gives no word that is long enough
    runs = F.regexp_extract_all(lower, F.lit(f"{RUN}{{{least_letters},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("_run"))
    word = F.col("_run") if spell is None else spell(F.col("doc_id"), F.col("_run"))
    counted = rows.select(word.alias("word")).filter(F.length("word") >= least_letters)
    return counted.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


# -- hashes of words and of their edits -------------------------------------------------------
def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: places of the words of that length, and their letters' numbers as a matrix."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    numbers = _NUMBER[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    if not numbers.all():
        raise ValueError("words hold letters outside the alphabet")
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, _CHUNK // (max(length, 1) * 16))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield length, part, numbers[starts[part][:, None] + np.arange(length)]


def _terms(numbers: np.ndarray) -> np.ndarray:
    """Terms of the words' hashes: a word's hash is the sum of its row."""
    return numbers.astype(np.uint64) * powers(numbers.shape[1])[0][: numbers.shape[1]]


def _masks(x: np.ndarray, first: int = 0) -> np.ndarray:
    """The bits of a block that a mixed hash sets, from the ``first`` one on."""
    out = np.zeros(len(x), np.uint64)
    for j in range(first, HASHES):
        out |= np.uint64(1) << ((x >> np.uint64(6 * j)) & np.uint64(63))
    return out


@dataclass(frozen=True)
class Shapes:
    """Blocks (as a power of two) of each length's filter, and groups (as a power of two) they are cut into."""

    log_blocks: dict[int, int]
    log_groups: int

    @classmethod
    def plan(cls, n_words: dict[int, int], max_bytes: int) -> Shapes:
        logs = {length: max(0, (n * BITS // 64).bit_length()) for length, n in n_words.items()}
        total = sum(8 << log for log in logs.values())
        return cls(logs, max(0, (-(-total // max_bytes) - 1).bit_length()))

    def groups_of(self, length: int) -> int:
        """Groups a length's filter is cut into; a small one stays whole, in the first."""
        return self.log_groups if self.log_blocks[length] >= self.log_groups else 0

    def block(self, length: int, x: np.ndarray) -> np.ndarray:
        log = self.log_blocks[length]
        return (x >> np.uint64(64 - log)).astype(np.int64) if log else np.zeros(len(x), np.int64)


def _filter_rows(vocabulary: DataFrame, shapes: Shapes) -> DataFrame:
    """(length, block, bits): the blocks that are not empty."""

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, _, numbers in _by_length(words):
                x = mix(_terms(numbers).sum(axis=1, dtype=np.uint64))
                block = shapes.block(length, x)
                columns = [np.full(len(x), length), block, _masks(x).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["length", "block", "bits"]
                )

    rows = vocabulary.select("word").mapInArrow(run, "length bigint, block bigint, bits bigint")
    return rows.groupBy("length", "block").agg(F.expr("bit_or(bits)").alias("bits"))


def _fetch_group(rows: DataFrame, shapes: Shapes, group: int) -> dict[int, np.ndarray]:
    """The filters of one group, at most ``max_bytes`` in all, by length."""
    size = {length: 1 << (log - shapes.groups_of(length)) for length, log in shapes.log_blocks.items()}
    cut = shapes.log_groups
    mine = {k: s for k, s in size.items() if group == 0 or shapes.groups_of(k) == cut}
    low = F.lit(None).cast("bigint")
    for length, s in mine.items():
        low = F.when(F.col("length") == length, F.lit(group * s)).otherwise(low)
    if cut:  # only the rows of this group
        high = F.lit(None).cast("bigint")
        for length, s in mine.items():
            high = F.when(F.col("length") == length, F.lit((group + 1) * s)).otherwise(high)
        rows = rows.filter((F.col("block") >= low) & (F.col("block") < high))
    found = rows.toArrow()
    lengths, blocks, bits = (found.column(c).to_numpy() for c in ("length", "block", "bits"))
    out = {}
    for length, s in mine.items():
        table = np.zeros(s, np.uint64)
        mask = lengths == length
        table[blocks[mask] - group * s] = bits[mask].view(np.uint64)
        out[length] = table
    return out


def _positives(
    x: np.ndarray, length: int, filters: dict[int, np.ndarray], shapes: Shapes, group: int
) -> np.ndarray:
    """Places of the hashes that the length's filter of this group may hold."""
    table = filters.get(length)
    if table is None:
        return np.zeros(0, np.int64)
    block = shapes.block(length, x)
    block -= group * len(table)
    places = None
    if shapes.groups_of(length):
        places = np.flatnonzero((block >= 0) & (block < len(table)))
        x, block = x[places], block[places]
    bits = table[block]
    # most edits fail at the first bit
    hit = np.flatnonzero((bits >> (x & np.uint64(63))) & np.uint64(1))
    mask = _masks(x[hit], 1)
    hit = hit[(bits[hit] & mask) == mask]
    return hit if places is None else places[hit]


def _deletions(numbers, terms, length, filters, shapes, group) -> Iterator[tuple[int, int]]:
    """(row, place) of letters without which the word may be one."""
    before = np.cumsum(terms, axis=1, dtype=np.uint64)
    after = before[:, -1:] - before
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    hashes = before - terms + after * inverse
    # one deletion of each run of equal letters
    use = np.ones(numbers.shape, bool)
    use[:, 1:] = numbers[:, 1:] != numbers[:, :-1]
    flat = np.flatnonzero(use)
    hit = _positives(mix(hashes.ravel()[flat]), length - 1, filters, shapes, group)
    for f in flat[hit].tolist():
        yield divmod(f, length)


def _replacements(numbers, terms, length, filters, shapes, group) -> Iterator[tuple[int, int, int]]:
    """(row, place, number of the new letter), the new letter being smaller than the old one."""
    whole = terms.sum(axis=1, dtype=np.uint64)
    rest = (whole[:, None] - terms).ravel()
    scale = np.broadcast_to(powers(length)[0][:length], numbers.shape).ravel()
    smaller = numbers.ravel() - 1
    ends = np.cumsum(smaller)
    first = 0
    while first < len(smaller):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + _CHUNK, "right")))
        count = smaller[first:last]
        letter = np.arange(1, count.sum() + 1) - np.repeat(np.cumsum(count) - count, count)
        hashes = np.repeat(rest[first:last], count)
        hashes += np.repeat(scale[first:last], count) * letter.astype(np.uint64)
        hit = _positives(mix(hashes), length, filters, shapes, group)
        if len(hit):
            cells = np.searchsorted(np.cumsum(count), hit, "right") + first
            for cell, new in zip(cells.tolist(), letter[hit].tolist()):
                yield (*divmod(cell, length), new)
        first = last


def _candidates(vocabulary: DataFrame, filters: dict[int, np.ndarray], shapes: Shapes, group: int) -> DataFrame:
    """(near, word, n): edits that the filters of this group let pass."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(filters)
    letters = " " + LETTERS.decode("latin-1")

    def run(batches):
        held = shared.value
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for length, places, numbers in _by_length(words):
                terms = _terms(numbers)
                found = []
                if length - 1 in held:
                    for row, at in _deletions(numbers, terms, length, held, shapes, group):
                        word = words[places[row]]
                        found.append((word[:at] + word[at + 1 :], places[row]))
                if length in held:
                    for row, at, new in _replacements(numbers, terms, length, held, shapes, group):
                        word = words[places[row]]
                        found.append((word[:at] + letters[new] + word[at + 1 :], places[row]))
                if found:
                    at = np.fromiter((k for _, k in found), np.int64, len(found))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([text for text, _ in found], pa.string()),
                            batch.column("word").take(pa.array(at)).cast(pa.string()),
                            pa.array(counts[at], pa.int64()),
                        ],
                        names=["near", "word", "n"],
                    )

    return vocabulary.select("word", "n").mapInArrow(run, "near string, word string, n bigint")


def near_pairs(vocabulary: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): every pair of near words once. ``vocabulary`` (word, n) is read several times
    and should be a written table."""
    counts = vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()
    # a filter is probed by words of its own length and of one more
    n_words = {r["length"]: r["n"] for r in counts}
    used = {k: n for k, n in n_words.items() if n > 1 or k + 1 in n_words}
    shapes = Shapes.plan(used, max_bytes)
    kept = vocabulary.filter(F.length("word").isin(sorted(used))) if len(used) < len(n_words) else vocabulary
    rows = _filter_rows(kept, shapes)
    if shapes.log_groups:
        rows = materialize(rows, "filters")
    found = None
    for group in range(1 << shapes.log_groups):
        part = _candidates(vocabulary, _fetch_group(rows, shapes, group), shapes, group)
        found = part if found is None else found.unionByName(part)
    words = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(words, "near").select("word", "n", "near", "near_n")


# -- forms and roots --------------------------------------------------------------------------
def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) from (word, form): pointers doubled ``rounds`` times."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        further = out.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        out = materialize(
            out.join(further, out["root"] == further["_word"], "left")
            .select("word", F.coalesce("_root", "root").alias("root")),
            "roots",
        )
    return out


def group_variants(vocabulary: DataFrame, ratio: int = 10, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary`` (word, n)."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could run in circles")
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_pairs(vocabulary, max_bytes)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("near").alias("near"), F.col("near_n").alias("near_n")),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )).alias("p")).select("p.*")
    best = both.groupBy(F.col("word").alias("_word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best")
    )
    joined = vocabulary.join(best, vocabulary["word"] == best["_word"], "left")
    enough = -F.col("_best.m") >= ratio * F.col("n")
    formed = materialize(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best.m")).alias("form_n"),
        ),
        "forms",
    )
    low, high = formed.agg(F.min("n"), F.max("n")).first()
    steps, n = 0, low
    while n is not None and n * ratio <= high:
        n *= ratio
        steps += 1
    rounds = max(0, (steps - 1).bit_length()) if steps else 0
    found = roots(formed.filter("form IS NOT NULL"), rounds).withColumnRenamed("word", "_word")
    return (
        formed.join(found, formed["word"] == found["_word"], "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
