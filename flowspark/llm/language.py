"""Language identification (7): known words first, then shorter and shorter character n-grams.

The model holds, per language, the log frequency of its common words and of the character n-grams
(4 down to 1 letters) of its words. A word that the model knows adds its log frequencies; an unseen
word is scored by its 4-grams, each unseen one by its 3-grams, and so on down to letters. Words are
runs of letters, lower-cased.

Fitting uses a sample of the labelled rows that hold letters: about ``sample`` rows per language, drawn by
a hash of doc_id and text, and at least one; of a language with fewer different texts than that, all rows.
Words and n-grams are counted by Spark, and of each kind the ``entries`` most frequent, in equal parts for
the languages but never less than ``LEAST_ENTRIES`` of one, are kept. An entry that a language lacks scores
the same in every language, so beyond ``DENSE_LANGUAGES`` languages only the others are stored. All languages
are learned; more than ``MAX_LANGUAGES`` are refused, so the model can be sent to every task.

Results for odd input: a null text or one without letters gets ``und`` and score 0; rows with a null
lang and labelled rows without letters teach nothing, and a language that has no others is not part of
the model; without any language every text is ``und``; ties go to the language that is first
by code point; repeated rows get the same answer; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 4
MAX_LANGUAGES = 1000
DENSE_LANGUAGES = 100
LEAST_ENTRIES = 1000
_NO_DIGITS = re.compile(r"[^\W\d_]+")
_CACHE = 10_000_000  # scores a task remembers, for 100,000 words at most


def letter_runs(text: str) -> list[str]:
    """Runs of letters (the classes of Unicode that start with L), as ``\\p{L}+`` finds them."""
    runs = _NO_DIGITS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    # other numbers, such as superscripts, fractions and Roman numerals, separate words as well
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass(frozen=True)
class SparseTable:
    """Rows of log frequencies that are the floor of the row but for the languages that have the entry."""

    begin: np.ndarray
    at: np.ndarray
    value: np.ndarray
    floor: np.ndarray
    width: int

    def __getitem__(self, k: int) -> np.ndarray:
        row = np.full(self.width, self.floor[k])
        own = slice(self.begin[k], self.begin[k + 1])
        row[self.at[own]] = self.value[own]
        return row

    def dense(self) -> np.ndarray:
        out = np.repeat(self.floor[:, None], self.width, axis=1)
        out[np.repeat(np.arange(len(self.floor)), np.diff(self.begin)), self.at] = self.value
        return out

    def then(self, other: SparseTable) -> SparseTable:
        """These rows and those of ``other``."""
        return SparseTable(
            np.concatenate([self.begin, other.begin[1:] + self.begin[-1]]), np.concatenate([self.at, other.at]),
            np.concatenate([self.value, other.value]), np.concatenate([self.floor, other.floor]), self.width,
        )


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies; row k of ``table`` belongs to the entry numbered k in ``words`` or ``grams``."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray | SparseTable
    unseen: np.ndarray

    def _gram_scores(self, word: str, size: int) -> np.ndarray:
        """Sum over the word's n-grams of this size, backing off to shorter ones."""
        total = np.zeros(len(self.languages))
        if len(word) < size:
            return self._gram_scores(word, size - 1)
        for i in range(len(word) - size + 1):
            gram = word[i : i + size]
            k = self.grams.get(gram)
            if k is not None:
                total += self.table[k]
            elif size > 1:
                # the shorter n-grams together count as one of this size
                total += self._gram_scores(gram, size - 1) / 2
            else:
                total += self.unseen
        return total

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequencies of a word per language."""
        k = self.words.get(word)
        if k is not None:
            return self.table[k]
        marked = f"_{word}_"
        size = min(LONGEST, len(marked))
        # an average n-gram, so that one long unseen word weighs like a word
        return self._gram_scores(marked, size) / (len(marked) - size + 1)

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        words = letter_runs((text or "").lower())
        if not words or not self.languages:
            return "und", 0.0
        total = np.zeros(len(self.languages))
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        most = min(100_000, _CACHE // len(self.languages))  # words at a time
        for first in range(0, len(counts), most):
            part = dict(islice(counts.items(), first, first + most))
            rows = np.empty((len(part), len(self.languages)))
            for k, w in enumerate(part):
                row = cache.get(w)
                if row is None:
                    if len(cache) >= most:
                        cache.clear()
                    row = cache[w] = self.word_scores(w)
                rows[k] = row
            total += np.array(list(part.values()), float) @ rows
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def _words(text: str):
    """Lower-cased runs of letters as an array column."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def _top(counts: DataFrame, kept: int) -> DataFrame:
    """The ``kept`` most frequent entries of each language, and each language's total."""
    by_lang = Window.partitionBy("lang")
    ranked = F.row_number().over(by_lang.orderBy(F.desc("n"), "entry"))
    return counts.withColumn("rank", ranked).filter(F.col("rank") <= kept).select("lang", "entry", "n")


def _last_hash(size, sample: int) -> int:
    """The highest hash of the rows drawn of a language."""
    if size["texts"] < sample or size["count"] <= sample:
        return (1 << 63) - 1
    return max(size["first"], sample * (1 << 64) // size["count"] - (1 << 63))


def fit(
    labelled: DataFrame, sample: int = 2000, entries: int = 100_000, max_languages: int = MAX_LANGUAGES
) -> LanguageModel:
    """Learn from the columns text, lang and, where there is one, doc_id, which tells equal texts apart in
    the draw; more than ``max_languages`` languages are an error."""
    key = [c for c in ("doc_id", "text") if c in labelled.columns]
    rows = labelled.filter("lang IS NOT NULL").filter(F.rlike("text", F.lit(r"\p{L}"))).select(
        "lang", "text", F.xxhash64(*key).alias("_h")
    )
    sizes = (
        rows.groupBy("lang").agg(
            F.count("*").alias("count"), F.countDistinct(F.xxhash64("text")).alias("texts"), F.min("_h").alias("first"),
        )
        .limit(max_languages + 1).collect()
    )
    if len(sizes) > max_languages:
        raise ValueError(f"the model holds at most {max_languages} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0)), np.zeros(0))
    spark = labelled.sparkSession
    # rows whose hash lies in the share, counted from the lowest hash; the first row always does
    lasts = spark.createDataFrame([(r["lang"], _last_hash(r, sample)) for r in sizes], "lang string, last bigint")
    drawn = rows.join(F.broadcast(lasts), "lang").filter(F.col("_h") <= F.col("last"))
    words = drawn.select("lang", F.explode(_words("text")).alias("entry")).groupBy("lang", "entry").agg(
        F.count("*").alias("n")
    ).cache()
    marked = F.concat(F.lit("_"), "entry", F.lit("_"))
    pieces = F.flatten(F.array(*[
        F.when(
            F.length("entry") + 2 >= size,
            F.transform(F.sequence(F.lit(1), F.length("entry") + 3 - size), lambda i: F.substring(marked, i, F.lit(size))),
        ).otherwise(F.array().cast("array<string>"))
        for size in range(1, LONGEST + 1)
    ]))
    grams = words.select("lang", F.explode(pieces).alias("entry"), "n").groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    # at most ``entries`` rows of each kind, or LEAST_ENTRIES of every language
    kept = max(entries // len(languages), min(entries, LEAST_ENTRIES))
    top_words = _top(words, kept).toArrow()
    top_grams = _top(grams, kept).toArrow()
    words.unpersist()
    word_rows, word_table, _ = _log_frequencies(top_words, languages, by_length=False)
    gram_rows, gram_table, floor = _log_frequencies(top_grams, languages, by_length=True)
    gram_rows = {gram: k + len(word_rows) for gram, k in gram_rows.items()}
    table = word_table.then(gram_table)
    if len(languages) <= DENSE_LANGUAGES:
        table = table.dense()
    return LanguageModel(languages, word_rows, gram_rows, table, np.full(len(languages), floor))


def _log_frequencies(found: pa.Table, languages: list[str], by_length: bool) -> tuple[dict[str, int], SparseTable, float]:
    """Row of each entry, the log frequencies by language, and the lowest of them. Frequencies are shares
    of all entries, or of those with the same number of letters; an entry that a language lacks counts half
    in the largest language's total, so that no language gains by having few words."""
    entries = found.column("entry").to_pylist()
    rows = {e: k for k, e in enumerate(sorted(set(entries)))}
    row = np.array([rows[e] for e in entries], np.int64)
    at = pc.index_in(found.column("lang"), pa.array(languages)).to_numpy().astype(np.int32)
    n = found.column("n").to_numpy().astype(float)
    length = np.array([len(e) if by_length else 0 for e in rows], np.int64)
    total = np.ones((length.max(initial=0) + 1, len(languages)))
    np.add.at(total, (length[row], at), n)
    floor = np.log(0.5 / total.max(axis=1))
    order = np.argsort(row, kind="stable")
    row, at, n = row[order], at[order], n[order]
    table = SparseTable(
        np.searchsorted(row, np.arange(len(rows) + 1)), at, np.log(n / total[length[row], at]).astype(np.float32),
        floor[length].astype(np.float32), len(languages),
    )
    return rows, table, min(-20.0, float(floor[np.unique(length)].min(initial=0)))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (any columns, one of them text) with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, np.ndarray] = {}  # a copy for each task

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t, cache) for t in texts]
        return pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_language", classify("text")).select(*[F.col(f"`{c}`") for c in kept], "_language.*")


def held_out(column: str = "doc_id"):
    """True for the fifth of the rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(rows.filter("NOT held_out"), **fitting)
    return predict(rows.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
