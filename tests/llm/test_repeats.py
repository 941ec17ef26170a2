"""Repeated passages (op4, op10) against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from flowspark.llm import repeats, substring_tree, suffix_array
from flowspark.llm.keys import row_key

SCHEMA = "doc_id bigint, text string, crc string, spans string, lo int"
BLANK = " \t\n\x0b\x0c\r"


def covered(docs, window):
    """Indices of units in windows that start at two places or more."""
    count = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if count[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append(gone)
    return out


def odd_texts(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "Ä", "日本", "e f"]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(14))
    texts = [None, "", " \t\n", "a", passage, passage, "a " * 300, "x" * 500, passage + "\n" + passage]
    for _ in range(30):
        words = [rnd.choice(vocabulary) + rnd.choice(BLANK) for _ in range(rnd.randint(1, 40))]
        if rnd.random() < 0.4:
            words.insert(rnd.randrange(len(words)), passage + " ")
        texts.append("".join(words))
    return texts


def table(spark, texts):
    # columns with the names that the operators use inside
    return spark.createDataFrame([(k, t, "x", "y", 1) for k, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed):
    texts = odd_texts(seed)
    docs = [(t or "").encode().split() for t in texts]
    want = covered(docs, 9)
    got = {r["doc_id"]: r for r in substring_tree.drop_repeated_words(table(spark, texts), 9).collect()}
    assert len(got) == len(texts)
    for k, (words, gone) in enumerate(zip(docs, want)):
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert (got[k]["n_words"], got[k]["n_removed"]) == (len(words), len(gone))
        assert got[k]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[k]["kept"] == kept.decode()


@pytest.mark.parametrize("seed", [3, 4])
def test_bytes_equal_brute_force(spark, seed):
    texts = odd_texts(seed)
    docs = [(t or "").encode() for t in texts]
    want = covered(docs, 24)
    got = {r["doc_id"]: r for r in suffix_array.drop_repeated_bytes(table(spark, texts), 24).collect()}
    for k, (raw, gone) in enumerate(zip(docs, want)):
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"]) == (len(raw), len(gone), spans)
        assert got[k]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def merged_spans(spark, docs, units, compare, group_units):
    rows = repeats.repeated_spans(docs, units, compare, group_units=group_units).collect()
    return {(r["k1"], r["k2"]): repeats.merge_spans([tuple(s) for s in r["spans"]]) for r in rows}


@pytest.mark.parametrize("words", [True, False])
def test_prefixes_grow_until_groups_fit(spark, words):
    """Every bound of the groups, from none that fits to all that do, gives the same windows."""
    docs = table(spark, odd_texts(5)).select("doc_id", "text").withColumns(row_key())
    units = repeats.Units(words, 9, 2) if words else repeats.Units(words, 24, 6)
    compare = (substring_tree.compare_words if words else suffix_array.compare_bytes)(units.window)
    want = merged_spans(spark, docs, units, compare, 1 << 19)
    assert want
    for bound in (0, 30, 120):
        assert merged_spans(spark, docs, units, compare, bound) == want


def test_one_prefix_of_very_many_texts_and_periodic_texts(spark):
    """30,000 different texts around one gram, two of them sharing a longer run; periodic texts of 500,000
    words, two of period 5 and different lengths, one word repeated."""
    def hash_of(gram):
        words, _ = repeats.Units(True, 35, 8).of(np.frombuffer(gram.encode(), np.uint8), np.array([0, len(gram)]))
        return int(repeats.range_hash(repeats.prefix_sums(words), np.array([0]), np.array([8]))[0])

    # the smallest hash of many, so that most texts have their anchor at it
    gram = min((" ".join(f"common{k}x{i}" for i in range(8)) for k in range(300)), key=hash_of)
    around = [
        " ".join([*(f"l{k}x{i}" for i in range(27)), gram, *(f"r{k}x{i}" for i in range(27))]) for k in range(30_000)
    ]
    twin = around[7] + " end"
    wave = [f"p{i % 5}" for i in range(500_000)]
    texts = around + [twin, " ".join(wave), " ".join(wave[:300_000]), "same " * 500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    out = substring_tree.repeated_words(docs, 35)
    got = {
        r["doc_id"]: sum(b - a for a, b in repeats.merge_spans([tuple(s) for s in r["spans"]]))
        for r in out.filter("spans IS NOT NULL").select("doc_id", "spans").collect()
    }
    assert got == {7: 62, 30_000: 62, 30_001: 500_000, 30_002: 300_000, 30_003: 500_000}


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    rnd = random.Random(6)
    units = np.array([rnd.randrange(3) for _ in range(1000)], np.uint64)
    found = set()
    for text, start, part, cut in repeats._pieces(units, np.array([0, 1000]), 8):
        for _, lo, hi, *_ in zip(*repeats.stretches(part, 8, 3, cut)):
            found.update(range(start + lo, start + hi + 1))
    assert found == set(range(993))


def test_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    assert [r["n_removed"] for r in substring_tree.drop_repeated_words(docs, 5).collect()] == [10] * 3
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_tree.drop_repeated_words(empty, 5).count() == 0
    assert suffix_array.drop_repeated_bytes(empty, 20).count() == 0


@pytest.mark.parametrize("few", [0, 1024])
def test_suffix_array(few, monkeypatch):
    monkeypatch.setattr(suffix_array, "_FEW_BUCKETS", few)
    rnd = random.Random(7)
    for _ in range(150):
        text = [rnd.randint(1, rnd.choice([2, 3, 20])) for _ in range(rnd.randint(1, 60))] + [0]
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array.suffix_array(np.array(text)).tolist() == want


def test_deep_nodes_of_a_subtree():
    units = np.array([5, 6, 7, 1, 5, 6, 7, 2, 5, 6, 0])
    leaves, common = substring_tree.subtree(units, 3)
    top, bottom = substring_tree.deep_nodes(leaves, common, 3)
    assert [sorted(leaves[a : b + 1].tolist()) for a, b in zip(top, bottom)] == [[0, 4]]
