"""N-gram Jaccard join (op5) against brute force."""

import random

import numpy as np
import pytest

from flowspark.llm import ngram_join
from flowspark.llm.components import components


def shingle_set(text, size=5):
    words = [w.translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))) for w in (text or "").encode().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def edited(words, n, rnd):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**9)}"
    return out


def sample(seed):
    rnd = random.Random(seed)
    rows = [None, "", "  \n", "Hello", "hello", "a b c d e", "A B C D E", "a b c d"]
    passage = [f"p{k}" for k in range(60)]
    for size in (6, 9, 30, 46, 50, 60, 120, 400):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(size)]
        for k in range(8):
            rows.append(" ".join(edited(base, k % 5, rnd)))
        rows.append(" ".join(base).upper())
    # a large group of near copies, and a passage that many texts share
    base = [f"n{k}" for k in range(150)]
    rows += [" ".join(edited(base, rnd.randint(1, 8), rnd)) for _ in range(60)]
    rows += [" ".join(passage + [f"u{rnd.randrange(10**9)}" for _ in range(rnd.choice([10, 30, 90]))]) for _ in range(60)]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,rare", [(1, 32), (2, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rows = sample(seed)
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id bigint, text string, n int, node string")
    found = ngram_join.similar_documents(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)
    assert len(found) == len(rows)


def test_many_texts_around_a_passage_do_not_meet_each_other(spark):
    """20,000 members of one entry with 15 % of their tokens alone meet two others, and no pair twice."""
    many = [(1, k, 100, 15, k) for k in range(20_000)]
    rows = [*many, (1, 20_000, 100, 5, 20_000), (1, 20_001, 95, 0, 20_001), (2, 5, 100, 15, 5), (2, 6, 100, 15, 6)]
    placed = spark.createDataFrame(rows, "entry long, node long, n int, alone int, root long")
    met = ngram_join.meetings(placed, 80)
    assert met.count() == 2 * 20_000 + 1
    assert met.selectExpr("least(node, node2) AS a", "greatest(node, node2) AS b").distinct().count() == 2 * 20_000 + 1


def test_no_similar_pair_fails_to_meet(spark):
    """All pairs of small sets: those that sizes and lone tokens allow meet."""
    kinds = [(n, alone) for n in (5, 9, 10, 18, 20, 45, 50) for alone in range(0, n // 3 + 1)]
    rows = [(1, k, n, alone, k) for k, (n, alone) in enumerate(kinds)]
    placed = spark.createDataFrame(rows, "entry long, node long, n int, alone int, root long")
    met = {frozenset(r) for r in ngram_join.meetings(placed, 80).select("node", "node2").collect()}
    for i, (n, a) in enumerate(kinds):
        for j, (m, b) in enumerate(kinds[:i]):
            both = min(n - a, m - b)
            if 100 * both >= 80 * (n + m - both):
                assert frozenset((i, j)) in met


@pytest.mark.parametrize("own", [12, 18, 24])
def test_texts_around_a_passage_equal_brute_force(spark, own):
    rnd = random.Random(own)
    passage = [f"p{k}" for k in range(110)]
    rows = [" ".join(passage + [f"u{rnd.randrange(10**9)}" for _ in range(own)]) for _ in range(80)]
    rows += [" ".join(edited(passage, k % 3, rnd) + [f"u{k // 2}x{i}" for i in range(own)]) for k in range(20)]
    rows = list(enumerate(rows + [" ".join(passage), " ".join(passage[:100])]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = ngram_join.similar_documents(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows)


def test_every_similar_pair_shares_an_entry():
    rnd = random.Random(3)
    for n in [1, 2, 5, 20, 41, 42, 52, 53, 70, 300]:
        for frequent in (0.0, 0.5, 1.0):
            universe = np.array([rnd.getrandbits(63) for _ in range(2 * n)], np.int64)
            counts = np.where(np.random.default_rng(n).random(2 * n) < frequent, 500, 5)
            x = np.arange(n)
            lost = ngram_join.slack(n, 80) // 2
            y = np.append(x[lost:], np.arange(n, n + lost))
            both = n - lost
            if both * 100 < 80 * (2 * n - both):
                continue
            a, b = (ngram_join.entries_of(n, counts[s], universe[s], 80) for s in (x, y))
            assert len(np.intersect1d(a, b)) > 0


def test_unnamed_and_repeated_rows(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (3, "Other words"), (None, "alone here")], "doc_id bigint, text string")
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in ngram_join.similar_documents(docs).collect())
    assert found[:3] == [(False, 3, 3), (False, 7, 7), (False, 7, 7)]
    assert sorted(c == 7 for _, _, c in found[3:]) == [False, True] and max(c for *_, c in found) >= 1 << 62
    left = ngram_join.drop_similar(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == [(0, "alone here"), (3, "Other words"), (7, text)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.similar_documents(empty).count() == 0 and ngram_join.drop_similar(empty).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert found == {k: 0 for k in range(1, 41)} | {101: 100}
