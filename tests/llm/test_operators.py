"""The other training-data operators on small and odd tables."""

import collections
import heapq
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import (
    decontaminate, language, line_templates, mixing, quality, queries, sharding, token_counts,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANKS = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(BLANKS, text or "") if w]


def odd(spark, extra=()):
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 3), (None, "the cat 12", "en", None, 3),
        (5, "x" * 3000, "en", "b", 1), (6, "the cat sat on the mat\n" * 50, "en", "b", 1), (6, "the cat sat on the mat\n" * 50, "en", "b", 1),
        (7, "Ünïcode 日本語 ☃ line", "de", "é", 1), *extra,
    ]
    # clashing names are allowed in further columns
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "target", "shard", "score", "_h", "tokens")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 mixing -------------------------------------------------------------------------------------
def water_fill(sizes, weights, percent=150, most=2):
    total, stopped = percent / 100 * sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in stopped]
        share = (total - sum(most * sizes[i] for i in stopped)) / max(1, sum(weights[i] for i in open_))
        new = {i for i in open_ if share * weights[i] > most * sizes[i]}
        if not new:
            return [most * s if i in stopped else share * weights[i] for i, s in enumerate(sizes)]
        stopped |= new


def test_targets_are_filled_like_water(spark):
    rnd = random.Random(1)
    for n in (1, 2, 7, 20):
        sizes = [rnd.choice([0, 5, 100, 10_000]) for _ in range(n)]
        table = spark.createDataFrame([(f"s{k:02d}", s) for k, s in enumerate(sizes)], "source string, source_size bigint")
        got = [r["target"] for r in mixing.source_targets(table).orderBy("source").collect()]
        assert got == pytest.approx(water_fill(sizes, [mixing.WEIGHTS[k % 3] for k in range(n)]))


def highest_quotients(shares, seats):
    won = [0] * len(shares)
    for _ in range(seats):
        k = max(range(len(shares)), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_seats_go_to_the_highest_quotients(spark):
    rnd = random.Random(2)
    for _ in range(3):
        shares = [rnd.randint(0, 1000) for _ in range(12)]
        table = spark.createDataFrame([("g", k, s) for k, s in enumerate(shares)], "g string, k int, share bigint")
        out = mixing.apportion(table, ["g"], ["k"], "share", F.lit(97)).orderBy("k").collect()
        assert [r["quota"] for r in out] == highest_quotients(shares, 97)


def heap_quotients(shares, seats):
    """The same for many parties: the next quotient of each waits in a heap."""
    won, heap = [0] * len(shares), [(-float(s), k) for k, s in enumerate(shares) if s > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-shares[k] / (2 * won[k] + 1), k))
    return won


@pytest.mark.parametrize("shares, seats", [
    ([160_000] + [9] * 2000, 11_125),  # one large party beside many small ones
    ([9] * 500 + [160_000], 3), ([7] * 300, 100), ([1] * 50, 175), ([5, 0, 0], 4), ([0, 0], 3), ([3, 2], 0),
    ([10**9, 1, 1], 40),
])
def test_seats_of_uneven_shares(spark, shares, seats):
    assert heap_quotients([3, 5, 9], 7) == highest_quotients([3, 5, 9], 7)
    table = spark.createDataFrame(
        [(g, k, s) for g in ("g", None) for k, s in enumerate(shares)], "g string, k int, share bigint"
    )
    out = mixing.apportion(table, ["g"], ["k"], "share", F.lit(seats)).collect()
    want = heap_quotients(shares, seats)
    for g in ("g", None):
        assert [r["quota"] for r in sorted(out, key=lambda r: r["k"]) if r["g"] == g] == want


def plain_mix(rows, shard_rows, block=16):
    """Words taken of each (doc_id, source, size, hash), read one after the other."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r[2] for r in by[s]) for s in sources]
    targets = water_fill(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(sources))])
    blocks = heap_quotients(targets, int(sum(targets) / block + 0.5))
    taken = collections.Counter()
    for s, quota in zip(sources, blocks):
        n = -(-len(by[s]) // shard_rows)
        streams = [sorted((r[3], r[0], r[2]) for r in by[s] if r[3] % n == k) for k in range(n)]
        totals = [sum(r[2] for r in stream) for stream in streams]
        for k, (stream, q) in enumerate(zip(streams, heap_quotients(totals, quota))):
            want, total = min(q * block, 2 * totals[k]), totals[k]
            whole = want // total if total else 0
            begin = yield_begin(s, k, -(-total // block)) * block
            marks = [(begin + x) % total for x in range(want - whole * total)] if total else []
            line = [d for _, d, size in stream for _ in range(size)]
            if total and begin + want - whole * total > total and begin > total:
                raise AssertionError("a run begins inside its stream")
            for d in line:
                taken[d] += whole
            for x in marks:
                taken[line[x]] += 1
    return taken


def yield_begin(source, shard, blocks):
    return BEGINS[source, shard] % max(1, blocks)


BEGINS = {}


def test_mix_equals_a_plain_stream(spark):
    rnd = random.Random(8)
    docs = [(k, rnd.choice(["a", "a", "a", "b", None]), " ".join(["w"] * rnd.choice([0, 1, 7, 40, 300]))) for k in range(150)]
    table = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    narrow = [tuple(r) for r in mixing.sizes_of(table).collect()]
    keys = spark.createDataFrame([(s, k) for s in ("a", "b", None) for k in range(20)], "source string, _shard bigint")
    seeds = keys.select("source", "_shard", F.xxhash64(F.lit(2), "source", "_shard").alias("h")).collect()
    BEGINS.update({(r["source"], r["_shard"]): r["h"] for r in seeds})
    want = plain_mix(narrow, 12)
    for how in (True, False):
        got = mixing.mix(table, shard_rows=12, narrow=how).collect()
        assert {r["doc_id"]: r["taken"] for r in got} == {k: want[k] for k in range(150)}
        assert ("text" in got[0].asDict()) is not how


def test_mix_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, shard_rows=7).collect()
    again = mixing.mix(docs.repartition(5), shard_rows=7).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["size"] == len(words(r["text"])) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for group in by.values():
        assert sum(r["taken"] for r in group) == pytest.approx(group[0]["target"], abs=2 * mixing.BLOCK + 1)
    copies = mixing.take_documents(mixing.mix(docs)).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in copies) == 2


def test_mix_of_odd_rows(spark, empty):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == 8 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert {r["source"] for r in rows} == {None, "a", "b", "é"}
    assert mixing.mix(empty).count() == 0


# -- 2 line templates -----------------------------------------------------------------------------
def test_templates_with_variable_fields(spark):
    rows = [(k, f"Own words of text {chr(97 + k) * 3}\nCopyright {1990 + k} by The Authors of {chr(97 + k)}name here\n") for k in range(12)]
    rows += [(50, "Copyright notices are short"), (51, None), (52, ""), (53, "\n\n"), (54, "12 34")]
    found = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in found.collect()}
    for k in range(12):
        # five of six tokens of the first line are fixed as well
        assert got[k]["n_lines"] == 3 and got[k]["n_dropped"] == 2 and got[k]["kept"] == ""
    assert [got[k]["n_dropped"] for k in (50, 51, 52, 53, 54)] == [0] * 5 and got[51]["kept"] is None
    table = line_templates.recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["template"] for r in table} == {"Own words of text <*>", "Copyright <*> by The Authors of <*> here"}


def plain_templates(rows, depth=3, min_docs=10, percent=60):
    """Lines dropped per row, by counting documents one by one."""
    lines = []
    for row, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n") if text is not None else []:
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))
            if tokens:
                lines.append((row, (doc, text), (len(tokens), tokens[:depth]), tokens))
    docs = collections.defaultdict(set)
    for _, name, leaf, tokens in lines:
        for i, t in enumerate(tokens):
            docs[leaf, i, t].add(name)
    template, often = {}, collections.defaultdict(set)
    for _, name, leaf, tokens in lines:
        kept = tuple(t if t != "<*>" and len(docs[leaf, i, t]) >= min_docs else "<*>" for i, t in enumerate(tokens))
        template[leaf, tokens] = kept
        if 100 * sum(len(docs[leaf, i, t]) >= min_docs and t != "<*>" for i, t in enumerate(tokens)) >= percent * len(tokens):
            often[leaf, kept].add(name)
    drop = collections.Counter()
    for row, name, leaf, tokens in lines:
        drop[row] += len(often.get((leaf, template[leaf, tokens]), ())) >= min_docs
    return drop


def test_templates_count_documents_once(spark):
    rows = [(1, "\n".join(f"alpha beta gamma user BOB z{chr(97 + k)}q" for k in range(10)))]
    rows += [(10 + k, f"alpha beta gamma user n{chr(97 + k)}me y{chr(97 + k)}y") for k in range(12)]
    found = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in found} == {1: 10, **{10 + k: 1 for k in range(12)}}


def test_templates_equal_brute_force(spark):
    rnd = random.Random(12)
    for some in (3, 8):
        line = lambda: " ".join(["lead", rnd.choice("ab"), "x", *(rnd.choice(["u", "v", "w7", *"cdefgh"[:some]]) for _ in range(rnd.randint(0, 3)))])
        rows = [(rnd.choice([None, k]), "\n".join(line() for _ in range(rnd.randint(0, 6)))) for k in range(40)]
        rows += rows[:5]  # repeated rows
        found = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        want = plain_templates(rows)
        got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in found)
        assert got == collections.Counter((d, len(t.split("\n")), want[k]) for k, (d, t) in enumerate(rows))
        assert sum(want.values()) > 20


CLASH = ("plumless", "buckeroo")  # of equal crc32


def test_rows_without_id_are_told_apart(spark):
    """Texts of equal checksum, one of them repeated, none with a doc_id."""
    assert zlib.crc32(CLASH[0].encode()) == zlib.crc32(CLASH[1].encode())
    tail = " " + " ".join(f"w{k}" for k in range(40)) + "\n"
    other = " " + " ".join(f"v{k}" for k in range(40)) + "\n"
    from flowspark.llm import substring_tree, suffix_array

    def table(texts):
        return spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")

    # equal bytes after texts of equal checksum keep it equal
    same = [CLASH[0] + tail, CLASH[1] + tail]
    assert zlib.crc32(same[0].encode()) == zlib.crc32(same[1].encode())
    docs = table([*same, other, other + "more words"])
    gone = {r["kept"]: r["n_removed"] for r in substring_tree.drop_repeated_words(docs).collect()}
    assert gone == {CLASH[0]: 40, CLASH[1]: 40, "": 40, "more words": 40}
    alone = table([CLASH[0] + tail, CLASH[1] + tail.replace("w39", "w39"), "x" + other])
    assert sorted(r["n_removed"] for r in suffix_array.drop_repeated_bytes(alone, 200).collect())[0] == 0


def test_templates_of_odd_rows(spark, empty):
    assert line_templates.drop_recurring_lines(odd(spark)).count() == 8
    assert line_templates.drop_recurring_lines(empty).count() == 0


# -- 3 sharding -----------------------------------------------------------------------------------
def test_shards_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # one text makes up a third of the rows
    more = docs.limit(1).select("text").crossJoin(spark.range(1000, 1100).withColumnRenamed("id", "doc_id"))
    docs = docs.select("doc_id", "text").unionByName(more)
    rows = sharding.shard_documents(docs, shards=8).collect()
    count = collections.Counter(r["shard"] for r in rows)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    places = collections.defaultdict(set)
    size = collections.Counter(texts.values())
    for r in rows:
        places[texts[r["doc_id"]]].add(r["shard"])
    small = [t for t in places if 1 < size[t] < 50]
    assert sum(len(places[t]) > 1 for t in small) <= 0.3 * len(small)
    hot = max(size, key=size.get)
    assert len(places[hot]) < 8


def test_propagation_lowers_the_cut(spark):
    rnd = random.Random(4)
    nodes = [(k, k // 4, 1, rnd.randrange(6)) for k in range(240)]
    table = spark.createDataFrame(nodes, "doc_id bigint, group bigint, weight bigint, shard int")
    out = sharding.propagate(table, 6, 44).collect()
    cut = lambda rows: sum(len({r[3] for r in rows if r[1] == g}) - 1 for g in range(60))
    after = [(r["doc_id"], r["group"], r["weight"], r["shard"]) for r in out]
    assert cut(after) < 0.5 * cut(nodes)


def test_shards_of_odd_rows(spark, empty):
    rows = sharding.shard_documents(odd(spark), shards=3).collect()
    assert sorted(collections.Counter(r["shard"] for r in rows).values()) == [2, 3, 3]
    null = next(r for r in rows if r["doc_id"] == 1)
    assert null["size"] == 16 and null["text_crc32"] is None and null["grown_shard"] is None
    assert sharding.shard_documents(empty, shards=3).count() == 0


# -- 6 quality rules ------------------------------------------------------------------------------
def measured(text):
    w, text = words(text), text or ""
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_measurements_equal_brute_force(spark):
    rnd = random.Random(5)
    extra = [(100 + k, " ".join(rnd.choice(["a", "b", "##", "é", "<x>\n"]) for _ in range(rnd.randint(1, 60))), "en", "a", 1) for k in range(40)]
    docs = odd(spark, extra)
    rows = quality.judge(docs).collect()
    for r in rows:
        want = measured(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_windows_of_one_hash_and_names_of_inner_columns(spark, monkeypatch):
    """With a hash of three values every window meets different ones of its hash; columns keep their values."""
    monkeypatch.setattr(quality, "_HASH", "pmod(xxhash64({}), 3L)")
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abc") for _ in range(n)) for n in [0, 4, 5, 6, 7, 30, 60, 90]] + [None]
    schema = "doc_id bigint, text string, _words string, _LINES int, _bits int, _mask int, _keys int, __keys int"
    docs = spark.createDataFrame([(k, t, "w", 1, 2, 3, 4, 5) for k, t in enumerate(texts)], schema)
    rows = quality.measure(docs).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows} == {k: measured(t)[4] for k, t in enumerate(texts)}
    assert all(tuple(r)[2:8] == ("w", 1, 2, 3, 4, 5) for r in rows)


def test_policies_and_ablations(spark):
    entries = spark.createDataFrame([(b,) for b in [0, 1, 1, 2, 3, 16, 17]], "fail_bits bigint")
    out = {(r["version"], r["rule"]): (r["failed"], r["only_this"], r["rejected"]) for r in quality.ablations(entries, [quality.BASE, quality.STRICT]).collect()}
    assert out["base", "few_words"] == (4, 3, 5) and out["base", "repeated_words"] == (2, 1, 5)
    assert out["v1", "few_words"] == (4, 2, 6) and out["v1", "symbols"] == (2, 1, 6)
    assert entries.filter(quality.rejected_by(quality.BASE)).count() == 5
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


# -- 7 language -----------------------------------------------------------------------------------
def test_languages_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_numbers_are_no_letters(spark):
    rows = [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (5, "² ½", "fr"), (6, "Ⅷ ① 四²", "en"), (7, "12_3 ...", None), (8, "cat² ½the", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert got[5] == got[7] == ("und", 0.0) and got[6][0] != "und" and got[8][0] == "en"
    # fit and prediction cut words alike
    spark_words = docs.select(language._words("text").alias("w")).collect()
    assert [r["w"] for r in spark_words] == [language.letter_runs(t.lower()) for _, t, _ in rows]


def plain_model(rows):
    """Counts and log frequencies by hand: {word: {lang: score}}, {gram: ...}."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        counts[lang].update("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    langs = sorted(lang for lang in counts if counts[lang])
    grams = {lang: collections.Counter() for lang in langs}
    for lang in langs:
        for w, n in counts[lang].items():
            for size in range(1, 5):
                for i in range(len(w) + 3 - size):
                    grams[lang][f"_{w}_"[i : i + size]] += n

    def scores(tables, group):
        total = collections.Counter()
        for lang in langs:
            for e, n in tables[lang].items():
                total[group(e), lang] += n
        for g in {g for g, _ in total}:
            for lang in langs:
                total[g, lang] += 1  # so that none is zero
        most = {g: max(total[g, lang] for lang in langs) for g, _ in total}
        return {
            e: [np.log(tables[lang][e] / total[group(e), lang]) if tables[lang][e] else np.log(0.5 / most[group(e)]) for lang in langs]
            for lang in langs for e in tables[lang]
        }

    return langs, scores(counts, lambda e: 0), scores(grams, len)


def test_model_equals_a_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    model = language.fit(docs, entries=10**6)  # none is cut off
    langs, word_scores, gram_scores = plain_model([(r["text"], r["lang"]) for r in docs.collect() if r["lang"] is not None])
    assert model.languages == langs and set(model.words) == set(word_scores) and set(model.grams) == set(gram_scores)
    for names, want in ((model.words, word_scores), (model.grams, gram_scores)):
        for entry, k in names.items():
            assert np.allclose(model.table[k], want[entry], atol=1e-4), entry


def test_language_of_odd_rows(spark, empty):
    rows = {r["doc_id"]: r for r in language.identify(odd(spark)).collect()}
    assert rows[1]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[3]["score"] == 0
    assert rows[7]["lang_pred"] in ("en", "de") and not rows[None]["held_out"]
    assert language.identify(empty).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_languages_with_few_counted_words(spark):
    rnd = random.Random(11)
    own = {k: ["".join(rnd.choice(k) for _ in range(rnd.randint(2, 7))) for _ in range(300)] for k in ("abcdef", "ghijkl", "mnopqr")}
    say = lambda k, n=40: " ".join(rnd.choice(own[k]) for _ in range(n))
    rows = [(say("abcdef"), "aa") for _ in range(60)] + [(say("ghijkl"), "gg") for _ in range(60)]
    rows += [(say("mnopqr"), "one")]  # one document
    rows += [("12 345 - 6", "none"), (" ", "none"), ("", "none")]  # no letters
    copied = {f"copy{c}": f"{c}st{c}u {c}v{c}{c}" for c in "wxyzäö"}
    rows += [(text, lang) for lang, text in copied.items() for _ in range(30)]  # more rows than drawn, one text
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    for labelled in (table, table.drop("doc_id"), table.withColumn("doc_id", F.lit(None).cast("bigint"))):
        model = language.fit(labelled, sample=10)
        assert model.languages == sorted({"aa", "gg", "one", *copied})
        guess = lambda text: model.predict(text, {})[0]
        for _ in range(20):
            assert guess(say("abcdef")) == "aa" and guess(say("ghijkl")) == "gg" and guess(say("mnopqr")) == "one"
        assert {lang: guess(text) for lang, text in copied.items()} == {lang: lang for lang in copied}
    # what no language knows says next to nothing
    assert np.ptp(model.word_scores("ßßß")) < 0.1
    assert language.fit(table.filter("lang = 'none'")).languages == []


def test_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = {f"l{a}{b}": f"{a}{b}{a} {b}{a}{a}{b} q{a}{b}q" for a in letters[:12] for b in letters[12:22]}
    # the rarer half has one row each, the others two
    rows = [(t, lang) for k, (lang, t) in enumerate(text.items()) for _ in range(1 + (k < 60))]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(table)
    assert len(model.languages) == 120 and isinstance(model.table, language.SparseTable)
    assert {lang: model.predict(t, {})[0] for lang, t in text.items()} == {lang: lang for lang in text}
    # the two forms of the table hold the same numbers
    dense = model.table.dense()
    assert all((model.table[k] == dense[k]).all() for k in range(len(dense)))
    with pytest.raises(ValueError):
        language.fit(table, max_languages=119)


def test_backoff_from_words_to_letters():
    model = language.LanguageModel(
        ["de", "en"], {"the": 0}, {"_der": 1, "sch": 2, "w": 3},
        np.array([[-9.0, -1.0], [-1.0, -9.0], [-1.0, -9.0], [-5.0, -2.0]]), np.array([-20.0, -20.0]),
    )
    assert model.word_scores("the").tolist() == [-9.0, -1.0]
    assert model.predict("the", {})[0] == "en" and model.predict("der", {})[0] == "de"
    # no 4-gram of it is known, one 3-gram is
    assert model.predict("schx", {})[0] == "de" and model.predict("w", {})[0] == "en"
    assert model.predict("qqq", {})[0] == "de"  # a tie


# -- 8 token counts -------------------------------------------------------------------------------
@pytest.mark.parametrize("byte_fallback", [False, True])
def test_counts_equal_the_library(spark, sf_dir, byte_fallback):
    tokenizers = pytest.importorskip("tokenizers")
    rnd = random.Random(6)
    sets = [[(token_counts.MARK + "a", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.5), ("aab", -3.5)]]
    if os.path.exists(token_counts.DEFAULT_MODEL):
        sets.append(token_counts.read_pieces(token_counts.DEFAULT_MODEL))
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts += ["", " ", "日本語 ☃☃☃ x☃y 😀😀", "ab" * 400, "".join(rnd.choice("ab ☃") for _ in range(3000))]
    for pieces in sets:
        low = min(s for _, s in pieces)
        vocabulary = [("<unk>", low), *pieces, *[(f"<0x{b:02X}>", low) for b in range(256) if byte_fallback]]
        tool = tokenizers.Tokenizer(tokenizers.models.Unigram(vocabulary, 0, byte_fallback))
        split = tokenizers.pre_tokenizers
        tool.pre_tokenizer = split.Sequence([split.WhitespaceSplit(), split.Metaspace()])
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        found = token_counts.count_tokens(docs, byte_fallback=byte_fallback, pieces=pieces).collect()
        got = {r["doc_id"]: r["n_tokens"] for r in found}
        assert got == {k: len(tool.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_counts_of_odd_rows(spark, empty):
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(odd(spark), pieces=[("x", -1.0)], byte_fallback=False).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0 and rows[5]["n_tokens"] == 3001
    assert token_counts.count_tokens(empty, pieces=[]).count() == 0


# -- 9 decontamination ----------------------------------------------------------------------------
def held(text, item, percent=80):
    a, b = decontaminate.words_of(text), decontaminate.words_of(item)
    size = min(5, len(b))
    want = decontaminate.grams_of(b, size) if b else set()
    common = len(want & decontaminate.grams_of(a, size)) if b else 0
    return (len(want), common) if want and common * 100 >= percent * len(want) else None


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_contained_items_equal_brute_force(spark, most):
    rnd = random.Random(7)
    item = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    items = [(1, None), (2, " "), (3, "hello"), (4, "Two Words"), *[(10 + k, item(5 + 7 * k)) for k in range(12)]]
    docs = [(1, None), (2, ""), (3, "say HELLO now"), (4, "two words"), (5, "two other words")]
    for k in range(12):
        parts = items[4 + k][1].split()
        cut = [p if rnd.random() > 0.03 else "edited" for p in parts]
        docs.append((100 + k, item(300) + " " + " ".join(cut).upper().lower() + "\n" + item(50)))
        docs.append((200 + k, " ".join(parts[: len(parts) // 2]) + " " + item(80)))
    docs.append((100, docs[5][1]))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, size int")
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, size int")
    found = decontaminate.contained_items(frame, table, max_item_words=most).collect()
    got = sorted((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_common"]) for r in found)
    want = sorted((d, i, *h) for d, t in docs for i, x in items if (h := held(t, x)))
    assert got == want and len(want) > 8
    left = decontaminate.drop_contaminated(frame, table)
    assert left.columns == frame.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {w[0] for w in want}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_containment_of_repeated_rows(spark, most):
    item = " ".join(f"w{k}" for k in range(24))  # 20 shingles
    whole, half = f"x {item} y", " ".join(item.split()[:12])  # 8 of them
    docs = [(1, whole), (1, whole), (2, half), (2, half), (2, half), (3, whole), (None, whole), (None, whole), (None, half)]
    items = [(7, item), (7, item), (8, "w1 W2"), (8, "w1 w2"), (9, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contained_items(frame, table, max_item_words=most).collect()
    got = [(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_common"]) for r in found]
    want = [(d, i, *h) for d, t in docs for i, x in items if (h := held(t, x))]
    assert collections.Counter(got) == collections.Counter(want) and (1, 7, 20, 20) in want and (2, 7, 20, 8) not in got


def test_containment_of_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.contained_items(odd(spark), items.limit(0)).count() == 0


def test_contaminated_rows_alone_are_dropped(spark):
    item = " ".join(f"w{k}" for k in range(24))
    docs = [(None, item, "x"), (None, "clean words", "y"), (None, "more of them", "z"), (1, f"a {item}", "x"), (1, "clean", "y"), (2, None, "z")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, _row_k1 string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    for most in (2_000_000, 0):
        left = decontaminate.drop_contaminated(frame.drop("_row_k1"), items, max_item_words=most).collect()
        assert sorted(map(repr, map(tuple, left))) == sorted(repr(d[:2]) for d in docs if item not in (d[1] or ""))


def test_texts_under_one_doc_id_are_kept(spark):
    from flowspark.llm import ngram_join

    own = lambda c: " ".join(f"{c}{k}" for k in range(30))
    docs = [(1, own("a"), 1), (1, own("b"), 2), (2, own("a") + " end", 3), (None, own("c"), 4), (None, own("d"), 5), (None, own("c"), 6), (None, None, 7), (None, " ", 8), (3, own("e"), 9), (3, own("e"), 10)]
    out = ngram_join.drop_similar(spark.createDataFrame(docs, "doc_id bigint, text string, n int")).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in out), key=repr)
    # the row that is alone with its doc_id goes before one that is not
    want = [(1, own("b")), (2, own("a") + " end"), (None, own("c")), (None, own("d")), (None, None), (None, " "), (3, own("e"))]
    assert got == sorted(want, key=repr)


# -- pipeline -------------------------------------------------------------------------------------
def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = docs.collect()
        seen[name] = (before, after)
        docs = spark.createDataFrame(after, docs.schema)
    before, after = seen["language"]
    assert len(after) == len([r for r in before if any(map(str.isalpha, r["text"] or ""))])
    from tests.llm.test_ngram_join import brute

    before, after = seen["near_duplicates"]
    roots = brute([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted({root for _, root in roots.values()})
    before, after = seen["decontaminate"]
    bad = {r["doc_id"] for r in before if any(held(r["text"], i["text"]) for i in items)}
    assert bad and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    before, after = seen["mixture"]
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(spark.createDataFrame(before)).collect()}
    count = collections.Counter(r["doc_id"] for r in after)
    assert all(count[d] == int(t / s + 0.5) for d, (t, s) in taken.items() if s)
    before, after = seen["shards"]
    assert len(before) == len(after) and {r["shard"] for r in after} <= set(range(40))
    sizes = collections.Counter(r["shard"] for r in after)
    assert max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1


def test_stages_keep_columns_with_names_of_operators(spark, sf_dir):
    names = ["score", "lang_pred", "size", "source_size", "target", "taken", "_h", "_crc", "_shard", "_key", "_nth", "a.b"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in names), name


def test_pipeline_with_odd_rows(spark, tmp_path, empty):
    items = spark.createDataFrame([(1, "some test item of several words")], "item_id bigint, text string")
    for k, table in enumerate((odd(spark).select("doc_id", "text", "lang", "source", "n_chars"), empty)):
        folder = str(tmp_path / str(k))
        table.write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() >= 1 - k


def test_registered_names():
    assert {re.match(r"op\d+", n)[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
