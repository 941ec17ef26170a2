"""Spelling variants, url filter and conversation repair against brute force, and on odd input."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowspark.llm import conversations as conv
from flowspark.llm import spelling, url_filter
from flowspark.session import small_table


# -- spelling ---------------------------------------------------------------------------------
def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(found), counts[form] if form else None)
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def vocabulary(seed, n_words):
    rng = random.Random(seed)
    letters = "abzàÿ÷"
    words = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 5, 9]))) for _ in range(n_words)}
    return {w: rng.choice([1, 2, 3, 20, 25, 400, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("max_bytes", [spelling.MAX_FILTER_BYTES, 256])
def test_spelling_against_brute_force(spark, max_bytes):
    counts = vocabulary(3, 400)
    table = small_table(spark, list(counts.items()), "word STRING, n BIGINT")
    got = spelling.group_variants(table, max_bytes=max_bytes)
    rows = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(counts) and set(rows) == grouped(counts)


def test_spelling_filters_are_cut_and_bounded():
    shapes = spelling.Shapes.plan({7: 100_000, 8: 10, 9: 5_000}, 32 * 1024)
    total = sum(8 << log for log in shapes.log_blocks.values())
    assert total > 32 * 1024 and total >> shapes.log_groups <= 32 * 1024
    assert shapes.groups_of(8) == 0 and shapes.groups_of(7) == shapes.log_groups


def test_spelling_chain_of_forms(spark):
    counts = {"aaaaaaa": 5000, "aaaaaab": 400, "aaaaabb": 30, "aaaabbb": 3, "zzzzzzz": 7}
    table = small_table(spark, list(counts.items()), "word STRING, n BIGINT")
    got = {r["word"]: r["root"] for r in spelling.group_variants(table).collect()}
    assert got == {w: ("aaaaaaa" if w[0] == "a" else w) for w in counts}


def test_spelling_words_of_texts(spark):
    text = "Straßen straßen STRASSE, ÄRGERLICH ärgerlich×÷ abc123abcdefg kurz"
    rows = [(1, text), (1, text), (None, "strassen"), (2, None), (3, ""), (4, "x" * 300_000 + " " + "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, 7, 2).collect()}
    # upper-case letters beyond A-Z stay; the signs of multiplication and division lie in the class
    assert got == {"straßen": 4, "strasse": 2, "Ärgerlich": 2, "ärgerlich×÷": 2, "abcdefg": 2, "x" * 300_000: 2}
    long = spelling.group_variants(spelling.count_words(docs, 7, 2)).filter(F.length("word") > 1000).collect()
    assert [(r["form"], r["n_near"]) for r in long] == [(None, 0)]
    assert spelling.group_variants(spelling.count_words(docs.limit(0), 7, 2)).count() == 0


def test_spelling_damage(spark):
    import zlib

    runs = [f"wordnumber{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(200)]
    docs = spark.createDataFrame([(7, " ".join(runs)), (None, " ".join(runs))], "doc_id bigint, text string")
    want = {}
    for key in ("7", ""):
        for r in runs:
            h = zlib.crc32(f"{key}:{r}".encode())
            w = r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r
            want[w] = want.get(w, 0) + 1
    got = spelling.count_words(docs, 7, 1, spelling.drop_letter).collect()
    assert {r["word"]: r["n"] for r in got} == want and any(len(w) == 12 for w in want)


def test_spelling_letters_outside_the_alphabet_are_refused(spark):
    with pytest.raises(Exception, match="alphabet|codec"):
        spelling.group_variants(small_table(spark, [("word1", 2), ("word2", 3)], "word STRING, n BIGINT")).collect()


# -- urls -------------------------------------------------------------------------------------
def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for rule, verdict in rules:
        rhost, slash, rest = rule.partition("/")
        if host and (host == rhost or host.endswith("." + rhost)) and path.startswith(slash + rest):
            fits.append((len(rule), len(rhost), rule, verdict))
    _, _, rule, verdict = max(fits, default=(0, 0, None, default))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "://", "http://", "https://Example.ORG", "https://example.org/", "https://a.b.example.org/es/1?x=/en/1#f",
    "https://example.org/es", "http://notexample.org/es/x", "https://x.com/fr/a", "https://com/fr/", "ftp://x.com?/fr/",
    "https://x.com#/fr/", "https://u:p@x.com:80/fr/", "https://é.org/ü/1", "https://é.org/Ü/1", "a://b://c.org/x",
    "https://..org/", "https://org./", "https://" + "a." * 5000 + "example.org/en/1" + "9" * 100_000, "https://x.org/es/\n/y",
]
RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
    ("é.org/ü", "block"), ("b.example.org", "allow"), ("c.org/x", "block"), ("x.org/es/\n", "block"),
]


@pytest.mark.parametrize("max_rules", [url_filter.MAX_RULES, 0])
def test_urls_against_brute_force(spark, max_rules):
    rng = random.Random(5)
    labels, paths = ["a", "bb", "org", "com", "x"], ["/", "/a", "/a/b", "/b", ""]
    rules = {".".join(rng.choices(labels, k=rng.randint(1, 3))) + rng.choice(paths): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = list(rules.items()) + RULES
    urls = URLS + ["h://" + ".".join(rng.choices(labels, k=rng.randint(1, 5))) + rng.choice(paths) + rng.choice(["", "/c", "?q"]) for _ in range(300)]
    pages = spark.createDataFrame([(i % 50, u, "kept", "lost") for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string")
    table = small_table(spark, rules, "rule STRING, verdict STRING")
    got = url_filter.filter_urls(pages, table, max_rules=max_rules)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    rows = sorted((tuple(r) for r in got.select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=repr)
    assert rows == sorted(((i % 50, u, *judged(u, rules)) for i, u in enumerate(urls)), key=repr)


@pytest.mark.parametrize("max_rules", [url_filter.MAX_RULES, 0])
def test_urls_odd_rules(spark, max_rules):
    pages = spark.createDataFrame([(1, "s://a.org/x"), (None, "s://b.net/")], "page_id bigint, url string")
    rules = spark.createDataFrame(
        [("ORG/x", "allow"), ("org/x", "block"), (None, "block"), ("net/", None), ("/x", "block"), ("", "block")],
        "rule string, verdict string",
    )
    got = url_filter.filter_urls(pages, rules, default="later", max_rules=max_rules).collect()
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in got} == {(1, "org/x", "block"), (None, None, "later")}
    none = url_filter.filter_urls(pages, rules.limit(0), max_rules=max_rules).collect()
    assert [(r["rule"], r["verdict"]) for r in none] == [(None, "allow")] * 2
    assert url_filter.filter_urls(pages.limit(0), rules, max_rules=max_rules).count() == 0


def test_digests_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: 7)
    hosts, rules = url_filter.digest_arrays([("org", "/", "allow"), ("a.org", "/x", "block"), ("net", "", "block")])
    maps = [
        {c: t.column(c).to_numpy() if c in ("digest", "chars", "host_chars") else t.column(c).combine_chunks() for c in t.column_names}
        for t in (hosts, rules)
    ]
    places = url_filter.best_rules([b"b.a.org", b"x.net", b"com"], [b"/xy", b"", b"/"], *maps)
    assert [rules.column("rule")[p].as_py() if p >= 0 else None for p in places] == [b"a.org/x", b"net", None]


# -- conversations ----------------------------------------------------------------------------
def lightest(rows):
    """(cost, audit) by trying every edit of every row, with up to two inserts before it."""
    nxt = {"": "u", "s": "u", "a": "u", "u": "a"}
    best = None
    options = [[("D", 4)] + ([("K", 0), ("R", 3)] if f in ("fine", "truncated") else []) for _, f in rows]
    for edits in itertools.product(*options):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, state, ok = 3 * sum(inserts), "", "", True
            for (c, f), (e, w), k in zip(rows, edits, inserts):
                for _ in range(k):
                    state = nxt[state]
                audit += "I" * k + e
                cost += w + (3 if f == "truncated" and e != "D" else 0)
                if e == "R":
                    state = nxt[state]
                elif e == "K":
                    if c == "s" and state == "" or c in "ua" and nxt[state] == c:
                        state = c
                    else:
                        ok = False
                        break
            if not ok:
                continue
            for _ in range(inserts[-1]):
                state = nxt[state]
            if state in ("", "a"):
                found = (cost, audit + "I" * inserts[-1])
                best = found if best is None or found < best else best
    return best


LETTER = {v: k for k, v in conv._CODES.items()}


@pytest.mark.parametrize("piece", [1, 2, 5])
def test_agenda_against_all_edits(piece):
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.choice("uuaas-"), rng.choice(["fine"] * 4 + ["truncated", "blank", "duplicate"])) for _ in range(rng.randint(1, 4))]
        codes = "".join(LETTER[r] for r in rows)
        parts = [codes[k : k + piece] for k in range(0, len(codes), piece)]
        pieces, audits = [], []
        for p in parts:
            steps = []
            for entry in range(4):
                found = conv.derive(p, entry)
                order = sorted(found, key=lambda q: found[q][1])
                steps += [{"entry": entry, "exit": q, "cost": found[q][0], "rank": k} for k, q in enumerate(order)]
            pieces.append(steps)
            audits.append({e: conv.derive(p, e) for e in range(4)})
        cost, rest, ways = conv.choose(pieces)
        audit = "".join(a[i][o][1] for a, (i, o) in zip(audits, ways)) + rest
        assert (cost, audit) == lightest(rows), rows


def plain_repair(rows):
    """The whole answer for one conversation's sorted rows."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("fine" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = lightest([(c if c in ("s", "u", "a") else "-", f) for c, f in zip(initials, faults)]) if rows else (0, "")
    state, out, left = "", [], iter(rows)
    names = {"u": "user", "a": "assistant"}
    for e in audit:
        step = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
        _, role, text = next(left) if e != "I" else (None, None, "")
        if e == "D":
            continue
        role = role if e == "K" else names[step]
        state = role[0]
        out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = faults.count
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("piece", [2, conv.PIECE])
def test_conversations_against_brute_force(spark, piece):
    rng = random.Random(11)
    data = {}
    for c in [None, *range(30)]:
        rows = []
        for t in range(rng.randint(0, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Fine.", "Ends not", "", " \n", "Fine.", "Long " * 50_000 + "!"])
            rows.append((rng.choice([None, t, t + 3]), role, text))
        data[c] = rows
    flat = [(c, t, r, x, "clash") for c, rows in data.items() for t, r, x in rows]
    rng.shuffle(flat)
    table = spark.createDataFrame(flat, "conv_id bigint, turn bigint, role string, text string, cost string")
    originals = spark.createDataFrame([(c,) for c in data], "conv_id bigint")
    got = conv.repair_conversations(table, originals, piece)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == names
    found = {r[0]: tuple(r[1:]) for r in got.collect()}

    def key(row):
        t, role, text = row
        return (t is not None, t or 0, role, text[:32], hashlib.md5(text.encode()).digest())

    assert found == {c: plain_repair(sorted(rows, key=key)) for c, rows in data.items()}


def test_long_conversation_is_cut_into_pieces(spark):
    """One conversation over many pieces and tasks; every fifth row is blank."""
    rows = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 10 == 9, F.lit("")).otherwise(F.concat(F.col("id").cast("string"), F.lit("."))).alias("text"),
    )
    found = conv.repairs(rows).first()
    # a deleted answer leaves two questions in a row: an empty answer stands in for it
    assert found["audit"] == "KKKKKKKKKDI"[:10] + "".join("IKKKKKKKKKD" for _ in range(1999)) + "I"
    assert found["cost"] == 2000 * 4 + 2000 * 3 and found["blank"] == 2000 and found["illegal"] == 0


def test_conversation_odd_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conv.repair_conversations(empty, empty).count() == 0
    rows = spark.createDataFrame([(None, None, None, None), (5, None, "user", "Hi."), (5, None, "user", "Hi.")], schema)
    got = {r["conv_id"]: r for r in conv.repair_conversations(rows, rows).collect()}
    assert (got[None]["blank"], got[None]["audit"], got[None]["gaps"]) == (1, "D", 0)
    assert (got[5]["duplicate"], got[5]["audit"], got[5]["cost"]) == (1, "KDI", 7)
    hurt = {tuple(r) for r in conv.damage(rows).collect()}
    assert all(None not in r[2:] for r in hurt)


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(20) for t in range(10)] + [(None, None, None, "x.")]
    got = sorted(conv.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect(), key=repr)
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if h == 4 else role, "" if h == 1 else "One Two Three" if h == 2 and c is not None else text)
        want += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    assert [tuple(r) for r in got] == sorted(want, key=repr) if None not in [r[0] for r in want] else len(got) == len(want)
