"""Registered queries of the subpackage, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import (
    conversations, decontaminate, language, line_templates, mixing, ngram_join, quality, sharding,
    substring_tree, suffix_array,
    spelling, token_counts, url_filter,
)
from flowspark.session import small_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


@query("op1_sainte_lague_mixing")
def op1(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"), narrow=True)
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_log_template_lines", r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
),
t AS (
  SELECT doc_id, text, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
    lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS tokens FROM l
),
s AS (SELECT *, CAST(len(tokens) AS VARCHAR) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM t WHERE len(tokens) > 0),
d AS (SELECT DISTINCT leaf, tokens, doc_id, text FROM s),
v AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, text FROM d) q GROUP BY leaf HAVING count(*) >= 10),
b AS (SELECT leaf, tokens, count(*) AS docs FROM d JOIN v USING (leaf) GROUP BY leaf, tokens),
k AS (SELECT leaf, tokens, docs, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS pos FROM b),
h AS (SELECT DISTINCT k.leaf, k.pos, k.token, d.doc_id, d.text FROM k JOIN d ON d.leaf = k.leaf AND d.tokens = k.tokens),
f AS (SELECT leaf, pos, token FROM h WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING count(*) >= 10),
m AS (
  SELECT k.leaf, k.tokens, string_agg(coalesce(f.token, '<*>'), ' ' ORDER BY k.pos) AS template
  FROM k LEFT JOIN f ON f.leaf = k.leaf AND f.pos = k.pos AND f.token = k.token GROUP BY k.leaf, k.tokens
  HAVING 100 * count(f.token) >= 60 * count(*)
),
o AS (
  SELECT leaf, template FROM (SELECT DISTINCT d.leaf, m.template, d.doc_id, d.text FROM d JOIN m ON m.leaf = d.leaf AND m.tokens = d.tokens) q
  GROUP BY leaf, template HAVING count(*) >= 10
),
g AS (SELECT DISTINCT m.leaf, m.tokens FROM m JOIN o ON o.leaf = m.leaf AND o.template = m.template),
x AS (SELECT s.doc_id, s.pos FROM s JOIN g ON g.leaf = s.leaf AND g.tokens = s.tokens)
SELECT q.doc_id, CAST(count(q.pos) AS BIGINT) AS n_lines, CAST(count(x.pos) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(q.line, chr(10) ORDER BY q.pos) FILTER (WHERE x.pos IS NULL), '')) AS kept_sha256
FROM l q LEFT JOIN x ON x.doc_id = q.doc_id AND x.pos = q.pos GROUP BY q.doc_id
""")
def op2(spark, sf_dir):
    out = line_templates.drop_recurring_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_balanced_label_propagation")
def op3(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir, "doc_id", "text"), shards=40)


@query("op4_prefix_suffix_trees", f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM k) q WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT e.doc_id, string_agg(e.w[e.p], ' ' ORDER BY e.p) AS t
  FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(x.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op4(spark, sf_dir):
    out = substring_tree.drop_repeated_words(documents(spark, sf_dir, "doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


LOWER_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
)
SHINGLES = f"""
w AS (SELECT doc_id, coalesce({LOWER_WORDS}, []) AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
)"""


@query("op5_ngram_jaccard_join", f"""
WITH RECURSIVE {SHINGLES},
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (
  SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT p.y, r.root FROM r JOIN p ON p.x = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s AND len(s.s) > 0 LEFT JOIN m ON m.node = c.rep
""")
def op5(spark, sf_dir):
    return ngram_join.similar_documents(documents(spark, sf_dir, "doc_id", "text"), size=5, percent=80)


@query("op6_rule_bitmask_ledger", f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce({WORDS}, []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
r AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM g
  ) q WHERE n > 1
),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) q GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)
),
f AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (word_chars > 15 * n_words)::INT + 8 * (word_chars < 2 * n_words)::INT
    + 16 * (100 * n_symbols > 30 * word_chars)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
""")
def op6(spark, sf_dir):
    out = quality.judge(documents(spark, sf_dir, "doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "fail_bits",
    )


@query("op7_word_first_language_id")
def op7(spark, sf_dir):
    return language.identify(documents(spark, sf_dir, "doc_id", "text", "lang"))


@query("op8_count_only_viterbi")
def op8(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"))


@query("op9_minhash_containment", f"""
WITH {SHINGLES},
i AS (SELECT item_id, coalesce({LOWER_WORDS}, []) AS w FROM benchmark),
b AS (
  SELECT item_id, list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS s FROM i
)
SELECT d.doc_id, q.item_id, q.n AS n_item_shingles, count(*) AS n_common
FROM (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b) q JOIN (SELECT doc_id, unnest(s) AS g FROM s) d ON d.g = q.g
GROUP BY d.doc_id, q.item_id, q.n HAVING 100 * count(*) >= 80 * q.n
""")
def op9(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contained_items(documents(spark, sf_dir, "doc_id", "text"), items, percent=80)


@query("op10_suffix_array_dedup", """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
k AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200) q),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM k) q WHERE c > 1),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM s GROUP BY doc_id, g),
f AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM runs),
t AS (
  SELECT f.doc_id, string_agg(substr(x, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS head,
    max(b) AS last, sum(b - a) AS gone, count(*) AS spans
  FROM f JOIN n USING (doc_id) GROUP BY f.doc_id
)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM n LEFT JOIN t USING (doc_id)
""")
def op10(spark, sf_dir):
    out = suffix_array.drop_repeated_bytes(documents(spark, sf_dir, "doc_id", "text"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
    ("com/de/", "block"),
)


@query("op12_sorted_digest_url_filter", r"""
WITH r(rhost, rpath, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
),
a AS (
  SELECT page_id, row_number() OVER () AS k,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
u AS (
  SELECT page_id, k,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
),
m AS (
  SELECT u.*, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE place = 1
""")
def op12(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = small_table(spark, list(URL_RULES), "rule STRING, verdict STRING")
    out = url_filter.filter_urls(pages, rules, default="allow")
    return out.select("page_id", "host", "path", "rule", "verdict")


def _letters(text: str) -> str:
    """SQL for the UTF-8 bytes of a text of ASCII and Latin-1 letters, as a list of numbers."""
    code = "CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END"
    return f"flatten(list_transform(string_split({text}, ''), lambda c: {code}))"


# the table of the checksum, and the checksum of a list of bytes
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
)"""


def _crc32(letters: str) -> str:
    step = "lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295, {letters}), {step}), 4294967295)"


@query("op11_bloom_spelling_variants", rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
),
g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, CAST({_crc32(_letters("id"))} AS BIGINT) AS h FROM g, crc WHERE length(run) >= 7),
d AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h
),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
c AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM c),
gap AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM c),
p AS (
  SELECT cut.word AS a, v.word AS b FROM cut JOIN v ON v.word = cut.less
  UNION ALL SELECT v.word, cut.word FROM cut JOIN v ON v.word = cut.less
  UNION ALL SELECT x.word, y.word FROM gap x JOIN gap y ON x.hole = y.hole AND x.word <> y.word
),
b AS (
  SELECT p.a, p.b, v.n, row_number() OVER (PARTITION BY p.a ORDER BY v.n DESC, p.b) AS place, count(*) OVER (PARTITION BY p.a) AS n_near
  FROM p JOIN v ON v.word = p.b
),
f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN b.b END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n
  FROM v LEFT JOIN b ON b.a = v.word AND b.place = 1
),
w(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, w.root FROM w JOIN f ON f.form = w.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN w ON w.word = f.word
""")
def op11(spark, sf_dir):
    words = spelling.count_words(documents(spark, sf_dir, "doc_id", "text"), 7, 2, spelling.drop_letter)
    return spelling.group_variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_agenda_conversation_repair", rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations
),
h AS (SELECT o.*, CAST({_crc32("list_transform(string_split(id, ''), lambda c: ord(c))")} AS BIGINT) % 20 AS h FROM o, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE h <> 0
),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 32), md5(text), copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d
),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT bare[-1:] IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
    role[1:1] AS c, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS p
  FROM n
),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
),
ins(q, a, w, r) AS (VALUES
  (0, '', 0, []), (1, '', 0, []), (2, '', 0, []), (3, '', 0, []),
  (0, 'I', 2, ['user:']), (1, 'I', 2, ['user:']), (2, 'I', 3, ['assistant:']), (3, 'I', 2, ['user:']),
  (0, 'II', 3, ['user:', 'assistant:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, 'II', 2, ['assistant:', 'user:']), (3, 'II', 3, ['user:', 'assistant:'])
),
ins1 AS (SELECT q, a, CASE WHEN a = '' THEN q ELSE w END AS w, r FROM ins),
op(w, e, c, q2, role) AS (VALUES
  (0, 'D', '', 0, ''), (1, 'D', '', 1, ''), (2, 'D', '', 2, ''), (3, 'D', '', 3, ''),
  (0, 'R', '', 2, 'user'), (1, 'R', '', 2, 'user'), (2, 'R', '', 3, 'assistant'), (3, 'R', '', 2, 'user'),
  (0, 'K', 's', 1, ''), (0, 'K', 'u', 2, ''), (1, 'K', 'u', 2, ''), (3, 'K', 'u', 2, ''), (2, 'K', 'a', 3, '')
),
st AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS res FROM f
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.res FROM (
    SELECT st.conv_id, f.i, op.q2 AS q, min({{
      'cost': st.cost + 3 * length(ins1.a) + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
        + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
      'audit': st.audit || ins1.a || e,
      'res': st.res || ins1.r || CASE e WHEN 'D' THEN [] WHEN 'R' THEN [op.role || ':' || f.text] ELSE [f.role || ':' || f.text] END
    }}) AS b
    FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1
    JOIN ins1 ON ins1.q = st.q JOIN op ON op.w = ins1.w AND (op.c = '' OR op.c = f.c)
    WHERE e = 'D' OR fault IN ('fine', 'truncated')
    GROUP BY st.conv_id, f.i, op.q2
  ) x
),
m AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
z AS (
  SELECT st.conv_id, min({{
    'cost': cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'res': res || CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END
  }}) AS b FROM st JOIN m ON m.conv_id IS NOT DISTINCT FROM st.conv_id AND m.i = st.i GROUP BY st.conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.b.cost, 0) AS cost, coalesce(z.b.audit, '') AS audit,
  sha256(coalesce(array_to_string(z.b.res, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
""")
def op13(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.repair_conversations(conversations.damage(rows), rows)
