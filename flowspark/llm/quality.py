"""Quality rules (6): a ledger of measurements and failure bits, and policies over it.

Every rule is evaluated once per document; bit k of ``fail_bits`` is set if rule k fails. A policy is a
named version with a mask of rules that reject. Applying another version, or asking what each rule does
alone, needs only bit operations on the ledger, not the texts. All expressions are native.

Results for odd input: a null or blank text has no words, fails ``few_words`` and passes the ratios; a
text without lines or letters counts zero; rows are independent, so repeated rows repeat; an empty table
gives an empty ledger; columns named like a measurement are overwritten, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is an SQL condition over the measurements; null counts as passed."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rejects: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("v1", tuple(r.name for r in RULES))
_HASH = "xxhash64({})"  # of a window of words
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _private(names: Sequence[str], columns: Sequence[str]) -> list[str]:
    """``names`` with as many leading underscores as tell them from ``columns``, which ignore case."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def measure(docs: DataFrame, window: int = 5) -> DataFrame:
    """``docs`` with the measurements of ``text`` (all bigint).

    n_words; word_chars, code points in words; n_symbols, characters of ``#*$%&|<>``; n_lines, lines
    with a word; n_dup_lines, those equal to an earlier one; n_repeat_words, words in windows of ``window``
    words that stand in the text twice or more. For the last, one number per window holds its hash above and
    its place below; the more places, the fewer bits of hash, which only bring equal windows together: words
    are compared between neighbours, and between all windows of a hash that two different ones share.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")
    last = window - 1
    inner = _private(["words", "lines", "bits", "mask", "keys", "near"], docs.columns)
    words, line_list, bits, mask, keys, near = (f"`{c}`" for c in inner)
    alike = f"slice({words}, int(p.a & {mask}), {window}) = slice({words}, int(p.b & {mask}), {window})"
    # windows with one hash are neighbours among the sorted keys; their words confirm that they are equal
    pairs = f"""filter(
        transform(sequence(1, greatest(size({keys}) - 1, 1)), j -> named_struct('a', {keys}[j - 1], 'b', {keys}[j])),
        p -> shiftright(p.a, {bits}) = shiftright(p.b, {bits}))"""
    # between equal windows a different one of the same hash may stand: then each meets all of that hash
    shared = f"array_distinct(transform(filter({near}, p -> NOT ({alike})), p -> shiftright(p.a, {bits})))"
    clashes = f"""CASE WHEN exists({near}, p -> NOT ({alike})) THEN flatten(transform({shared}, h -> flatten(transform(
        filter({keys}, a -> shiftright(a, {bits}) = h), a -> transform(
            filter({keys}, b -> b > a AND shiftright(b, {bits}) = h), b -> named_struct('a', a, 'b', b))))))
        ELSE array() END"""
    equal = f"filter(concat({near}, {clashes}), p -> {alike})"
    starts = f"array_sort(array_distinct(flatten(transform({equal}, p -> array(p.a & {mask}, p.b & {mask})))))"
    covered = f"""aggregate({starts}, named_struct('n', 0L, 'until', 0L),
        (s, i) -> named_struct('n', s.n + least({window}L, i + {window} - s.until), 'until', i + {window}),
        s -> s.n)"""
    return (
        docs.withColumn(inner[0], _words(text)).withColumn(inner[1], lines)
        .withColumn("n_words", F.size(words).cast("bigint"))
        .withColumn(inner[2], F.length(F.bin(F.col("n_words"))))
        .withColumn(inner[3], F.expr(f"shiftleft(1L, {bits}) - 1"))
        .withColumn(inner[4], F.expr(f"""CASE WHEN n_words > {window} THEN sort_array(transform(
            sequence(1, size({words}) - {last}),
            i -> shiftleft({_HASH.format(f"slice({words}, i, {window})")}, {bits}) | i)) END"""))
        .withColumn(inner[5], F.expr(pairs))
        .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_lines", F.size(line_list).cast("bigint"))
        .withColumn("n_dup_lines", (F.size(line_list) - F.size(F.array_distinct(line_list))).cast("bigint"))
        .withColumn("n_repeat_words", F.expr(f"CASE WHEN {keys} IS NULL THEN 0L ELSE {covered} END"))
        .drop(*inner)
    )


def ledger(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measured rows with ``fail_bits``; at most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds at most 63 rules")
    bits = F.lit(0).cast("bigint")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def mask_of(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    """The bits of the rules that a policy names."""
    names = [r.name for r in rules]
    return sum(1 << names.index(n) for n in policy.rejects)


def rejected_by(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True for ledger rows that fail a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, rules)).cast("bigint")) != 0


def ablations(entries: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy version and rule: failed (rows failing the rule), only_this (rows that no other rule of
    the policy rejects, which dropping the rule would bring back) and rejected (by the whole policy).

    The ledger is first counted by its bits, so one row per bit pattern is left.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    out = None
    for policy in policies:
        mask = F.lit(mask_of(policy, rules)).cast("bigint")
        hit = F.col("fail_bits").bitwiseAND(mask)
        for k, rule in enumerate(rules):
            if rule.name not in policy.rejects:
                continue
            bit = F.lit(1 << k).cast("bigint")
            count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
            row = patterns.agg(
                count(hit.bitwiseAND(bit) != 0).alias("failed"), count(hit == bit).alias("only_this"),
                count(hit != 0).alias("rejected"),
            ).select(F.lit(policy.version).alias("version"), F.lit(rule.name).alias("rule"), "*")
            out = row if out is None else out.unionByName(row)
    return out


def judge(docs: DataFrame, policy: Policy = STRICT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger of ``docs`` with base_failed and kept (passes the base policy and this one)."""
    entries = ledger(measure(docs), rules)
    return entries.withColumn("base_failed", rejected_by(BASE, rules)).withColumn(
        "kept", ~F.col("base_failed") & ~rejected_by(policy, rules)
    )
