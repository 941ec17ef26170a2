"""Line dedup (2): a log-template tree of fixed depth.

A line's tokens are its words; a token with a digit is a variable field ``<*>`` from the start. The tree
leads by the number of tokens, then by the first ``depth`` tokens, to a leaf. Inside a leaf a token stays
in the template if it stands at its place in the lines of at least ``min_docs`` documents; rarer tokens are
variable fields too. A template recurs if at least ``min_docs`` documents have a line of it and at least
``least_percent`` of its tokens are fixed. Lines of recurring templates are dropped in every document.

All expressions are native. Equal masked lines are counted before their tokens are compared, and only
leaves with enough documents get that far, so a line in a third of all documents is one row.

Results for odd input: a null text has no lines and stays null; lines without words are kept; repeated
rows count as one document, for a document is known by doc_id and text; ties do not arise, as every line
is judged by counts alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.keys import KEY, row_key
from flowspark.llm.scratch import materialize

FIELD = "<*>"
BLANKS = " \t\n\x0b\x0c\r"
DEPTH = 3
MIN_DOCS = 10
LEAST_PERCENT = 60


def _key() -> list[Column]:
    return [column.alias(name) for name, column in row_key().items()]


def tokens_of(line: Column) -> Column:
    """Words of a line with at least one; those with a digit are variable fields."""
    masked = F.when(
        F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, r"[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)
    ).otherwise(line)
    return F.split(F.btrim(masked, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """One row per line with words: document (k1, k2), at (number from 0), leaf and body (hashes of
    the leaf's path and of the masked line)."""
    lines = docs.select(*_key(), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    tokens = lines.filter(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]"))).withColumn("tokens", tokens_of(F.col("line")))
    return tokens.select(
        "k1", "k2", "at", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)).alias("leaf"),
        F.xxhash64("tokens").alias("body"),
    )


def line_tokens(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(leaf, body, docs, tokens) for the chosen lines (k1, k2, at)."""
    per_doc = chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "leaf", "body", "docs")).alias("_lines"))
    lines = docs.select("text", *_key()).join(per_doc, KEY).select(F.split("text", "\n").alias("_split"), F.explode("_lines").alias("x"))
    out = lines.select("x.leaf", "x.body", "x.docs", F.get("_split", F.col("x.at")).alias("line"))
    return out.select("leaf", "body", "docs", tokens_of(F.col("line")).alias("tokens")).dropDuplicates(["leaf", "body"])


def fixed_tokens(per_doc: DataFrame, tokens: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, at, token, fixed) of the tokens that at least ``min_docs`` documents have at a place of a leaf.

    The documents of the lines with a token add up to too many where one document has several such lines. A
    token is certain if one line alone has enough documents; for the others, whose lines have few documents
    each, what was counted twice is taken off.
    """
    place = ["leaf", "at", "token"]
    sums = (
        tokens.filter(F.col("token") != FIELD).groupBy(*place)
        .agg(F.sum("docs").alias("n"), F.max("docs").alias("most")).filter(F.col("n") >= min_docs)
    )
    unsure = tokens.join(sums.filter(F.col("most") < min_docs).select(*place), place).select(*place, "body")
    twice = (
        per_doc.select("leaf", "body", *KEY).join(unsure, ["leaf", "body"]).groupBy(*place, *KEY)
        .agg(F.count("*").alias("lines")).filter("lines > 1")
        .groupBy(*place).agg(F.sum(F.col("lines") - 1).alias("more"))
    )
    return (
        sums.join(twice, place, "left").filter(F.col("n") - F.coalesce("more", F.lit(0)) >= min_docs)
        .select(*place, F.lit(True).alias("fixed"))
    )


def recurring_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, least_percent: int = LEAST_PERCENT,
    lines: DataFrame | None = None,
) -> DataFrame:
    """(leaf, body, template) of the masked lines whose template recurs; the template as text. ``lines``
    is ``lines_of(docs)``, written before."""
    lines = materialize(lines_of(docs, depth), "lines") if lines is None else lines
    per_doc = lines.groupBy("leaf", "body", "k1", "k2").agg(F.min("at").alias("at"))
    # a document with several lines in a leaf counts once
    leaves = (
        lines.select("leaf", "k1", "k2").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_docs).select("leaf")
    )
    per_doc = materialize(per_doc.join(leaves, "leaf"), "lines-in-leaves")
    # one line stands for all that are equal
    bodies = per_doc.groupBy("leaf", "body").agg(
        F.count("*").alias("docs"), F.min(F.struct("k1", "k2", "at")).alias("x")
    ).select("leaf", "body", "docs", "x.*")
    words = materialize(line_tokens(docs, bodies), "bodies")
    tokens = words.select("leaf", "body", "docs", F.posexplode("tokens").alias("at", "token"))
    fixed = fixed_tokens(per_doc, tokens, min_docs)
    templates = (
        tokens.join(fixed, ["leaf", "at", "token"], "left")
        .withColumn("token", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD)))
        .groupBy("leaf", "body").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("template"),
            F.count("*").alias("size"), F.count("fixed").alias("n_fixed"),
        )
        .filter(F.col("n_fixed") * 100 >= least_percent * F.col("size"))
        .select("leaf", "body", "template")
    )
    templates = materialize(templates, "templates")
    often = (
        per_doc.join(templates, ["leaf", "body"]).select("leaf", "template", "k1", "k2").distinct()
        .groupBy("leaf", "template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    )
    return templates.join(often, ["leaf", "template"]).select("leaf", "body", "template")


def drop_recurring_lines(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, least_percent: int = LEAST_PERCENT
) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without lines of recurring templates)."""
    lines = materialize(lines_of(docs, depth), "lines")
    found = recurring_lines(docs, depth, min_docs, least_percent, lines).select("leaf", "body")
    dropped = (
        lines.join(found, ["leaf", "body"]).select("k1", "k2", "at").distinct()
        .groupBy("k1", "k2").agg(F.collect_list("at").alias("_at"))
    )
    joined = docs.select("doc_id", "text", *_key()).join(dropped, KEY, "left")
    lines = F.split("text", "\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_at", i)), "\n")
    return joined.select(
        "doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_at"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("_at").isNull(), F.col("text")).otherwise(rest).alias("kept"),
    )
