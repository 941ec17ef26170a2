"""URL filters (12): rules found in a sorted digest array that tasks map into memory.

A rule is a host and the beginning of a path (``example.org/es/``) with a verdict; it fits the host itself and
all its subdomains where the url's path starts with the rule's. Of several the longest text wins, then the
longer host. The driver sorts the 64-bit xxhash digests of all rules and of their hosts into two files, Spark
carries them to every executor, and tasks map them into memory, so that all workers of a machine share the
pages. A task hashes the endings of its distinct hosts, probes all of them by one binary search, then probes
host and path beginnings of the lengths that rules of these hosts have. Every hit is confirmed by the stored
text, so digests that collide decide nothing.

The files are made while the rules number at most ``max_rules`` and ``max_bytes``; larger lists meet the urls'
distinct hosts and paths in shuffle joins, with equal results.

Results for odd input: a null url, or one without ``://``, has an empty host and path and fits no rule; ports
and user names are part of the host as they stand; an empty host has no rule; null rules or verdicts are left
out; a rule listed with several verdicts takes the first of them by code point, unless one is ``block``;
repeated urls or page ids give a row each; empty tables give an empty result, an empty list of rules the
default everywhere; input columns named host, path, rule or verdict give way to the operator's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import scratch_path

MAX_RULES = 1_000_000
MAX_BYTES = 64 * 1024 * 1024
OUTPUT = ("host", "path", "rule", "verdict")
_PIECE = 1 << 20  # bytes handed to the file system at once


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; empty for null and for texts without ``://``."""
    place = F.locate("://", url)
    after = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(
        F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _clean(rules: DataFrame) -> DataFrame:
    """(rule, host, path, verdict), one row per rule text; the host in lower case."""
    host = F.translate(
        F.regexp_extract("rule", r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    split = rules.filter("rule IS NOT NULL AND verdict IS NOT NULL").select(
        host.alias("host"), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"), "verdict"
    )
    first = F.coalesce(F.min(F.when(F.col("verdict") == "block", F.col("verdict"))), F.min("verdict"))
    return (
        split.filter("host <> ''").groupBy("host", "path").agg(first.alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    )


# -- the digest arrays ------------------------------------------------------------------------
def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def digest_arrays(rules: list[tuple[str, str, str]]) -> tuple[pa.Table, pa.Table]:
    """Tables of hosts (with the path lengths of their rules, in bytes) and of rules (host, path, verdict),
    sorted by digest."""
    lengths: dict[str, set[int]] = {}
    for host, path, _ in rules:
        lengths.setdefault(host, set()).add(len(path.encode()))
    hosts = sorted((digest(h.encode()), h, sorted(found)) for h, found in lengths.items())
    texts = sorted((digest((h + p).encode()), h + p, len(h), v) for h, p, v in rules)
    host_table = pa.table({
        "digest": pa.array([h[0] for h in hosts], pa.uint64()),
        "host": pa.array([h[1].encode() for h in hosts], pa.large_binary()),
        "lengths": pa.array([h[2] for h in hosts], pa.large_list(pa.int32())),
    })
    rule_table = pa.table({
        "digest": pa.array([r[0] for r in texts], pa.uint64()),
        "rule": pa.array([r[1].encode() for r in texts], pa.large_binary()),
        # longest text first, then the longer host
        "chars": pa.array([len(r[1]) for r in texts], pa.int32()),
        "host_chars": pa.array([r[2] for r in texts], pa.int32()),
        "verdict": pa.array([r[3] for r in texts], pa.large_string()),
    })
    return host_table.combine_chunks(), rule_table.combine_chunks()


def _share(spark, table: pa.Table, name: str) -> str:
    """Write the table to the shared folder and have Spark carry it to all executors; its name there."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=max(1, table.num_rows))
    data = sink.getvalue().to_pybytes()
    path = scratch_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for k in range(0, len(data), _PIECE):
            out.write(bytearray(data[k : k + _PIECE]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


@lru_cache(maxsize=8)
def _mapped(name: str) -> dict[str, object]:
    """Columns of a shared table, mapped from its file: numbers as arrays, texts as Arrow columns."""
    table = pa.ipc.open_file(pa.memory_map(SparkFiles.get(name))).read_all()
    columns: dict[str, object] = {}
    for field in table.schema:
        chunks = table.column(field.name)
        column = chunks.chunk(0) if chunks.num_chunks else pa.array([], field.type)
        columns[field.name] = column.to_numpy() if pa.types.is_integer(field.type) else column
    return columns


def _find(digests: np.ndarray, texts: pa.Array, probes: list[bytes]) -> list[int]:
    """The place of each probe in a digest array, -1 where its text is not stored."""
    if len(digests) == 0 or not probes:
        return [-1] * len(probes)
    keys = np.fromiter((digest(p) for p in probes), np.uint64, len(probes))
    low = np.searchsorted(digests, keys, "left")
    out = np.full(len(probes), -1, np.int64)
    for k in np.flatnonzero(digests[np.minimum(low, len(digests) - 1)] == keys).tolist():
        place = int(low[k])
        while place < len(digests) and digests[place] == keys[k]:
            if texts[place].as_py() == probes[k]:
                out[k] = place
                break
            place += 1
    return out.tolist()


def host_endings(host: bytes, longest: int) -> list[bytes]:
    """The host and its parent domains, as far as they have at most ``longest`` bytes."""
    out = [host] if len(host) <= longest else []
    at = host.find(b".", max(0, len(host) - longest - 1))
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(b".", at + 1)
    return out


def best_rules(hosts: list[bytes], paths: list[bytes], host_table: dict, rule_table: dict) -> list[int]:
    """For each url the place of its longest rule, -1 for none."""
    distinct = {h: k for k, h in enumerate(dict.fromkeys(hosts))}
    offsets = pc.binary_length(host_table["host"])
    longest = pc.max(offsets).as_py() or 0
    probes, owner = [], []
    for host, k in distinct.items():
        if host:
            for ending in host_endings(host, longest):
                probes.append(ending)
                owner.append(k)
    fitting: list[list[int]] = [[] for _ in distinct]
    for k, place in zip(owner, _find(host_table["digest"], host_table["host"], probes)):
        if place >= 0:
            fitting[k].append(place)
    needed = {place for found in fitting for place in found}
    known = {p: (host_table["host"][p].as_py(), host_table["lengths"][p].as_py()) for p in needed}

    probes, owner = [], []
    for k, (host, path) in enumerate(zip(hosts, paths)):
        for place in fitting[distinct[host]]:
            ending, lengths = known[place]
            for length in lengths:
                if length > len(path):
                    break
                probes.append(ending + path[:length])
                owner.append(k)
    best = [-1] * len(hosts)
    chars, host_chars = rule_table["chars"], rule_table["host_chars"]
    for k, place in zip(owner, _find(rule_table["digest"], rule_table["rule"], probes)):
        if place >= 0:
            old = best[k]
            if old < 0 or (chars[place], host_chars[place]) > (chars[old], host_chars[old]):
                best[k] = place
    return best


def _by_digests(parts: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    spark = parts.sparkSession
    hosts_file, rules_file = (
        _share(spark, table, name) for table, name in zip(digest_arrays(rules), ("hosts", "rules"))
    )

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        host_table, rule_table = _mapped(hosts_file), _mapped(rules_file)
        hosts, paths = (c.cast(pa.binary()).to_pylist() for c in (host, path))
        places = best_rules(hosts, paths, host_table, rule_table)
        found = pa.array([p if p >= 0 else None for p in places], pa.int64())
        rule = rule_table["rule"].take(found).cast(pa.large_string()).cast(pa.string())
        verdict = pc.fill_null(rule_table["verdict"].take(found), default).cast(pa.string())
        return pa.StructArray.from_arrays([rule, verdict], names=["rule", "verdict"])

    judged = parts.withColumn("_judged", judge("host", "path"))
    return judged.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")


# -- lists too large to send ------------------------------------------------------------------
def _by_joins(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by joins over distinct hosts and distinct (host, path); hot hosts are split by adaptive
    execution, since a host meets one row for each ending that has rules."""
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    urls = parts.select(F.col("host").alias("_h"), F.col("path").alias("_p")).filter("host <> ''").distinct()
    labels = F.split("_h", r"\.")
    first = F.greatest(F.size(labels) - (most - 1), F.lit(1))
    endings = F.transform(
        F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    hosts = urls.select("_h").distinct().select("_h", F.explode(endings).alias("_ending"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths"))
    fitting = hosts.join(lengths, hosts["_ending"] == lengths["host"]).select("_h", "_ending", "_lengths")
    probes = (
        urls.join(fitting, "_h").withColumn("_length", F.explode("_lengths"))
        .filter(F.col("_length") <= F.length("_p"))
        .select("_h", "_p", F.concat("_ending", F.expr("substring(_p, 1, _length)")).alias("_text"))
    )
    order = F.struct(F.length("rule").alias("a"), F.length("host").alias("b"), "rule", "verdict")
    best = (
        probes.join(rules, probes["_text"] == rules["rule"])
        .groupBy("_h", "_p").agg(F.max(order).alias("_best"))
    )
    joined = parts.join(best, (parts["host"] == best["_h"]) & (parts["path"] == best["_p"]), "left")
    verdict = F.coalesce(F.col("_best.verdict"), F.lit(default))
    return joined.withColumns({"rule": F.col("_best.rule"), "verdict": verdict}).drop("_h", "_p", "_best")


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
    max_rules: int = MAX_RULES, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``pages`` with host, path, the longest fitting rule and its verdict, or ``default`` where none fits.
    ``rules`` has the columns rule and verdict."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in OUTPUT]
    host, path = host_and_path(pages[url])
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    clean = _clean(rules)
    size = F.sum(F.octet_length("rule") + F.octet_length("verdict"))
    n, total = clean.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if n > max_rules or total > max_bytes:
        return _by_joins(parts, clean, default)
    found = clean.select("host", "path", "verdict").collect()  # bounded by the line above
    return _by_digests(parts, [tuple(r) for r in found], default)
