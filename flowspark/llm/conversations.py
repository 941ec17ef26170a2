"""Conversation structure repair (13): lightest derivation by Knuth's agenda.

A conversation should read as an optional system turn followed by pairs of user and assistant turns, or be
empty. Its rows are consumed one by one under weighted edits: keep (0), rerole to user or assistant (3), delete
(4; the only edit of blank and duplicate rows), insert an empty user or assistant turn (3); a truncated row that
is not deleted costs 3 more. An item (rows consumed, state of the role pattern) is derived by the edits that lead
to it, and its weight is the pair (cost, audit), the audit being the initials of the edits. Both grow with every
edit and keep their order under it, so the agenda pops each item for the first time with its lightest weight.

No task holds a whole conversation for this. Rows without their texts get a global index and are cut into pieces
of ``PIECE`` rows at most. The agenda runs over one piece from each state it may be entered in and gives the lightest way to
each state it may be left in. The ways through the pieces of a conversation are then chosen by costs and by ranks of
the audits (two audits of the same rows that both end with a row's edit are never one the beginning of the other, so ranks decide
as the audits would): 32 numbers a piece, 2,048 rows or fewer. Texts are shuffled once, to be repaired by the finished
audit in one pass over sorted rows; as a digest of a conversation is one value, its texts pass through one task, row by row.

Rows are taken by turn (nulls first); rows of one turn by role, the first 32 characters of the text, then its md5.

Results for odd input: a null role or text reads as one space; null conv_ids are one conversation; equal rows of one turn are
duplicates from the second on; roles are judged by their first character, and one that is not s, u or a cannot be kept;
texts of any length are whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.scratch import materialize
from flowspark.operators.order import order_rows

PIECE = 2048
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# states of the role pattern: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_KEPT = {("s", START): SYSTEM, **{("u", q): USER for q in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
_LEGAL = ("su", "ua", "au")
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("fine", "truncated", "blank", "duplicate")
# a row in a piece is one letter: its initial's kind and its fault
_KINDS = "uas-"
_CODES = {chr(97 + 4 * k + f): (kind, fault) for k, kind in enumerate(_KINDS) for f, fault in enumerate(FAULTS)}


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with seeded faults, by the checksum of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls read as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    fault = F.col("_fault")
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_fault"))
        .filter(fault != 0)
        .select(
            "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
        )
        .drop("_copy")
    )


# -- the agenda -------------------------------------------------------------------------------
def derive(piece: str, entry: int) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from ``entry`` over all rows of the piece to each state that can be reached, the last
    edit being that of the last row. A row is its letter of the codes."""
    rows = [_CODES[c] for c in piece]
    n = len(rows)
    agenda = [(0, "", 0, entry)]
    final: dict[tuple[int, int], tuple[int, str]] = {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = cost, audit
        if i == n:
            continue
        kind, fault = rows[i]
        heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, state))
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, _NEXT[state]))
        if fault in ("fine", "truncated"):
            more = cost + (TRUNCATED if fault == "truncated" else 0)
            heapq.heappush(agenda, (more + REROLE, audit + "R", i + 1, _NEXT[state]))
            if (kind, state) in _KEPT:
                heapq.heappush(agenda, (more, audit + "K", i + 1, _KEPT[kind, state]))
    return {state: final[n, state] for state in range(4) if (n, state) in final}


def ending(state: int) -> tuple[int, str]:
    """Cost and audit of the inserts that complete the pattern."""
    audit = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}[state]
    return INSERT * len(audit), audit


def choose(pieces: list[list[dict]]) -> tuple[int, str, list[tuple[int, int]]]:
    """(cost, audit of the completing inserts, (entry, exit) of each piece) of the lightest way through the pieces,
    each given as steps with entry, exit, cost and the rank of the audit among those of its entry."""
    cost, rank = {START: 0}, {START: 0}
    back = []
    for steps in pieces:
        best: dict[int, tuple] = {}
        for s in steps:
            if s["entry"] in cost:
                way = (cost[s["entry"]] + s["cost"], rank[s["entry"]], s["rank"], s["entry"])
                if s["exit"] not in best or way < best[s["exit"]]:
                    best[s["exit"]] = way
        order = sorted(best, key=lambda q: best[q][1:3])
        cost, rank = {q: w[0] for q, w in best.items()}, {q: k for k, q in enumerate(order)}
        back.append({q: w[3] for q, w in best.items()})
    last = min(cost, key=lambda q: (cost[q] + ending(q)[0], rank[q]))
    total, rest = cost[last] + ending(last)[0], ending(last)[1]
    ways = []
    for came in reversed(back):
        ways.append((came[last], last))
        last = came[last]
    return total, rest, ways[::-1]


# -- rows to pieces ---------------------------------------------------------------------------
def _order() -> list[str]:
    return ["conv_id", "turn", "role", "_head", "_md5"]


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 32).alias("_head"),
        F.unhex(F.md5(text)).alias("_md5"), text.alias("text"),
    )


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


def coded_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, idx, code): the order of all rows and each one's letter."""
    bare = F.rtrim("text", F.lit(_BLANKS))
    narrow = _keyed(rows).select(
        *_order(), (bare == "").alias("_blank"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("_ended"),
        F.rand(13).alias("_any"),  # equal rows are interchangeable; this lets them spread over parts
    )
    ordered = order_rows(narrow, [*_order(), "_any"]).indexed("idx").drop("_part", "_pos", "_any", "_head")
    firsts = (
        ordered.filter("NOT _blank").groupBy("conv_id", "role", "_md5")
        .agg(F.min("idx").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        .withColumnsRenamed({"conv_id": "_conv_id", "role": "_role", "_md5": "__md5"})
    )
    joined = ordered.join(firsts, _same(ordered, firsts, ["conv_id", "role", "_md5"]), "left")
    fault = (
        F.when(F.col("_blank"), FAULTS.index("blank"))
        .when(F.col("idx") > F.col("_first"), FAULTS.index("duplicate"))
        .when(~F.col("_ended"), FAULTS.index("truncated")).otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    kind = F.lit(len(_KINDS) - 1)
    for k, letter in enumerate(_KINDS[:-1]):
        kind = F.when(initial == letter, k).otherwise(kind)
    return joined.select("conv_id", "turn", "idx", F.char(97 + 4 * kind + fault).alias("code"))


_NAMES = ("entry", "exit", "cost", "rank", "audit")
_STEP = T.StructType([T.StructField(c, T.IntegerType()) for c in _NAMES[:-1]]).add("audit", T.StringType())


@F.arrow_udf(T.ArrayType(_STEP))
def _steps(codes: pa.Array, entries: pa.Array) -> pa.Array:
    """The ways through each piece, from the start only where a conversation begins with it."""
    known: dict[tuple, list] = {}
    out = []
    for piece, count in zip(codes.to_pylist(), entries.to_pylist()):
        if (piece, count) not in known:
            steps = []
            for entry in range(count):
                found = derive(piece, entry)
                order = sorted(found, key=lambda q: found[q][1])
                steps += [
                    {"entry": entry, "exit": q, "cost": found[q][0], "rank": k, "audit": found[q][1]}
                    for k, q in enumerate(order)
                ]
            known[piece, count] = steps
        out.append(known[piece, count])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.array(out, pa.list_(pa.struct(list(zip(_NAMES, kinds)))))


_WAY = T.StructType().add("piece", T.LongType()).add("entry", T.IntegerType()).add("exit", T.IntegerType())
_CHOICE = T.StructType().add("cost", T.LongType()).add("rest", T.StringType()).add("ways", T.ArrayType(_WAY))


@F.arrow_udf(_CHOICE)
def _choices(pieces: pa.Array) -> pa.Array:
    out = []
    for found in pieces.to_pylist():
        cost, rest, ways = choose([p["steps"] for p in found])
        named = [{"piece": p["piece"], "entry": a, "exit": b} for p, (a, b) in zip(found, ways)]
        out.append({"cost": cost, "rest": rest, "ways": named})
    way = pa.struct([("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])
    return pa.array(out, pa.struct([("cost", pa.int64()), ("rest", pa.string()), ("ways", pa.list_(way))]))


def _letters(*wanted: str) -> str:
    return "".join(c for c, (_, fault) in _CODES.items() if fault in wanted)


def _count(codes: str, letters: str) -> Column:
    return (F.length(codes) - F.length(F.translate(codes, letters, ""))).cast("bigint")


def _kinds_of(codes: str) -> Column:
    """The codes as initials' kinds."""
    return F.translate(codes, "".join(_CODES), "".join(kind for kind, _ in _CODES.values()))


def _illegal(kinds: str) -> Column:
    """Neighbouring kinds that may not follow each other."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(kinds) - 1), lambda i: F.substring(F.col(kinds), i, F.lit(2))
    )
    bad = F.size(F.filter(pairs, lambda p: ~p.isin(*_LEGAL)))
    return F.when(F.length(kinds) > 1, bad).otherwise(0).cast("bigint")


def repairs(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in ``rows``
    (conv_id, turn, role, text)."""
    coded = materialize(coded_rows(rows), "coded")
    turns = (
        coded.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("_one"))
        .groupBy(F.col("conv_id").alias("_conv_id"))
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("bigint").alias("gaps"))
    )
    starts = coded.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.floor(F.min("idx") / piece).alias("_start"))
    grouped = (
        coded.groupBy("conv_id", F.floor(F.col("idx") / piece).alias("piece"))
        .agg(F.sort_array(F.collect_list(F.struct("idx", "code"))).alias("_rows"))
        .select("conv_id", "piece", F.array_join(F.transform("_rows", lambda r: r["code"]), "").alias("codes"))
    )
    entries = F.when(F.col("piece") == F.col("_start"), 1).otherwise(4)
    solved = materialize(
        grouped.join(starts, grouped["conv_id"].eqNullSafe(starts["_conv_id"]))
        .withColumn("kinds", _kinds_of("codes"))
        .select(
            "conv_id", "piece", _steps("codes", entries).alias("steps"),
            *[_count("codes", _letters(f)).alias(f) for f in FAULTS[1:]], _illegal("kinds").alias("illegal"),
            F.substring("kinds", 1, 1).alias("first"), F.substring("kinds", -1, 1).alias("last"),
        ),
        "pieces",
    )
    light = F.transform("steps", lambda s: F.struct(*[s[c].alias(c) for c in _NAMES[:-1]]))
    per_conversation = solved.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in (*FAULTS[1:], "illegal")],
        F.sort_array(F.collect_list(F.struct("piece", "first", "last", light.alias("steps")))).alias("_pieces"),
    )
    seams = F.transform(
        F.sequence(F.lit(1), F.size("_pieces") - 1),
        lambda i: F.concat(F.element_at("_pieces", i.cast("int"))["last"], F.element_at("_pieces", (i + 1).cast("int"))["first"]),
    )
    broken = F.when(F.size("_pieces") > 1, F.size(F.filter(seams, lambda p: ~p.isin(*_LEGAL)))).otherwise(0)
    chosen = materialize(
        per_conversation.withColumns({"_choice": _choices("_pieces"), "illegal": F.col("illegal") + broken}).drop("_pieces"),
        "choices",
    )
    ways = chosen.select(F.col("conv_id").alias("_conv_id"), F.explode("_choice.ways").alias("_way"))
    taken = solved.join(
        ways, solved["conv_id"].eqNullSafe(ways["_conv_id"]) & (solved["piece"] == ways["_way.piece"])
    )
    audit = F.filter(
        "steps", lambda s: (s["entry"] == F.col("_way.entry")) & (s["exit"] == F.col("_way.exit"))
    )[0]["audit"]
    audits = (
        taken.select("_conv_id", F.struct("piece", audit.alias("audit")).alias("_part")).groupBy("_conv_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("_part")), lambda p: p["audit"]), "").alias("_audit"))
    )
    whole = chosen.join(audits, chosen["conv_id"].eqNullSafe(audits["_conv_id"])).drop("_conv_id")
    whole = whole.join(turns, whole["conv_id"].eqNullSafe(turns["_conv_id"]), "left")
    return whole.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *FAULTS[1:], "illegal",
        F.col("_choice.cost").alias("cost"), F.concat("_audit", "_choice.rest").alias("audit"),
    )


# -- repaired rows ----------------------------------------------------------------------------
_TURNS = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
])


def _edited(audit: str, at: int, state: int) -> tuple[list[tuple[str, int]], int, int]:
    """Inserts from place ``at`` of the audit up to the next row's edit: their roles' states, that place, the state."""
    out = []
    while at < len(audit) and audit[at] == "I":
        state = _NEXT[state]
        out.append(("I", state))
        at += 1
    return out, at, state


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, each led by a row with its audit, to the repaired turns."""
    conv, audit, at, state, place = None, "", 0, START, 0

    def finish():
        inserts, _, _ = _edited(audit, at, state)
        return [(conv, place + k, "I", _ROLE[q], "") for k, (_, q) in enumerate(inserts)]

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]
        for c, given, role, text in zip(*columns):
            if given is not None:
                out += finish()
                conv, audit, at, state, place = c, given, 0, START, 0
                continue
            inserts, at, state = _edited(audit, at, state)
            for edit, q in inserts:
                out.append((conv, place, edit, _ROLE[q], ""))
                place += 1
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                state = _NEXT[state]
                role = _ROLE[state]
            else:
                state = _KEPT[role[:1], state]
            out.append((conv, place, edit, role, text))
            place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TURNS.types)], schema=_TURNS)
    out = finish()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TURNS.types)], schema=_TURNS)


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation after its edits, each conversation in one
    run and in order. ``audits`` has conv_id and audit, as ``repairs`` gives them for ``rows``."""
    bodies = _keyed(rows).withColumns({"_tag": F.lit(1), "audit": F.lit(None).cast("string")})
    empty = F.lit(None)
    leads = audits.select(
        "conv_id", empty.cast(dict(bodies.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.lit("").alias("_head"),
        F.lit(b"").alias("_md5"), F.lit("").alias("text"), F.lit(0).alias("_tag"), "audit",
    )
    streams = (
        bodies.unionByName(leads).repartition("conv_id")
        .sortWithinPartitions("conv_id", "_tag", *_order()[1:])
    )
    ids = streams.select(F.col("conv_id").cast("bigint"), "audit", "role", "text")
    return ids.mapInArrow(_apply, "conv_id bigint, place bigint, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256): of the turns as ``role:text``, joined by newlines, as ``repaired_turns`` hands them on."""

    def run(batches):
        digest, conv, begun = None, None, False
        for batch in batches:
            out = []
            for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if begun:
                        out.append((conv, digest.hexdigest()))
                    digest, conv, begun = hashlib.sha256(), c, True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.string())],
                    names=["conv_id", "sha256"],
                )
        if begun:
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "sha256"]
            )

    return turns.mapInArrow(run, "conv_id bigint, sha256 string")


def repair_conversations(rows: DataFrame, originals: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per conv_id of ``originals``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its
    rows in ``rows``; a conversation without rows costs nothing and is empty."""
    found = materialize(repairs(rows, piece), "repairs")
    hashed = digests(repaired_turns(rows, found.select("conv_id", "audit"))).withColumnRenamed("conv_id", "_conv_id")
    whole = found.join(hashed, found["conv_id"].eqNullSafe(hashed["_conv_id"]), "left").drop("_conv_id")
    whole = whole.withColumnRenamed("conv_id", "_conv_id")
    ids = originals.select("conv_id").distinct()
    joined = ids.join(whole, ids["conv_id"].eqNullSafe(whole["_conv_id"]), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
