"""Conversation structure repair by Wagner-Fischer alignment against an alternating grammar.

Turns are aligned with each feasible target string of the grammar ``(s?(ua)+)?``. Keeping a turn costs 0, giving it the
role user or assistant 2, deleting it 3, inserting an empty turn 2; blank and duplicate turns must go, and a truncated
turn that stays adds 1. Lengths are tried outwards from the number of turns; the cost of the best target so far (the
incumbent) bounds which lengths are still feasible and, by Ukkonen's argument, the band of cells that a table needs:
a cell is left out if the insertions or deletions that reach it and lead on to the end alone cost more. Audits are
traced back to the least string in ASCII order, and the audits of equally cheap targets are compared.

Long conversations. The grammar has four states (nothing yet, after system, after user, after assistant), so what lies
between two turns is known from the state there. A conversation is cut into blocks of at most ``BLOCK`` turns; every
block is aligned for each state it may begin and end in, blocks of all conversations in parallel and equal blocks once a
task. The cost from each block's end to the end of the conversation then follows from a scan over block summaries
backwards, and the state each block begins in from one forwards; both carry four numbers. Insertions belong to the turn
that follows (at the end of a conversation, to the last), so the audits of a block's alternatives consume the same turns
and none is the beginning of another, and comparing them inside the block is the same as comparing whole audits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Turns aligned together.
BLOCK = 64
#: States of the grammar: nothing yet, after system, after user, after assistant.
STATES = "-sua"
#: Insertions that end a conversation, by the state they start from.
TAIL = {"-": "", "s": "II", "u": "I", "a": ""}
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
_NONE = 1 << 60


def targets(entry: str, n: int):
    """``(target, state after it)`` for the beginning of an alternating string of ``n`` turns after ``entry``."""
    def run(first, k):
        return "".join("ua"[(first + i) % 2] for i in range(k))

    plain = run(1 if entry == "u" else 0, n)
    yield plain, plain[-1] if plain else entry
    if entry == "-" and n:
        yield "s" + run(0, n - 1), "s" if n == 1 else "ua"[n % 2]


def distance(excess: int) -> int:
    """Least cost of a stretch that must put out ``excess`` turns more (less, if negative) than it takes in."""
    return INSERT * excess if excess > 0 else -DELETE * excess


def align(turns: tuple, target: str, bound: int) -> tuple[int, str] | None:
    """Cost and least audit of aligning ``turns`` (``initial, fault`` pairs) with ``target``, if within ``bound``.

    The last edit takes in a turn. The table holds costs to the end, so the audit is read off forwards.
    """
    n, m = len(turns), len(target)
    to_go = [dict() for _ in range(n + 1)]
    to_go[n][m] = 0
    for i in range(n - 1, -1, -1):
        initial, fault = turns[i]
        must_go, extra = fault in (BLANK, DUPLICATE), CUT_SHORT if fault == TRUNCATED else 0
        for j in range(m, -1, -1):
            if distance(j - i) + distance((m - j) - (n - i)) > bound:
                continue  # outside the band
            best = to_go[i + 1].get(j, _NONE) + DELETE
            if j < m:
                if target[j] != "s":
                    best = min(best, to_go[i].get(j + 1, _NONE) + INSERT)
                if not must_go and (initial == target[j] or target[j] != "s"):
                    best = min(best, to_go[i + 1].get(j + 1, _NONE) + extra + (KEEP if initial == target[j] else REROLE))
            if best < _NONE:
                to_go[i][j] = best
    cost = to_go[0].get(0, _NONE)
    if cost > bound:
        return None
    audit, i, j = [], 0, 0
    while i < n:
        initial, fault = turns[i]
        left = to_go[i][j]
        if to_go[i + 1].get(j, _NONE) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and to_go[i].get(j + 1, _NONE) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if initial == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def best_targets(turns: tuple, entry: str, ahead: tuple[int, ...]) -> tuple[int, str, str] | None:
    """``cost, audit, state after`` of the best target after ``entry``; ``ahead`` is the cost to go from each state."""
    n, best = len(turns), None
    least_ahead = min(ahead)
    for step in range(2 * n + 2 + _reach(turns, ahead)):
        length = n + (step + 1) // 2 * (1 if step % 2 else -1)  # n, n + 1, n - 1, n + 2, ...
        if length < 0 or best is not None and distance(length - n) + least_ahead > best[0]:
            continue
        for target, state in targets(entry, length):
            rest = ahead[STATES.index(state)]
            if rest >= _NONE:
                continue
            bound = (best[0] if best else _worst(n, length) + rest) - rest
            got = align(turns, target, bound) if bound >= 0 else None
            if got and (best is None or (got[0] + rest, got[1]) < best[:2]):
                best = (got[0] + rest, got[1], state)
    return best


def _worst(n: int, length: int) -> int:
    """A cost that some alignment keeps within: all turns deleted, all of the target inserted."""
    return DELETE * n + INSERT * length


def _reach(turns: tuple, ahead: tuple) -> int:
    """How many more lengths than ``2 n`` are tried: an excess beyond it costs more than any incumbent saves."""
    spread = max(x for x in ahead if x < _NONE) - min(ahead)
    return 2 * ((_worst(len(turns), 2) + spread) // INSERT + 2)


@lru_cache(maxsize=4096)
def costs(turns: tuple) -> list[list[int]]:
    """Least cost of a block for each state it begins (rows) and ends in (columns)."""
    out = []
    for entry in STATES:
        row = []
        for leave in STATES:
            ahead = tuple(0 if s == leave else _NONE for s in STATES)
            got = best_targets(turns, entry, ahead)
            row.append(got[0] if got else _NONE)
        out.append(row)
    return out


@lru_cache(maxsize=4096)
def choices(turns: tuple, ahead: tuple) -> list[tuple[str, str] | None]:
    """Audit and end state of a block for each state it may begin in, given the costs to go after it."""
    got = [best_targets(turns, entry, ahead) for entry in STATES]
    return [(g[1], g[2]) if g else None for g in got]


def decode(code: str) -> tuple:
    """``(initial, fault)`` pairs of a block's code, two characters a turn."""
    return tuple(zip(code[::2], code[1::2], strict=True))


def damage(rows: DataFrame) -> DataFrame:
    """Plants faults in ``conv_id, turn, role, text``: by the hash of ``conv_id:turn`` one turn in 20 each is dropped,
    emptied, stripped of its end marks, repeated or given to the user. Nulls are written as one space."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``conv, conv_id, turn, role, text, initial, at``: the turns in their order, numbered over all conversations.

    The order is by turn (null first), then role and text. Ranges of the order are dealt out, so a conversation of any
    length spreads over tasks.
    """
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # a key that is never null, so that joins and groups need no null-safe equality
    named = named.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    order = ["conv", "turn", "role", "text"]
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "initial", F.substring("role", 1, 1))


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds ``fault`` to the output of :func:`ordered`: the first of blank, duplicate and truncated that holds."""
    first = turns.groupBy("conv", "role", "text").agg(F.min("at").alias("first")).select(
        F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t"), "first")
    j = turns.join(first, (F.col("conv") == F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t")))
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
             .when(F.col("at") > F.col("first"), DUPLICATE)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(SOUND))
    return j.select("conv", "conv_id", "turn", "role", "text", "initial", "at", fault.alias("fault"))


def edits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``at, edits`` for the output of :func:`with_faults`: each turn's edit after the insertions before it."""
    spare = F.when(F.length("initial") == 0, " ").otherwise(F.col("initial"))
    blocks = (turns.groupBy("conv", F.floor(F.col("at") / block).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("at", F.concat(spare, "fault").alias("code")))).alias("t"))
              .select("conv", "block", F.transform("t", lambda x: x["at"]).alias("ats"),
                      F.array_join(F.transform("t", lambda x: x["code"]), "").alias("code")))
    final = tuple(INSERT * len(TAIL[s]) for s in STATES)

    def weigh(batches):
        for b in batches:
            found = [costs(decode(c)) for c in b.column("code").to_pylist()]
            yield b.append_column("costs", pa.array([sum(x, []) for x in found], pa.list_(pa.int64())))

    def back(batches):  # by conversation, last block first
        conv, ahead = None, final
        for b in batches:
            out = []
            for c, m in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist(), strict=True):
                last = c != conv
                if last:
                    conv, ahead = c, final
                out.append((ahead, last))
                ahead = tuple(min(_NONE, min(m[4 * i + k] + ahead[k] for k in range(4))) for i in range(4))
            picked = [choices(decode(code), a) for code, (a, _) in zip(b.column("code").to_pylist(), out, strict=True)]
            cols = [b.column(c) for c in ("conv", "block", "ats")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([x for _, x in out]),
                 pa.array([[p and p[0] for p in x] for x in picked], pa.list_(pa.string())),
                 pa.array([[p and p[1] for p in x] for x in picked], pa.list_(pa.string()))],
                ["conv", "block", "ats", "last", "audits", "states"])

    def forth(batches):  # by conversation, first block first
        conv, state = None, "-"
        for b in batches:
            ats, out = [], []
            for c, at, last, audits, states in zip(*(b.column(x).to_pylist() for x in (
                    "conv", "ats", "last", "audits", "states")), strict=True):
                if c != conv:
                    conv, state = c, "-"
                k = STATES.index(state)
                audit, state = audits[k], states[k]
                each = per_turn(audit)
                if last:
                    each[-1] += TAIL[state]
                ats += at
                out += each
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(out, pa.string())], ["at", "edits"])

    shape = "conv string, block long, ats array<long>"
    weighed = blocks.mapInArrow(weigh, f"{shape}, code string, costs array<long>")
    ahead = (weighed.repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
             .mapInArrow(back, f"{shape}, last boolean, audits array<string>, states array<string>"))
    # the rows of a conversation stay together; only the order turns round
    return ahead.sortWithinPartitions("conv", "block").mapInArrow(forth, "at long, edits string")


def per_turn(audit: str) -> list[str]:
    """An audit cut after every edit that takes in a turn."""
    out, start = [], 0
    for i, e in enumerate(audit):
        if e != "I":
            out.append(audit[start:i + 1])
            start = i + 1
    return out


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every turn of ``rows`` with ``fault``, ``edits`` and its place ``at`` in the order of all turns."""
    turns = stage(ordered(rows), "turns")
    faults = stage(with_faults(turns), "faults")
    done = edits(faults, block).select(F.col("at").alias("_at"), "edits")
    return faults.join(done, F.col("at") == F.col("_at")).drop("_at")


def repaired_turns(marked: DataFrame) -> DataFrame:
    """``conv_id, position, role, text`` of the repaired conversations, from the output of :func:`repaired`."""
    def run(batches):
        conv, state, position = None, "-", 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["conv"] != conv:
                    conv, state, position = r["conv"], "-", 0
                for role, text, state in put_out(r, state):
                    out.append((r["conv_id"], position, role, text))
                    position += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 0 else pa.array(c, pa.int64()) for i, c in
                                                  enumerate(zip(*out, strict=True))],
                                                 ["conv_id", "position", "role", "text"])

    return _streamed(marked).mapInArrow(run, "conv_id long, position long, role string, text string")


def _streamed(marked: DataFrame) -> DataFrame:
    return marked.repartition("conv").sortWithinPartitions("conv", "at")


def put_out(row: dict, state: str):
    """``(role, text, state after)`` of the turns that a row's edits put out."""
    for e in row["edits"]:
        if e == "D":
            continue
        state = row["initial"] if e == "K" else "a" if state == "u" else "u"
        yield (row["role"], row["text"], state) if e == "K" else (ROLES[state], "" if e == "I" else row["text"], state)


def audit(marked: DataFrame) -> DataFrame:
    """One row of counts, costs and digests per conversation that has turns, from the output of :func:`repaired`.

    Turns stream in order through the task of their conversation, which holds its sums and running digest, not them.
    """
    kinds = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        now = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or r["conv"] != now["conv"]:
                    if now:
                        out.append(closed(now))
                    now = {"conv": r["conv"], "conv_id": r["conv_id"], "state": "-", "before": None, "digest":
                           hashlib.sha256(), "some": False, "audit": [], "turns": [0, None, None]} | dict.fromkeys(kinds, 0)
                step(now, r)
            if out:
                yield frame(out)
        if now:
            yield frame([closed(now)])

    def step(now, r):
        fault, distinct, t = r["fault"], now["turns"], r["turn"]
        if t is not None and t != distinct[2]:  # turns arrive in order
            now["turns"] = [distinct[0] + 1, t if distinct[0] == 0 else distinct[1], t]
        for name, mark in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
            now[name] += fault == mark
        if now["before"] is not None:
            now["illegal"] += now["before"] + r["initial"] not in ("su", "ua", "au")
        now["before"] = r["initial"]
        now["audit"].append(r["edits"])
        for e in r["edits"]:
            now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e]
            now["cost"] += CUT_SHORT if fault == TRUNCATED and e in "KR" else 0
        for role, text, now["state"] in put_out(r, now["state"]):
            now["digest"].update(f"{chr(10) if now['some'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            now["some"] = True

    def closed(now):
        n, low, high = now["turns"]
        now["gaps"] = high - low + 1 - n if n else 0
        return [now["conv_id"], *(now[k] for k in kinds), "".join(now["audit"]), now["digest"].hexdigest()]

    names = ["conv_id", *kinds, "audit", "repaired_sha256"]

    def frame(out):
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                          names)

    return _streamed(marked).mapInArrow(run, "conv_id long, " + ", ".join(f"{k} long" for k in kinds)
                                        + ", audit string, repaired_sha256 string")


def audit_damaged(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The audit of every conversation in ``rows`` (``conv_id, turn, role, text``) after :func:`damage`.

    Null roles and texts are one space, so a null text is blank. Rows with a null ``conv_id`` are one conversation.
    Null turns come first; turns that share a number are ordered by role and text. A conversation without rows after
    the damage has zeros, an empty audit and the digest of the empty string. An empty table gives an empty result. No
    other columns are read.
    """
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = audit(repaired(damage(rows.select("conv_id", "turn", "role", "text")), block))
    found = found.withColumnRenamed("conv_id", "_id")
    j = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal",
                                                                  "cost")]
    return j.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
