"""Conversation repair against brute force: damage, faults, cheapest edits, least audits, digests."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import repair

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(turns):
    """Least (cost, audit) by dynamic programming over the states of the grammar, from the end."""
    after = {"-": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {s: (0, "") if s in "-a" else (10**9, "") for s in "-sua"}

    def insert(best):
        for _ in range(4):
            for s in "-sua":
                for out in after[s]:
                    if out != "s" and best[out][0] < 10**9:
                        best[s] = min(best[s], (best[out][0] + 2, "I" + best[out][1]))
        return best

    best = insert(best)
    for initial, fault in reversed(turns):
        now = {}
        for s in "-sua":
            ways = [(best[s][0] + 3, "D" + best[s][1])]
            if fault not in "bd":
                for out in after[s]:
                    extra = fault == "t"
                    if out == initial:
                        ways.append((best[out][0] + extra, "K" + best[out][1]))
                    elif out != "s":
                        ways.append((best[out][0] + 2 + extra, "R" + best[out][1]))
            now[s] = min(ways)
        best = insert(now)
    return best["-"]


def brute(rows):
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    hurt = brute_damage(rows)
    for conv in {r[0] for r in hurt}:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        heads = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(heads))
        cost, audit = cheapest(list(zip([h or " " for h in heads], marks, strict=True)))
        out, state, left = [], "-", iter(mine)
        for e in audit:
            r = next(left) if e != "I" else None
            if e == "D":
                continue
            state = r[2][:1] if e == "K" else "a" if state == "u" else "u"
            out.append(f"{r[2] if e == 'K' else repair.ROLES[state]}:{'' if e == 'I' else r[3]}")
        want[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit,
                      hashlib.sha256("\n".join(out).encode()).hexdigest())
    return want


def corpus(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        length = rnd.choice([1, 2, 5, 9, 30])
        for t in range(length):
            role = "system" if t == 0 and rnd.random() < 0.3 else ("user", "assistant")[t % 2]
            if rnd.random() < 0.15:
                role = rnd.choice(["user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "why ", "A? ", "　", "", None, "b\n"])
            if rnd.random() < 0.7:
                text = f"{rnd.random()} ok."
            turn = rnd.choice([t, t, t, t, t, t + 3, None])
            rows.append((conv if conv else None, turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [3, 64])
def test_equals_brute_force(spark, block):
    rows = corpus(5, 120) + [(10**16 + 1, t, ("user", "assistant")[t % 2], f"{t % 40}.") for t in range(300)]
    rows += [(i, 0, "user", "x") for i in range(5000, 5200)]  # some lose their only turn
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA + ", audit string, at int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audit_damaged(df, block).collect()}
    want = brute(rows)
    assert any(v[6] == "" for v in want.values())
    assert got == want


def test_alignment_of_every_short_conversation():
    ahead = tuple(2 * len(repair.TAIL[s]) for s in repair.STATES)
    kinds = [("s", "-"), ("u", "-"), ("a", "-"), ("u", "t"), ("x", "-"), ("a", "b")]
    for n in (1, 2, 3, 4):
        for turns in itertools.product(kinds, repeat=n):
            cost, audit, state = repair.best_targets(turns, "-", ahead)
            assert (cost, audit + repair.TAIL[state]) == cheapest(turns), turns


def test_band_loses_nothing():
    rnd = random.Random(2)
    for _ in range(200):
        turns = tuple((rnd.choice("sua"), rnd.choice("--tbd")) for _ in range(rnd.randint(1, 12)))
        for length in range(14):
            target = "ua" * 7
            wide = repair.align(turns, target[:length], 1000)
            assert repair.align(turns, target[:length], wide[0]) == wide
            assert repair.align(turns, target[:length], wide[0] - 1) is None


def test_repaired_turns_follow_the_grammar(spark):
    rows = [r for r in corpus(8, 60) if r[0] is not None]
    marked = repair.repaired(repair.damage(spark.createDataFrame(rows, SCHEMA)), 4)
    by = {}
    for r in sorted(repair.repaired_turns(marked).collect(), key=lambda r: (r.conv_id, r.position)):
        by.setdefault(r.conv_id, []).append(r.role[:1])
    assert by and all(re.fullmatch("s?(ua)+", "".join(x)) for x in by.values())


def test_empty(spark):
    assert repair.audit_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
