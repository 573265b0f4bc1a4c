"""Spelling variants against brute force: counting, edit distance, forms and roots."""

import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import spelling


def brute_words(rows, damage=97):
    total = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def corpus(seed, letters, size, docs):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 9))) for _ in range(size)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rnd.randint(0, 80)):
            w = base[min(int(rnd.expovariate(0.05)), size - 1)]
            if rnd.random() < 0.1:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice(letters) + w[k:],
                                w[:k] + rnd.choice(letters) + w[k + 1:]])
            words.append(w if rnd.random() < 0.8 else w.upper())
        rows.append((i, rnd.choice([" ", "-", "1"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "letters", "tile"), [(1, "abcd", 8), (2, "aé×stß", 1024), (3, "ab", 4)])
def test_equals_brute_force(spark, monkeypatch, seed, letters, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    real = spelling.tiles
    monkeypatch.setattr(spelling, "tiles", lambda words: real(words, tile))
    monkeypatch.setattr(spelling, "_CELLS", 5000)
    rows = [*corpus(seed, letters, 60, 250), (None, "Xabcde xabcde xabcdf " * 3), (7, None), (8, ""),
            (9, "q" * 70_000 + " "), (9, "q" * 70_000), (9, "q" * 70_000), (9, ("q" * 69_999 + " ") * 3)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    want = brute(rows)
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert got == want


def test_edits_by_prefix_and_suffix():
    words = ["aaaaa", "aaaaaa", "abaaa", "baaab", "aaaab", "aaaba"]
    left, right, size = spelling.matrices(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i != j:
                p = spelling.common(left[i:i + 1], left[j:j + 1])[0]
                s = spelling.common(right[i:i + 1, ::-1], right[j:j + 1, ::-1])[0]
                assert (p + s >= max(len(a), len(b)) - 1) == one_edit(a, b)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []


def test_groups_are_never_broadcast(spark, tmp_path):
    """The estimate of an exploded table is that of the table before, far too low; no threshold may decide by it."""
    rows = [(f"word{a}{b}", 5) for a in "abcdefgh" for b in "abcdefgh"]
    spark.createDataFrame(rows, "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    plan = spelling.tiles(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    ends = words.select(words.word.alias("_w"), words.word.alias("root"))
    big = words.join(spelling.broadcast_if_small(ends.hint("merge"), 1 << 40), words.word == ends._w, "left")
    small = words.join(spelling.broadcast_if_small(ends.hint("merge"), 128), words.word == ends._w, "left")
    assert "SortMergeJoin" in big._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
