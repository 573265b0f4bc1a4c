"""Span deduplication against brute force."""

import random

import pytest

from quarry.llm import spans


def brute(rows, w):
    """Removed unit numbers per row, by comparing the words of every span with all earlier ones."""
    found = {}
    table = []
    for i, (d, t) in enumerate(rows):
        us = spans.units(t) if t and d is not None else []
        for s in range(len(us)):
            if not us[s].split():
                continue
            e, n = s, 0
            while e < len(us) and n < w:
                n += len(us[e].split())
                e += 1
            if n >= w:
                key = tuple(" ".join(u.split()) for u in us[s:e] if u.split())
                table.append((i, d, s, e, key))
                found.setdefault(key, set()).add(d)
    gone = [set() for _ in rows]
    seen = set()
    for i, d, s, e, key in table:
        if d > min(found[key]) or (i, key) in seen:
            gone[i] |= set(range(s, e))
        seen.add((i, key))
    return gone


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocab = "alpha beta gamma delta eps zeta eta theta".split()
    sentences = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6))).capitalize() + rnd.choice(".!?")
                 for _ in range(60)]
    out = [(i, "".join(rnd.choice(sentences) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randint(0, 12))))
           for i in range(200)]
    return out + [(300, None), (301, ""), (302, " \n "), (None, out[0][1]), out[5], (400, "no marks " * 40)]


def test_removed_units_match_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n_removed_ long")
    got = {r.n_removed_: r for r in spans.dedup_spans(df, 8).collect()}
    assert len(got) == len(rows)
    for i, ((_, t), gone) in enumerate(zip(rows, brute(rows, 8), strict=True)):
        us = spans.units(t) if t else []
        want = None if t is None else "".join(u for j, u in enumerate(us) if j not in gone)
        assert got[i].text == want and got[i].n_removed == len(gone) and got[i].n_units == len(us)
        left = list(t or "")
        for r in reversed(got[i].removed):
            del left[r.start:r.end]
        assert t is None or "".join(left) == want


def test_units_concatenate_to_the_text():
    rnd = random.Random(2)
    for _ in range(500):
        t = "".join(rnd.choice("aB. ,\n!?\tÉé1  ;:") for _ in range(rnd.randint(0, 60)))
        assert "".join(spans.units(t)) == t


def test_passage_pasted_into_sentences_is_caught(spark):
    rnd = random.Random(3)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    passage = ". ".join(words(9).capitalize() for _ in range(7)) + "."
    rows = [(i, f"{words(20)} {passage} {words(20)}. {words(30)}.") for i in range(20)]
    rows += [(100 + i, f"{words(40)}. {words(40)}.") for i in range(20)]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[100 + i].n_removed == 0 for i in range(20))
    kept = set(passage.split(". ")[1:-1])
    assert all(not any(s in got[i].text for s in kept) for i in range(1, 20))


def test_passage_without_marks_is_caught_wherever_it_starts():
    rnd = random.Random(4)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))

    def keys(text):
        _, _, h1, h2 = spans.span_table(text)
        return set(zip(h1.tolist(), h2.tolist(), strict=True))

    for i in range(400):
        passage = words(47 + i % 5)
        a, b = (f"{words(rnd.randint(1, 40))} {passage} {words(rnd.randint(1, 40))}. {words(30)}." for _ in range(2))
        assert keys(a) & keys(b)
        assert "".join(spans.units(a)) == a and max(len(u.split()) for u in spans.units(a)) <= 8
    longest = spans.units("same " * 50)
    assert "".join(longest) == "same " * 50 and max(len(u.split()) for u in longest) <= 8


def test_51_word_passage_without_marks_is_cut(spark):
    rnd = random.Random(8)

    def words(n):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    passage = words(51)
    rows = [(i, f"{words(9 + i)} {passage} {words(20)}. {words(30)}.") for i in range(10)]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    middle = " ".join(passage.split()[8:-14])
    assert middle in got[0].text and got[0].n_removed == 0
    assert all(middle not in got[i].text and got[i].n_removed > 0 for i in range(1, 10))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, n_removed int")
    assert spans.dedup_spans(df.limit(0)).count() == 0
    assert spans.dedup_spans(df).columns == ["doc_id", "text", "n_removed", "n_units", "removed"]
