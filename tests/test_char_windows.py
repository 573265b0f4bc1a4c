"""Character windows against a plain cut of the joined texts; what they move."""

import random

import pytest

from quarry.operators import corpus


@pytest.mark.parametrize("length", [4, 10])
def test_windows_equal_a_plain_cut(spark, length):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("abcé ×\n") for _ in range(rnd.choice([0, 1, 3, 9, 40, 95])))) for i in range(40)]
    rows[7] = (7, None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    s = "".join((t or "") + "\n" for _, t in rows)
    want = {i: (s[i * length:i * length + length - 1], s[i * length + 1:(i + 1) * length])
            for i in range(max((len(s) - 1) // length - 2, 0))}
    got = corpus.char_windows(docs, length).collect()
    assert len(got) == len(want) and {r.window_id: (r.input, r.target) for r in got} == want


def test_texts_move_as_strings_and_few_pieces_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(corpus, "checked_broadcast", lambda df: df)  # as with more starts than may be broadcast
    docs = spark.createDataFrame([(i, "abcdefghij" * 50) for i in range(20)], "doc_id long, text string")
    w = corpus.char_windows(docs, 10)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan  # no array of single characters
    assert w.count() == (20 * 501 - 1) // 10 - 2
    grouped = [line for line in plan.split("\n") if "Aggregate" in line]
    assert grouped and "Union" in plan  # whole windows pass the aggregate by
