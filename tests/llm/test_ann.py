"""Nearest neighbours: recall against brute force, ties, broken vectors."""

import numpy as np
import pytest

from quarry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, node string"


def brute(rows, top=5):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v
          and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
    ok = list({i: (i, v) for i, v in ok}.values())
    x = np.stack([v / np.abs(v).max() for _, v in ok])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids = np.array([i for i, _ in ok])
    out = {}
    for k in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[k], 12)
        s[k] = -9
        out[ids[k]] = [(ids[j], s[j]) for j in np.lexsort((ids, -s))[:top] if j != k]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_recall(spark, kind):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 24))
    if kind == "clustered":
        x = x[:20].repeat(75, axis=0) + 0.1 * x
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_ties_copies_and_broken_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300, 0, -1)]  # ids 50, 100, ... are queries among 300 copies
    rows += [(1000, [2.0, 4.0]), (1001, None), (1050, [0.0, 0.0]), (1100, [1.0, None]), (1150, [float("nan"), 1.0]),
             (1200, [float("inf"), 1.0]), (1250, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (1300, [3e38, 3e38])]
    got = run(spark, rows)
    assert [i for i, _ in got[50]] == [1, 2, 3, 4, 5] and all(abs(s - 1) < 1e-12 for _, s in got[50])
    assert [i for i, _ in got[1000]] == [1, 2, 3, 4, 5]
    assert set(got) == {50, 100, 150, 200, 250, 300, 1000, 1300}


def test_few_or_no_candidates(spark):
    assert [i for i, _ in run(spark, [(0, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.0, 1.0])])[0]] == [3, 4]
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, [(0, None)]) == {}
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
