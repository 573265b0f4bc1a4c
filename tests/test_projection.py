"""Projections per language pair against numpy, and what they expand to."""

import numpy as np
import pytest

from quarry.operators import vectors as V


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(4)
    turn = {"fr": rng.normal(size=(3, 4)), "de": rng.normal(size=(3, 4)), "it": np.zeros((3, 4))}
    rows = []
    for lang, m in turn.items():
        for i in range(2 if lang == "it" else 40):
            s = rng.normal(size=3)
            rows.append((lang, f"w{i}", s.tolist(), (s @ m + rng.normal(size=4) * 0.1).tolist()))
    return rows, spark.createDataFrame(rows, "lang string, word string, src array<double>, tgt array<double>").repartition(5)


def test_one_pass_equals_least_squares(pairs):
    rows, df = pairs
    got = {r.lang: np.array(r.matrix).reshape(r.d, r.e) for r in V.translation_matrices(df, ["lang"]).collect()}
    assert set(got) == {"fr", "de", "it"}
    for lang, m in got.items():
        s, t = (np.array([r[c] for r in rows if r[0] == lang]) for c in (2, 3))
        assert np.allclose(m, np.linalg.pinv(s) @ t, atol=1e-8)


def test_diagonal_scales_each_dimension(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], [2.0, 5.0]), ("a", [3.0, 0.0], [2.0, 1.0])],
                               "k string, src array<double>, tgt array<double>")
    r = V.translation_matrices(df, ["k"], diagonal=True).first()
    assert r.matrix == pytest.approx([8 / 10, 0, 0, 0]) and (r.d, r.e) == (2, 2)


def test_languages_expand_differently(spark, pairs):
    rows, df = pairs
    m = V.translation_matrices(df, ["lang"])
    same = [("fr", "q", [1.0, -1.0, 0.5]), ("de", "q", [1.0, -1.0, 0.5]), ("xx", "q", [1.0, -1.0, 0.5])]
    got = {r.lang: r.projected for r in V.project_by(
        spark.createDataFrame(same, "lang string, word string, v array<double>"), "v", m, ["lang"]).collect()}
    assert set(got) == {"fr", "de"} and not np.allclose(got["fr"], got["de"])
    w = {r.lang: np.array(r.matrix).reshape(3, 4) for r in m.collect()}
    assert np.allclose(got["fr"], np.array([1.0, -1.0, 0.5]) @ w["fr"])


def test_no_pairs(pairs):
    assert V.translation_matrices(pairs[1].limit(0), ["lang"]).count() == 0
