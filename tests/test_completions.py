"""Precomputed completions against a scan of the dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import suggest as G


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(6)
    out = {"".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 7))): rnd.randint(1, 5) for _ in range(400)}
    return out | {"a" * 60 + x: 1 for x in "bcde"} | {"z" * 3000: 2}


@pytest.mark.parametrize("by", ["alpha", "weight"])
def test_equals_scan(spark, words, by):
    d = spark.createDataFrame(list(words.items()), "entry string, weight long").repartition(5)
    asked = ["a", "ab", "é", " ", "", "abé", "q", "a" * 48, "a" * 60, "a" * 60 + "c", "z" * 3000, "z" * 3001, "a"]
    look = spark.createDataFrame(list(enumerate(asked)), "lookup_id int, prefix string")
    got = {}
    for r in G.suggest_prefix(d, look, 3, by).collect():
        got.setdefault(r.lookup_id, []).append((r["rank"], r.entry))
    for i, p in enumerate(asked):
        fit = [w for w in words if p and w.startswith(p)]
        fit.sort(key=lambda w: (0 if by == "alpha" else -words[w], w))
        assert [e for _, e in sorted(got.get(i, []))] == fit[:3]


def test_a_lookup_reads_at_most_k_rows_of_the_table(spark, words):
    d = spark.createDataFrame(list(words.items()), "entry string, weight long")
    t = G.completions(d, 2)
    assert t.groupBy("prefix").count().agg(F.max("count")).first()[0] == 2
    assert t.filter("length(prefix) > 48").count() == 0
