"""Postings are counted a document at a time; documents that share an id and a length are still summed."""

import collections

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as I

DOCS = [(1, "b a b c"), (1, "a a b d"), (1, "a b"), (2, "x"), (3, ""), (4, None), (None, "n m n"), (None, "n n m"), (5, "é b é")]


def expected(docs):
    out = collections.defaultdict(list)
    for d, text in docs:
        words = (text or "").split()
        for i, w in enumerate(words):
            out[d, w, len(words)].append(i)
    return {k: (len(p), min(p), sorted(p)) for k, p in out.items()}


def rows(df):
    got = [((r.doc_id, r.term, r.dl), (r.tf, r.first_pos, list(r.positions))) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("docs", [DOCS, [x for i, x in enumerate(DOCS) if i in (0, 3, 4, 5, 6, 8)], DOCS[4:6], []])
def test_postings_equal_a_plain_count(spark, monkeypatch, docs):
    monkeypatch.setattr(I, "_TOKENS", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    p = I.build_postings(df, with_positions=True)
    assert rows(p) == expected(docs)
    assert dict(p.dtypes) == {"doc_id": "bigint", "term": "string", "tf": "bigint", "dl": "int", "first_pos": "int", "positions": "array<int>"}
    assert I.build_postings(df).exceptAll(p.drop("positions")).isEmpty()


def test_a_null_token_is_a_term(spark):
    df = spark.createDataFrame([(1, ["a", None, None]), (2, None), (3, ["a"])], "doc_id long, text array<string>")
    p = I.build_postings(df, analyzer=lambda c: c, with_positions=True)
    assert rows(p) == {(1, "a", 3): (1, 0, [0]), (1, None, 3): (2, 1, [1, 2]), (3, "a", 1): (1, 0, [0])}


def test_documents_of_one_id_are_told_apart_by_kept_columns(spark):
    df = spark.createDataFrame([(1, 7, "a b"), (1, 8, "a a"), (2, 7, "c")], "doc_id long, batch long, text string")
    got = {(r.doc_id, r.batch, r.term): r.tf for r in I.build_postings(df, keep=["batch"]).collect()}
    assert got == {(1, 7, "a"): 1, (1, 7, "b"): 1, (1, 8, "a"): 2, (2, 7, "c"): 1}


def test_unique_ids_need_no_aggregate_over_postings(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.lit("a"), "id").alias("text"))
    p = I.build_postings(df)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("regexp_extract_all") == 1
    counts = p.groupBy("doc_id", "term").count()  # what lies together by the id is not shuffled again
    counts.collect()
    final = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning(doc_id") == 1
