"""Word vectors meet a document's terms where they lie: no vector is shuffled, and results equal a plain sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ranking, search, vectors, vectors_agg
from quarry.operators.index import Index
from quarry.operators.lexicon import similar_by_bigrams

ROWS = [(1, "a", 2), (1, "b", 1), (1, "zz", 5), (2, "b", 3), (3, "zz", 1), (4, "c", 1), (4, "n", 1), (5, "a", 1), (5, "c", 1)]
WORDS = {"a": [[1.0, 0.0]], "b": [[0.1, 0.5], [0.25, 0.0]], "c": [[-1.0, 0.0]]}  # b has two rows, n none


@pytest.fixture(scope="module")
def tables(spark):
    wv = [(w, v) for w, vs in WORDS.items() for v in vs] + [("n", None)]
    return (spark.createDataFrame(ROWS, "doc_id long, term string, tf long"),
            spark.createDataFrame(wv, "word string, vector array<double>"))


@pytest.fixture(params=[None, 0])
def bound(request, monkeypatch):
    if request.param is not None:  # beyond the bound the vectors are joined
        monkeypatch.setattr(vectors_agg, "SHIPPED_BYTES", request.param)


def expected(weight):
    out = {}
    for d, t, tf in ROWS:
        for v in WORDS.get(t, []):
            out[d] = out.get(d, np.zeros(2)) + weight(tf) * np.array(v)
    return out


def test_sums(tables, bound):
    rows, wv = tables
    got = {r.doc_id: r.vector for r in vectors_agg.word_vector_sum(rows, wv, ["doc_id"], F.col("tf")).collect()}
    want = expected(lambda tf: tf)
    assert set(got) == set(want) and all(np.allclose(got[d], want[d]) for d in want)


def test_means_over_counts_and_distinct_terms(tables, bound):
    rows, wv = tables
    one = rows.withColumn("_x", F.explode(F.sequence(F.lit(1), "tf"))).select("doc_id", "term")
    for more in ({}, {"distinct": True}):
        a = {r.doc_id: r.vector for r in vectors.average_vectors(one, wv, **more).collect()}
        b = {r.doc_id: r.vector for r in vectors.average_vectors(rows, wv, count_col="tf", **more).collect()}
        assert a.keys() == b.keys() and all(a[d] is b[d] is None or np.allclose(a[d], b[d]) for d in a)
    assert np.allclose(b[1], (np.array([1, 0]) + [0.1, 0.5] + [0.25, 0]) / 3)


def test_cosines(spark, tables, bound):
    rows, wv = tables
    q = spark.createDataFrame([(9, "a"), (9, "b"), (8, "zz"), (7, "c")], "query_id long, term string")
    got = {(r.query_id, r.doc_id): r.score for r in vectors.score_word_embeddings(rows, q, wv, "tf").collect()}
    want, dv = {}, {}
    for d, t, tf in ROWS:
        for v in WORDS.get(t, []):
            dv[d] = dv.get(d, np.zeros(2)) + np.array(v) / tf
    for d, t, _ in ROWS:
        for v in WORDS.get(t, []):
            for k in [k for k, x in ((9, "a"), (9, "b"), (7, "c")) if x == t]:
                n = np.linalg.norm(v) * np.linalg.norm(dv[d])
                want[k, d] = (want.get((k, d)) or 0) + np.dot(v, dv[d]) / n if n else None
    assert got.keys() == want.keys()  # document 5's vector is zero: no cosine
    assert all(got[k] is want[k] is None or np.isclose(got[k], want[k]) for k in want)


def index(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i + 1))) for i in range(40)], "doc_id long, text string")
    return Index.build(docs)


def shuffles(df):
    df.collect()  # adaptive plans are final only after they ran
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the index itself is dealt by REPARTITION_BY_COL
    return sum("Exchange hashpartitioning(doc_id" in x and "ENSURE_REQUIREMENTS" in x for x in plan.splitlines())


def test_postings_are_not_shuffled(spark):
    idx = index(spark)
    idx.postings.count()
    wv = spark.createDataFrame([(f"w{i}", [1.0 + i, 2.0]) for i in range(30)], "word string, vector array<double>")
    q = spark.createDataFrame([(1, "w3"), (2, "w9")], "query_id long, term string")
    assert shuffles(vectors_agg.word_vector_sum(idx.postings, wv, ["doc_id"], F.col("tf"))) == 0
    assert shuffles(vectors.score_word_embeddings(idx.postings, q, wv, "tf")) == 0
    assert shuffles(vectors.weighted_vector_sum(idx.postings, idx.term_stats, 40.0, wv)) == 0


def test_tfidf_of_frequent_and_rare_terms(spark, monkeypatch):
    idx = index(spark)
    whole = {(r.doc_id, r.term): r.weight for r in ranking.tfidf_long(idx).collect()}
    assert ranking.frequent_df(idx, 10) == 32 and ranking.frequent_df(idx, 0) == 64 and ranking.frequent_df(idx) == 1
    for n in (0, 10):
        monkeypatch.setattr(ranking, "FREQUENT_TERMS", n)
        assert {(r.doc_id, r.term): r.weight for r in ranking.tfidf_long(idx).collect()} == whole
    assert len(whole) == 40 * 41 // 2


def test_bigram_pairs_are_cut_where_they_arise(spark):
    vocab = spark.createDataFrame([(w,) for w in ("night", "nacht", "light", "x")], "word string")
    r = similar_by_bigrams(spark.createDataFrame([("nights",)], "word string"), vocab)
    assert [(x.similar, x.rank) for x in r.orderBy("rank").collect()] == [("night", 1), ("light", 2)]
    plan = r._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning(query_word" in x]
    assert moves and not any(", word#" in x for x in moves)


def test_only_the_best_documents_of_a_query_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(vectors_agg, "_PAIRS", 7)
    idx = index(spark)
    wv = spark.createDataFrame([(f"w{i}", [1.0 + i % 5, 2.0 - i]) for i in range(30)] + [("w2", [0.0, 0.0])], "word string, vector array<double>")
    q = spark.createDataFrame([(1, "w3"), (1, "w4"), (2, "w9"), (None, "w9"), (3, "w2"), (4, "none")], "query_id long, term string")
    rank = lambda df: sorted(((r.query_id or 0, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect()))
    scores = vectors.score_word_embeddings(idx.postings, q, wv, "tf_idf", 40)
    assert rank(vectors.rank_word_embeddings(idx.postings, q, wv, "tf_idf", 40, k=3)) == rank(search.top_k(scores, 3))
    kept = vectors.score_word_embeddings(idx.postings, q, wv, "tf_idf", 40, best=3)
    assert kept.count() <= 3 * 4 * kept.rdd.getNumPartitions() and "query_id" in kept.columns
    plan = vectors.rank_word_embeddings(idx.postings, q, wv, "tf", k=3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(query_id, doc_id" not in plan.replace("#", " ").replace("  ", " ")
    assert "MapInArrow" in plan
