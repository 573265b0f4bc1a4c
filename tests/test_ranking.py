"""Rankers on the four-title fixture against the golden values."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators.index import Index, query_terms

TITLES = [
    "riemann bernhard - life and works of bernhard riemann",
    "thomas bernhard biography - bio and influence in literature",
    "riemann hypothesis - a deep dive into a mathematical mystery",
    " ".join(["bernhard"] * 10),
]
QUERY = "bernhard riemann influence"

GOLDEN = {  # doc -> (bm25 1.2/.75, bm25 2.5/.2, jm .1, dirichlet 2000, classic idf², classic idf¹)
    0: (1.465194, 1.642663, 4.903156, 0.005213, 1.781284, 1.288805),
    1: (1.594990, 1.572471, 4.351659, 0.005213, 1.722750, 1.046478),
    2: (0.678538, 0.687974, 2.279828, 0.0, 0.721820, 0.477765),
    3: (0.697661, 0.996592, 3.260840, 0.008845, 1.496080, 1.223144),
}


@pytest.fixture(scope="module")
def fixture(spark):
    docs = spark.createDataFrame(list(enumerate(TITLES)), "doc_id long, text string")
    idx = Index.build(docs, analyzer="whitespace")
    q = query_terms(spark.createDataFrame([(1, QUERY)], "query_id long, text string"), analyzer="whitespace")
    return idx, q


@pytest.mark.parametrize("col,sim,params", [
    (0, "bm25", {}), (1, "bm25", {"k1": 2.5, "b": 0.2}), (2, "lm_jm", {"lam": 0.1}),
    (3, "lm_dirichlet", {"mu": 2000.0}), (4, "classic", {}), (5, "classic", {"idf_power": 1.0}),
])
def test_golden_scores(fixture, col, sim, params):
    idx, q = fixture
    got = {r.doc_id: r.score for r in search.score(idx, q, sim, **params).collect()}
    assert set(got) == {0, 1, 2, 3}
    for d, vals in GOLDEN.items():
        assert got[d] == pytest.approx(vals[col], abs=1e-5)


def test_doc_lengths(fixture):
    idx, _ = fixture
    assert {r.doc_id: r.dl for r in idx.doc_lengths.collect()} == {0: 9, 1: 9, 2: 10, 3: 10}


def test_topk_equals_sort_limit(fixture):
    idx, q = fixture
    scored = search.score(idx, q, "bm25")
    top = [r.doc_id for r in search.top_k(scored, 2).orderBy("rank").collect()]
    ref = [r.doc_id for r in scored.orderBy(F.col("score").desc(), "doc_id").limit(2).collect()]
    assert top == ref == [1, 0]


def test_phrase_one_hit(spark):
    caps = spark.createDataFrame([(0, "white sports car"), (1, "black fluo sports car"), (2, "black sports car")],
                                 "doc_id long, text string")
    idx = Index.build(caps, analyzer="whitespace", with_positions=True)
    ph = spark.createDataFrame([(7, 0, "black"), (7, 1, "sports"), (7, 2, "car")], "query_id long, offset int, term string")
    hits = search.phrase_search(idx, ph).collect()
    assert [(h.query_id, h.doc_id, h.freq) for h in hits] == [(7, 2, 1)]


def test_boolean_clauses(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string")
    idx = Index.build(docs, analyzer="whitespace")

    def terms(*ts):
        return spark.createDataFrame([(1, t) for t in ts], "query_id long, term string")
    must = {r.doc_id for r in search.boolean_search(idx, must=terms("a", "b")).collect()}
    assert must == {0, 1}
    orq = {r.doc_id for r in search.boolean_search(idx, should=terms("a", "c")).collect()}
    assert orq == {0, 1, 2}
    notq = {r.doc_id for r in search.boolean_search(idx, should=terms("b"), must_not=terms("c")).collect()}
    assert notq == {1}
    msm = {r.doc_id for r in search.boolean_search(idx, should=terms("a", "b", "c"), min_should_match=3).collect()}
    assert msm == {0}


def test_score_sum_needs_no_shuffle(fixture):
    """Postings are partitioned by document, so summing per (query, doc)
    behind a broadcast query side plans no exchange on that key."""
    import re

    idx, q = fixture
    plan = search.rank(idx, q, "bm25", k=2)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not any("doc_id" in e and "query_id" in e for e in exchanges), exchanges
