"""Hits are explained from their own documents' postings, and a sketch moves a document's hashes once."""

from pyspark.sql import functions as F

from quarry.operators import lsh, search
from quarry.operators.index import Index, query_terms


def final_plan(df):
    df.collect()  # adaptive plans are final only after they ran
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hits_are_computed_once_and_explained_in_full(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % 7}" for j in range(i % 11 + 1))) for i in range(60)], "doc_id long, text string")
    index = Index.build(docs)
    q = query_terms(spark.createDataFrame([(1, "w0 w3 w3"), (2, "w6 none")], "query_id long, text string"))
    hits = search.top_k(search.score(index, q), 3)
    e = search.explain(index, q, hits)
    got = {(r.query_id, r.doc_id): r.s for r in e.groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("s")).collect()}
    want = {(r.query_id, r.doc_id): r.score for r in hits.collect()}
    assert len(want) == 6 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Window" not in final_plan(e)


def test_sketch_shuffles_once(spark):
    rows = [(1, ["a", "b", None, "a"]), (2, ["b"]), (1, ["c"]), (3, None), (4, []), (5, [None]), (None, ["d", "b"])]
    df = spark.createDataFrame(rows, "id long, sh array<string>")
    s = lsh.sketch(df, "id", "sh", 16)
    want = {}
    for i, words in rows:
        for w in words or []:
            if w is not None:
                want.setdefault(i, set()).add(w)
    hashes = {r.w: r.h for r in spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "w string").select("w", lsh.hash32("w").alias("h")).collect()}
    got = {r.id: r for r in s.collect()}
    assert got.keys() == want.keys()
    for i, words in want.items():
        least = {}
        for h in (hashes[w] for w in words):
            least[h % 16] = min(h, least.get(h % 16, h))
        assert got[i].n_filled == len(least) and set(got[i].sketch) == set(least.values()) and len(got[i].sketch) == 16
    assert final_plan(s).count("Exchange hashpartitioning") == 1
