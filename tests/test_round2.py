"""Faults mended in the second round, one test each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.operators import related, search, vectors
from quarry.operators.index import Index, query_terms
from quarry.sources import files
from quarry.streaming import index as stream_index
from quarry.streaming import messages


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_keeps_the_smallest_ids_of_equal_vectors(spark, metric):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1999, -1, -1)] + [(5000 + i, [float(i), 1.0, 0.0]) for i in range(50)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 1.0, 0.0])], "query_id long, qvec array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        got = vectors.knn(corpus, queries, 5, metric).collect()
        two = vectors.knn(corpus, queries, 5, metric, block_bytes=30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert sorted(r.vec_id for r in got if r.query_id == 1) == [0, 1, 2, 3, 4]
    assert sorted(map(tuple, got)) == sorted(map(tuple, two))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_equals_brute_force(spark, metric):
    r = np.random.default_rng(5)
    x = np.round(r.standard_normal((400, 4)), 1)
    q = np.round(r.standard_normal((30, 4)), 1)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, qvec array<double>")
    got = {}
    for row in vectors.knn(corpus.repartition(5), queries, 7, metric).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    for i, v in enumerate(q):
        if metric == "cosine":
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(v)
            d = -np.divide(x @ v, n, out=np.zeros(len(x)), where=n > 0)
        else:
            d = np.linalg.norm(x - v, axis=1)
        assert got[i] == np.lexsort((np.arange(400), np.round(d, 9)))[:7].tolist()


@pytest.mark.parametrize("cut", [3, 20, 1000])
def test_pruned_ranking_equals_the_full_one(spark, cut):
    rnd = random.Random(cut)
    words = [f"w{min(int(rnd.expovariate(0.15)), 60)}" for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))))
                                  for i in range(150)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))))
                                     for i in range(25)] + [(99, "w0 nowhere")], "item_id long, text string")
    idx = Index.build(docs)
    terms = query_terms(queries, "text", "item_id")
    want = search.rank(idx, terms, "bm25", 4).select("query_id", "doc_id", "rank")
    got = search.top_k_pruned(idx, terms, 4, common_df=cut).select("query_id", "doc_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_the_first_line_of_a_file_can_be_a_header(spark, tmp_path):
    (tmp_path / "e.txt").write_text("3 2 0\nword 1 2\n1987 3 4\n")
    got = {r.label: r.vector for r in files.read_embedding_file(spark, str(tmp_path / "e.txt")).collect()}
    assert got == {"word": [1.0, 2.0], "1987": [3.0, 4.0]}
    lines = spark.createDataFrame([("word 1 2",), ("1987 3 4",)], "value string")
    assert files.parse_embedding_lines(lines).count() == 2


def test_vectors_decode_with_nulls_and_unlike_lengths(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, None), (3, []), (4, [7.0])], "i long, v array<double>")
    back = df.select("i", files.decode_vectors(files.encode_vectors("v")).alias("v")).orderBy("i").collect()
    assert [r.v for r in back] == [[1.5, -2.0], None, [], [7.0]]


def test_csv_reads_doubled_quotes_and_strips_commas(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', "a,b")], "x string, y string")
    files.write_results_csv(df, str(tmp_path / "c"), strip_commas=("y",))
    got = files.read_delimited(spark, str(tmp_path / "c"), (0, 1)).collect()
    assert [tuple(r) for r in got] == [('say "hi", you', "ab")]


def test_terms_of_several_words_are_tracked(spark):
    df = spark.createDataFrame([("I like deep learning",), ("deep water",), ("LEARNING, deep",)], "text string")
    got = messages.track_filter(df, ["deep learning", "nothing"]).collect()
    assert [r.text for r in got] == ["I like deep learning", "LEARNING, deep"]


def test_batch_counts_do_not_multiply_for_repeated_ids(spark):
    df = spark.createDataFrame([(1, 7, "a b"), (1, 8, "a")], "doc_id long, batch_id long, text string")
    terms, _ = stream_index.batch_partials(df)
    got = {r.term: (r.df, r.cf) for r in stream_index.merge_partials(terms).collect()}
    assert got == {"a": (2, 2), "b": (1, 1)}


def test_language_of_texts_without_a_known_trigram(spark):
    known = spark.createDataFrame([("aaa bbb aaa", "long"), ("ccc", "short")], "text string, lang string")
    asked = spark.createDataFrame([(1, "aaa bbb"), (2, "zzz"), (3, "ccc")], "query_id long, text string")
    got = {r.query_id: r.lang for r in related.detect_language(asked, related.trigram_profiles(known)).collect()}
    assert got == {1: "long", 2: "short", 3: "short"}


def test_projection_multiplies_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "i long, v array<double>")
    got = vectors.project(df, "v", np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]])).orderBy("i").collect()
    assert got[0].projected == [1.0, 2.0, 4.0] and got[1].projected is None


def test_broadcast_is_bounded_by_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))

    def hinted(x):
        return "broadcast" in x._jdf.queryExecution().logical().toString().lower()

    assert hinted(session.checked_broadcast(df))
    assert not hinted(session.checked_broadcast(df, max_rows=99))
    assert not hinted(session.checked_broadcast(df, max_bytes=50_000))


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_written_index_keeps_its_partitioning(spark, tmp_path):
    import re

    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 3} beta") for i in range(60)], "doc_id long, text string")
    terms = query_terms(spark.createDataFrame([(1, "alpha w2"), (2, "w1 w6")], "query_id long, text string"))
    built = Index.build(docs, with_positions=True)
    built.write(str(tmp_path / "idx"), buckets=3)
    loaded = Index.load(spark, str(tmp_path / "idx"))
    got = search.rank(loaded, terms, "bm25", k=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.rank(built, terms, "bm25", k=5).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not any("doc_id" in k and "query_id" in k for k in keys), keys


def test_multi_ranker_takes_scored_rankers(spark):
    from quarry.operators import ranking

    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "b c")], "doc_id long, text string")
    terms = query_terms(spark.createDataFrame([(9, "a")], "query_id long, text string"))
    mine = spark.createDataFrame([(9, 3, 0.5), (9, 1, 0.25)], "query_id long, doc_id long, score double")
    got = ranking.multi_rank(Index.build(docs), terms, k=2, scored={"mine": mine}).filter("ranker = 'mine'").collect()
    assert sorted((r["doc_id"], r["rank"], r["max_score"]) for r in got) == [(1, 2, 0.5), (3, 1, 0.5)]
