"""Vector operators over ``embeddings`` and a word-vector table derived from it.

The word-vector table maps the n-th most frequent document term (ties
alphabetical, n from 0) to the embedding with ``vec_id = n``, so no trained
model enters an oracle-checked query.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quarry.functions import vectors as VX
from quarry.operators import vectors as V
from quarry.operators.corpus import global_ordinal
from quarry.operators.index import tokenize
from quarry.operators.search import top_k
from quarry.operators.vectors_agg import vector_sum
from quarry.plans import register
from quarry.plans.common import (SQL_BENCH_TERMS, SQL_INDEX, bench_terms, doc_index, r6,
                                 sql_std_tokens, sql_topk, tbl)

_WV_CACHE: dict = {}

SQL_WV = f"""
tf_all AS (SELECT term, count(*) AS freq FROM (SELECT unnest({sql_std_tokens('text')}) AS term FROM documents) GROUP BY term),
vr AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term) - 1 AS r FROM tf_all),
wv AS (SELECT vr.term AS word, list_transform(e.embedding, lambda x: x::DOUBLE) AS vector FROM vr JOIN embeddings e ON e.vec_id = vr.r)"""

SQL_CENTROIDS = """
ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
cl AS (SELECT label, i, avg(v) AS c FROM ex GROUP BY label, i)"""


def word_vectors(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WV_CACHE:
        counts = doc_index(spark, sf_dir).term_stats.select(F.col("term").alias("word"), F.col("cf").alias("freq"))
        ranked = global_ordinal(counts, [F.col("freq").desc(), F.col("word").asc()], out="r")
        emb = tbl(spark, sf_dir, "embeddings")
        wv = ranked.join(emb, F.col("r") - 1 == F.col("vec_id")).select(
            "word", VX.to_double("embedding").alias("vector"))
        _WV_CACHE[key] = wv.persist(StorageLevel.MEMORY_AND_DISK)
    return _WV_CACHE[key]


def centroids(spark, sf_dir):
    e = tbl(spark, sf_dir, "embeddings")
    return vector_sum(e, ["label"], "embedding", mean=True, out="qvec").withColumnRenamed("label", "query_id")


def _long(df, key, vec):
    return df.select(key, F.posexplode_outer(vec).alias("dim", "value")).filter(F.col("dim").isNotNull()).select(
        key, F.col("dim").cast("long"), r6("value").alias("value"))


@register("knn_exact", f"""WITH {SQL_CENTROIDS},
d AS (SELECT cl.label AS query_id, ex.vec_id, sqrt(sum((ex.v - cl.c) * (ex.v - cl.c))) AS distance
      FROM ex JOIN cl USING (i) GROUP BY cl.label, ex.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM d)
SELECT query_id::BIGINT AS query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""")
def knn_exact(spark, sf_dir):
    """V6/V8: 10 nearest embeddings (Euclidean) to every label centroid."""
    r = V.knn(tbl(spark, sf_dir, "embeddings"), centroids(spark, sf_dir), k=10)
    return r.select(F.col("query_id").cast("long"), "vec_id", r6("distance").alias("distance"),
                    F.col("rank").cast("long"))


@register("nearest_docs", f"""WITH {SQL_CENTROIDS},
d AS (SELECT cl.label AS query_id, ex.vec_id, sum(ex.v * cl.c) / (sqrt(sum(ex.v * ex.v)) * sqrt(sum(cl.c * cl.c))) AS similarity
      FROM ex JOIN cl USING (i) GROUP BY cl.label, ex.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM d)
SELECT query_id::BIGINT AS query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""")
def nearest_docs(spark, sf_dir):
    """V5: 10 most cosine-similar embeddings to every label centroid."""
    r = V.knn(tbl(spark, sf_dir, "embeddings"), centroids(spark, sf_dir), k=10, metric="cosine")
    return r.select(F.col("query_id").cast("long"), "vec_id", r6("similarity").alias("similarity"),
                    F.col("rank").cast("long"))


@register("knn_rerank", f"""WITH {SQL_CENTROIDS},
d AS (SELECT cl.label AS query_id, ex.vec_id,
             sqrt(sum(CASE WHEN ex.i <= 32 THEN (ex.v - cl.c) * (ex.v - cl.c) ELSE 0 END)) + 1e-10 AS d0,
             sqrt(sum(CASE WHEN ex.i > 32 THEN (ex.v - cl.c) * (ex.v - cl.c) ELSE 0 END)) + 1e-10 AS d1
      FROM ex JOIN cl ON ex.label = cl.label AND ex.i = cl.i GROUP BY cl.label, ex.vec_id),
s AS (SELECT query_id, vec_id, 1.0 + 1.0 / d0 + 1.0 / d1 AS score FROM d WHERE d0 <= 1.5 AND d1 <= 1.5)
SELECT query_id::BIGINT AS query_id, vec_id, round(score, 6) AS score, rank FROM {sql_topk('s', 10, idc='vec_id')}""")
def knn_rerank(spark, sf_dir):
    """V7: candidates = embeddings of the centroid's label (constant score 1);
    reranked by the distances of both 32-dim halves, threshold 1.5, top-10."""
    e = tbl(spark, sf_dir, "embeddings")
    halves = e.select("vec_id", "label", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    cents = centroids(spark, sf_dir)
    qv = cents.select("query_id", F.slice("qvec", 1, 32).alias("a"), F.slice("qvec", 33, 32).alias("b"))
    hits = halves.select(F.col("label").alias("query_id"), "vec_id", F.lit(1.0).alias("score"))
    r = V.knn_rerank(hits, halves, qv, ["a", "b"], threshold=1.5, k=10)
    return r.select(F.col("query_id").cast("long"), "vec_id", r6("score").alias("score"), F.col("rank").cast("long"))


@register("avg_word_vectors", f"""WITH {SQL_WV},
tk AS (SELECT doc_id, unnest({sql_std_tokens('text')}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY doc_id),
x AS (SELECT tk.doc_id, unnest(wv.vector) AS v, generate_subscripts(wv.vector, 1) - 1 AS dim FROM tk JOIN wv ON wv.word = tk.term)
SELECT x.doc_id, dim::BIGINT AS dim, round(sum(v) / any_value(n.n), 6) AS value FROM x JOIN n USING (doc_id) GROUP BY x.doc_id, dim""")
def avg_word_vectors(spark, sf_dir):
    """V3: mean word vector per document over every token; OOV tokens add the
    (zero) UNK vector, so they count in the denominator."""
    post = doc_index(spark, sf_dir).postings
    v = V.average_vectors(post, word_vectors(spark, sf_dir), count_col="tf").filter(F.col("vector").isNotNull())
    return _long(v, "doc_id", "vector")


@register("avg_distinct_vectors", f"""WITH {SQL_WV},
tk AS (SELECT DISTINCT doc_id, unnest({sql_std_tokens('text')}) AS term FROM documents),
k AS (SELECT tk.doc_id, wv.vector FROM tk JOIN wv ON wv.word = tk.term),
x AS (SELECT doc_id, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS dim FROM k)
SELECT doc_id, dim::BIGINT AS dim, round(avg(v), 6) + 0.0 AS value FROM x GROUP BY doc_id, dim""")
def avg_distinct_vectors(spark, sf_dir):
    """Mean over a document's distinct known terms, OOV skipped."""
    post = doc_index(spark, sf_dir).postings
    return _long(V.average_vectors(post, word_vectors(spark, sf_dir), distinct=True), "doc_id", "vector")


@register("tfidf_avg_vectors", f"""WITH {SQL_INDEX}, {SQL_WV},
k AS (SELECT m.doc_id, wv.vector, 1 + ln(tf) * ln(n_docs / df) AS w FROM m JOIN wv ON wv.word = m.term),
x AS (SELECT doc_id, w, unnest(vector) AS v, generate_subscripts(vector, 1) - 1 AS dim FROM k)
SELECT doc_id, dim::BIGINT AS dim, round(sum(v / w), 6) AS value FROM x GROUP BY doc_id, dim""")
def tfidf_avg_vectors(spark, sf_dir):
    """Σ word vector / tf-idf weight over a document's distinct terms."""
    idx = doc_index(spark, sf_dir)
    v = V.weighted_vector_sum(idx.postings, idx.term_stats, idx.stats()["n_docs"], word_vectors(spark, sf_dir))
    return _long(v, "doc_id", "vector")


# What divides a word's vector in its document's vector, per smoothing.
SMOOTHING_SQL = {"mean": "1.0", "tf": "post.tf", "idf": "1.0",
                 "tf_idf": "(1 + ln(post.tf) * ln((SELECT n_docs FROM fs)))"}


def sql_word_embeddings(smoothing: str) -> str:
    """CTEs up to ``we_scored(query_id, doc_id, score)``."""
    return f"""
dx AS (SELECT post.doc_id, unnest(wv.vector) / w AS v, generate_subscripts(wv.vector, 1) AS i
       FROM (SELECT post.*, {SMOOTHING_SQL[smoothing]} AS w FROM post) post JOIN wv ON wv.word = post.term),
dv AS (SELECT doc_id, i, sum(v) AS v FROM dx GROUP BY doc_id, i),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM dv GROUP BY doc_id),
q AS (SELECT DISTINCT qt.query_id, qt.term FROM qt JOIN wv ON wv.word = qt.term),
qx AS (SELECT q.query_id, q.term, unnest(wv.vector) AS v, generate_subscripts(wv.vector, 1) AS i FROM q JOIN wv ON wv.word = q.term),
qn AS (SELECT query_id, term, sqrt(sum(v * v)) AS n FROM qx GROUP BY query_id, term),
pairs AS (SELECT q.query_id, q.term, post.doc_id FROM q JOIN post USING (term)),
dots AS (SELECT p.query_id, p.term, p.doc_id, sum(qx.v * dv.v) AS dot
         FROM pairs p JOIN qx ON qx.query_id = p.query_id AND qx.term = p.term JOIN dv ON dv.doc_id = p.doc_id AND dv.i = qx.i
         GROUP BY p.query_id, p.term, p.doc_id),
we_scored AS (SELECT dots.query_id, dots.doc_id, sum(dot / (qn.n * dn.n)) AS score
           FROM dots JOIN qn USING (query_id, term) JOIN dn USING (doc_id) GROUP BY dots.query_id, dots.doc_id)"""


def _register_word_embeddings(name: str, smoothing: str):
    @register(name, f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {SQL_WV}, {sql_word_embeddings(smoothing)}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {sql_topk('we_scored', 10)}""")
    def run(spark, sf_dir):
        idx = doc_index(spark, sf_dir)
        r = V.rank_word_embeddings(idx.postings, bench_terms(spark, sf_dir), word_vectors(spark, sf_dir), smoothing,
                                   n_docs=idx.stats()["n_docs"], k=10)
        return r.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"))

    run.__doc__ = f"""R10: Σ over matching query terms of cos(word vector, document vector), {smoothing} smoothing;
    top-10 per benchmark passage."""


for _name, _smoothing in (("rank_word_embeddings", "mean"), ("rank_word_embeddings_tf", "tf"),
                          ("rank_word_embeddings_idf", "idf"), ("rank_word_embeddings_tf_idf", "tf_idf")):
    _register_word_embeddings(_name, _smoothing)


@register("nearest_words", f"""WITH {SQL_BENCH_TERMS}, {SQL_WV},
q AS (SELECT DISTINCT qt.term AS word FROM qt JOIN wv ON wv.word = qt.term),
s AS (SELECT q.word AS query_word, w2.word AS neighbour, list_cosine_similarity(w1.vector, w2.vector) AS similarity
      FROM q JOIN wv w1 ON w1.word = q.word JOIN wv w2 ON w2.word <> q.word),
r AS (SELECT *, row_number() OVER (PARTITION BY query_word ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM s)
SELECT query_word, neighbour, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def nearest_words(spark, sf_dir):
    """V2: five most similar other words (cosine) for every benchmark word with a vector."""
    wv = word_vectors(spark, sf_dir)
    q = (bench_terms(spark, sf_dir).select(F.col("term").alias("word")).distinct()
         .join(wv, "word").select(F.col("word").alias("query_id"), F.col("vector").alias("qvec")))
    r = V.knn(wv, q, k=6, metric="cosine", id_col="word", vec_col="vector")
    r = r.filter(F.col("query_id") != F.col("word"))
    r = top_k(r, 5, score_col="similarity", id_col="word")
    return r.select(F.col("query_id").alias("query_word"), F.col("word").alias("neighbour"),
                    r6("similarity").alias("similarity"), F.col("rank").cast("long"))


# ---- projection, translation, PCA, clustering, histograms ------------------
import numpy as np  # noqa: E402

from quarry.functions import text as TX  # noqa: E402
from quarry.operators import docvec  # noqa: E402
from quarry.operators import search as S  # noqa: E402
from quarry.session import checked_broadcast  # noqa: E402


def _halves(wv):
    return wv.select("word", F.slice("vector", 1, 32).alias("src"), F.slice("vector", 33, 32).alias("tgt"))


@register("translation_matrix")
def translation_matrix(spark, sf_dir):
    """V9: least-squares map from the first 32 dims (source space) to the last
    32 (target space) over the word-vector dictionary; W as (row, col, value)."""
    W = V.translation_matrix(_halves(word_vectors(spark, sf_dir)))
    rows = [(int(i), int(j), float(W[i, j])) for i in range(W.shape[0]) for j in range(W.shape[1])]
    return spark.createDataFrame(rows, "row long, col long, value double")


@register("translate_words")
def translate_words(spark, sf_dir):
    """Project every benchmark word's source vector and return the 3
    nearest target-space words (cosine); OOV words give no rows."""
    h = _halves(word_vectors(spark, sf_dir))
    W = V.translation_matrix(h)
    q = (bench_terms(spark, sf_dir).select(F.col("term").alias("word")).distinct().join(h, "word"))
    q = V.project(q, "src", W, out="qvec").select(F.col("word").alias("query_id"), "qvec")
    r = V.knn(h.select("word", F.col("tgt").alias("vector")), q, k=3, metric="cosine", id_col="word", vec_col="vector")
    return r.select(F.col("query_id").alias("source_word"), F.col("word").alias("translation"),
                    r6("similarity").alias("score"), F.col("rank").cast("long"))


def _nearest_other(spark, sf_dir, words_df, k=1):
    wv = word_vectors(spark, sf_dir)
    q = words_df.join(wv, "word").select(F.col("word").alias("query_id"), F.col("vector").alias("qvec"))
    r = V.knn(wv, q, k=k + 1, metric="cosine", id_col="word", vec_col="vector")
    r = r.filter(F.col("query_id") != F.col("word"))
    return top_k(r, k, score_col="similarity", id_col="word")


SQL_NN1 = """
qw AS (SELECT DISTINCT term AS word FROM qt),
nn AS (SELECT q.word AS src, w2.word AS dst, list_cosine_similarity(w1.vector, w2.vector) AS sim
       FROM qw q JOIN wv w1 ON w1.word = q.word JOIN wv w2 ON w2.word <> q.word),
tr AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS r FROM nn) WHERE r = 1)"""


@register("translate_text", f"""WITH {SQL_BENCH_TERMS}, {SQL_WV}, {SQL_NN1},
tk AS (SELECT item_id AS query_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos
       FROM (SELECT item_id, {sql_std_tokens('text')} AS t FROM benchmark))
SELECT query_id, string_agg(coalesce(tr.dst, tk.term), ' ' ORDER BY pos) AS translation, round(avg(tr.sim), 6) AS score
FROM tk LEFT JOIN tr ON tr.src = tk.term GROUP BY query_id""")
def translate_text(spark, sf_dir):
    """Token-wise top-1 translation (nearest other word), joined in order;
    OOV tokens pass through; score = mean of the known tokens' scores."""
    toks = tokenize(tbl(spark, sf_dir, "benchmark"), "text", "item_id")
    tr = _nearest_other(spark, sf_dir, toks.select(F.col("term").alias("word")).distinct(), 1).select(
        F.col("query_id").alias("term"), F.col("word").alias("dst"), F.col("similarity").alias("sim"))
    j = toks.join(tr, "term", "left")
    return j.groupBy(F.col("doc_id").alias("query_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("dst", "term").alias("w")))),
                                 lambda s: s["w"]), " ").alias("translation"),
        r6(F.avg("sim")).alias("score"))


@register("expand_synonyms", f"""WITH {SQL_BENCH_TERMS}, {SQL_WV},
qw AS (SELECT DISTINCT term AS word FROM qt),
nn AS (SELECT q.word AS src, w2.word AS dst, list_cosine_similarity(w1.vector, w2.vector) AS sim
       FROM qw q JOIN wv w1 ON w1.word = q.word JOIN wv w2 ON w2.word <> q.word),
syn AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS r FROM nn)
        WHERE r <= 2 AND sim >= 0.3),
tk AS (SELECT item_id AS query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos
       FROM (SELECT item_id, {sql_std_tokens('text')} AS t FROM benchmark))
SELECT query_id, pos::BIGINT AS pos, term, 'word' AS type FROM tk
UNION ALL SELECT query_id, pos::BIGINT AS pos, syn.dst AS term, 'SYNONYM' AS type FROM tk JOIN syn ON syn.src = tk.term""")
def expand_synonyms(spark, sf_dir):
    """Every token followed by up to 2 similar words (cosine >= 0.3) at the
    same position, typed SYNONYM."""
    toks = tokenize(tbl(spark, sf_dir, "benchmark"), "text", "item_id").withColumnRenamed("doc_id", "query_id")
    syn = _nearest_other(spark, sf_dir, toks.select(F.col("term").alias("word")).distinct(), 2).filter(
        F.col("similarity") >= 0.3).select(F.col("query_id").alias("term"), F.col("word").alias("syn"))
    orig = toks.select("query_id", F.col("pos").cast("long"), "term", F.lit("word").alias("type"))
    syns = toks.join(syn, "term").select("query_id", F.col("pos").cast("long"), F.col("syn").alias("term"),
                                         F.lit("SYNONYM").alias("type"))
    return orig.unionByName(syns)


@register("similar_strings", f"""WITH {SQL_BENCH_TERMS}, {SQL_WV},
bg AS (SELECT word, bigram, count(*) AS c FROM (SELECT word, substr(word, i, 2) AS bigram
       FROM (SELECT word, unnest(range(1, length(word))) AS i FROM wv)) GROUP BY word, bigram),
qw AS (SELECT DISTINCT term AS word FROM qt),
qb AS (SELECT word, bigram, count(*) AS c FROM (SELECT word, substr(word, i, 2) AS bigram
       FROM (SELECT word, unnest(range(1, length(word))) AS i FROM qw)) GROUP BY word, bigram),
bn AS (SELECT word, sqrt(sum(c * c)) AS n FROM bg GROUP BY word),
qn AS (SELECT word, sqrt(sum(c * c)) AS n FROM qb GROUP BY word),
s AS (SELECT qb.word AS query_word, bg.word AS similar_word, sum(qb.c * bg.c) AS dot
      FROM qb JOIN bg USING (bigram) WHERE bg.word <> qb.word GROUP BY qb.word, bg.word),
c AS (SELECT query_word, similar_word, dot / (qn.n * bn.n) AS similarity FROM s JOIN qn ON qn.word = s.query_word JOIN bn ON bn.word = s.similar_word),
r AS (SELECT *, row_number() OVER (PARTITION BY query_word ORDER BY round(similarity, 9) DESC, similar_word) AS rank
      FROM c WHERE similarity >= 0.5)
SELECT query_word, similar_word, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def similar_strings(spark, sf_dir):
    """Vocabulary words whose character-bigram cosine with a benchmark
    word is >= 0.5 (top-5). Bigram 'postings' of the vocabulary are joined with
    the (broadcast) query bigrams, like a text search over characters."""
    from quarry.operators.lexicon import similar_by_bigrams

    wv = word_vectors(spark, sf_dir).select("word")
    q = bench_terms(spark, sf_dir).select(F.col("term").alias("word")).distinct()
    r = similar_by_bigrams(q, wv, threshold=0.5, k=5)
    return r.select("query_word", F.col("similar").alias("similar_word"), r6("similarity").alias("similarity"), F.col("rank").cast("long"))


@register("pca_reduce")
def pca_reduce(spark, sf_dir):
    """Standardised embeddings projected on 8 principal components (long form)."""
    out, _ = V.pca_fit_transform(tbl(spark, sf_dir, "embeddings"), "embedding", 8)
    return _long(out, "vec_id", "pca")


@register("ppa_postprocess")
def ppa_postprocess(spark, sf_dir):
    """Mean removed and the top-2 principal directions projected out."""
    out, _ = V.remove_top_components(tbl(spark, sf_dir, "embeddings"), "embedding", 2)
    return _long(out, "vec_id", "post")


@register("kmeans_codebook")
def kmeans_codebook(spark, sf_dir):
    """K-means (k=8, 15 iterations) over the 8-dim local features of every embedding."""
    feats = _local_features(spark, sf_dir)
    assigned, _ = V.kmeans_codebook(feats, "feature", k=8, max_iter=15)
    return assigned.select("vec_id", F.col("chunk").cast("long"), F.col("cluster").cast("long"))


def _local_features(spark, sf_dir):
    e = tbl(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.struct(
        j.alias("chunk"), F.slice("embedding", j * 8 + 1, 8).alias("feature")))).alias("f")).select(
        "vec_id", "f.chunk", VX.to_double("f.feature").alias("feature"))


@register("bovw_histogram", """
WITH ex AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT vec_id, i // 8 AS chunk, i % 8 AS p, v FROM ex),
cb AS (SELECT chunk AS cluster, p, avg(v) AS c FROM f GROUP BY chunk, p),
d AS (SELECT f.vec_id, f.chunk, cb.cluster, sum((f.v - cb.c) * (f.v - cb.c)) AS d2 FROM f JOIN cb USING (p)
      GROUP BY f.vec_id, f.chunk, cb.cluster),
a AS (SELECT vec_id, chunk, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, chunk ORDER BY d2, cluster) AS r FROM d) WHERE r = 1)
SELECT vec_id, cluster::BIGINT AS cluster, count(*)::BIGINT AS n FROM a GROUP BY vec_id, cluster""")
def bovw_histogram(spark, sf_dir):
    """Each embedding's 8 local features assigned to a fixed 8-word
    codebook (the mean local feature of each chunk position); visual-word
    counts per embedding."""
    feats = _local_features(spark, sf_dir)
    cb = vector_sum(feats, ["chunk"], "feature", mean=True, out="c").orderBy("chunk").collect()  # 8 rows
    centers = np.array([r["c"] for r in cb])
    a = V.nearest_centroid(feats, "feature", centers)
    return a.groupBy("vec_id", F.col("cluster").cast("long").alias("cluster")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


@register("color_histogram", """
WITH px AS (SELECT vec_id, p, embedding[3 * p + 1]::DOUBLE AS r, embedding[3 * p + 2]::DOUBLE AS g, embedding[3 * p + 3]::DOUBLE AS b
            FROM (SELECT vec_id, embedding, unnest(range(0, 21)) AS p FROM embeddings)),
q AS (SELECT vec_id, least(3, greatest(0, floor((r + 0.3) / 0.15)))::BIGINT * 16
                   + least(3, greatest(0, floor((g + 0.3) / 0.15)))::BIGINT * 4
                   + least(3, greatest(0, floor((b + 0.3) / 0.15)))::BIGINT AS bin FROM px)
SELECT vec_id, bin, round(count(*) / 21.0, 6) AS freq FROM q GROUP BY vec_id, bin""")
def color_histogram(spark, sf_dir):
    """21 (r, g, b) 'pixels' per embedding (consecutive dims), each channel
    quantised to 4 levels, 64-bin normalised histogram (non-empty bins)."""
    e = tbl(spark, sf_dir, "embeddings")

    def level(x):
        return F.least(F.lit(3), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.3) / 0.15))).cast("long")
    px = e.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: (
        level(F.element_at("embedding", p * 3 + 1)) * 16 + level(F.element_at("embedding", p * 3 + 2)) * 4
        + level(F.element_at("embedding", p * 3 + 3))))).alias("bin"))
    return px.groupBy("vec_id", "bin").agg(r6(F.count(F.lit(1)) / 21.0).alias("freq"))


@register("word2vec_fit")
def word2vec_fit(spark, sf_dir):
    """V1: skip-gram word2vec over every document's standard tokens
    (32 dims, window 5, min count 5, one pass); (word, norm) per vocabulary word."""
    d = tbl(spark, sf_dir, "documents").select(TX.standard_tokens(F.col("text")).alias("tokens"))
    wv, _ = docvec.train_word2vec(d, vector_size=32, min_count=5, max_iter=1)
    return wv.select("word", VX.norm("vector").alias("norm"))


def _doc_vectors(spark, sf_dir, docs_tokens, count_col=None):
    wv = word_vectors(spark, sf_dir)
    counts = doc_index(spark, sf_dir).term_stats.select(F.col("term").alias("word"), F.col("cf").alias("freq"))
    return docvec.infer_doc_vectors(docs_tokens, wv, counts, dim=64, epochs=10, count_col=count_col)


@register("doc_vectors")
def doc_vectors(spark, sf_dir):
    """V4: paragraph vectors inferred for every document against the frozen word vectors."""
    v = _doc_vectors(spark, sf_dir, doc_index(spark, sf_dir).postings.select("doc_id", "term", "tf"), "tf")
    return v.select("doc_id", VX.norm("vector").alias("norm"), F.size("vector").cast("long").alias("dim"))


@register("rank_doc_embeddings")
def rank_doc_embeddings(spark, sf_dir):
    """Every document that matches a benchmark passage, scored by the cosine of the inferred passage vector
    and the document's inferred vector; top 10."""
    idx = doc_index(spark, sf_dir)
    hits = S.score(idx, bench_terms(spark, sf_dir), "bm25").select("query_id", "doc_id")
    dtoks = idx.postings.select("doc_id", "term", "tf")
    qtoks = tokenize(tbl(spark, sf_dir, "benchmark"), "text", "item_id").select("doc_id", "term")
    dv = _doc_vectors(spark, sf_dir, dtoks, "tf").withColumnRenamed("vector", "dvec")
    qv = _doc_vectors(spark, sf_dir, qtoks).select(F.col("doc_id").alias("query_id"), F.col("vector").alias("qvec"))
    s = hits.join(dv, "doc_id").join(checked_broadcast(qv), "query_id").select(
        "query_id", "doc_id", VX.cosine("qvec", "dvec").alias("score"))
    r = top_k(s, 10)
    return r.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"))
