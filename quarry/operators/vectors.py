"""word/document vectors, exact nearest neighbours, rerank, projection,
PCA, post-processing, k-means, bag-of-visual-words and histograms.

Vector arithmetic is expressed with array higher-order functions or MLlib
aggregates. Exact kNN is a block nested loop: the (size-checked) query block
is broadcast to every task, each task scores its slice of the corpus with numpy
and keeps one running top-k per query over all its batches, and a final ``row_number() <= k`` window
(partial limit before the shuffle) picks the global best. The corpus is never
shuffled, collected or broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quarry.functions import vectors as VX
from quarry.operators.search import SCORE_DIGITS, top_k
from quarry.operators.vectors_agg import vector_sum, word_cosine_sum, word_vector_sum
from quarry.session import checked_broadcast

QUERY_BLOCK_BYTES = 32 << 20  # query vectors broadcast per pass of the corpus
_SCORE_BYTES = 32 << 20  # scores of one batch against a slice of the queries
_PAIRS = 1 << 18  # rows scored again at once


# ---- word and document vectors ---------------------------------------------
def average_vectors(tokens: DataFrame, word_vectors: DataFrame, unk=None, distinct: bool = False,
                    id_col: str = "doc_id", out: str = "vector", count_col: str | None = None) -> DataFrame:
    """Mean of the word vectors of each document's tokens.

    ``tokens(doc_id, term)`` (one row per occurrence, or per term with its occurrences in ``count_col``). With
    ``distinct`` the mean is over distinct known terms and OOV terms are skipped (V3b).
    Otherwise every occurrence counts and an OOV token contributes ``unk``
    (a list; zeros when None) (V3).
    """
    count = F.lit(1) if count_col is None else F.col(count_col)
    t = tokens.select(id_col, "term", count.alias("_c"))
    if distinct:
        return word_vector_sum(t, word_vectors, [id_col], distinct=True, mean=True, out=out)
    if unk is None:
        # zero vector: only the count of OOV tokens matters
        n = t.groupBy(id_col).agg(F.sum("_c").alias("_n"))
        s = word_vector_sum(t, word_vectors, [id_col], F.col("_c"), out="_s")
        return n.join(s, id_col, "left").select(id_col, F.when(F.col("_s").isNotNull(), VX.scale(
            "_s", F.lit(1.0) / F.col("_n"))).alias(out))
    j = t.join(word_vectors.select(F.col("word").alias("term"), "vector"), "term", "left")
    d = F.array(*[F.lit(float(x)) for x in unk])
    j = j.withColumn("vector", F.coalesce(VX.to_double("vector"), d))
    return vector_sum(j, [id_col], "vector", weight="_c", mean=True, out=out)


def weighted_vector_sum(postings: DataFrame, term_stats: DataFrame, n_docs: float,
                        word_vectors: DataFrame, out: str = "vector") -> DataFrame:
    """Σ wv(t) / tfidf(t, d) over a document's distinct known terms
    (the weight divides, as in the behaviour being reproduced)."""
    from quarry.functions.similarity import tfidf_weight

    # only words with a vector matter, so the statistics' side is as small as the word vectors
    stats = checked_broadcast(term_stats.select("term", "df").join(
        word_vectors.select(F.col("word").alias("term")).distinct(), "term", "left_semi"))
    j = postings.select("doc_id", "term", "tf", F.lit(float(n_docs)).alias("n_docs")).join(stats, "term")
    return word_vector_sum(j, word_vectors, ["doc_id"], F.lit(1.0) / tfidf_weight("tf", "df", "n_docs"), out=out)


def smoothing_weight(smoothing: str = "mean", n_docs=None):
    """What multiplies a word's vector in its document's vector (R10): 1/s(t) with s = distinct-term count (mean), tf,
    1 (idf from a one-document term vector) or 1 + ln(tf) ln(N) (tf_idf)."""
    if smoothing == "mean":
        return F.lit(1.0)  # a common positive divisor cancels in the cosine
    if smoothing == "tf":
        return F.lit(1.0) / F.col("tf")
    if smoothing == "idf":
        return F.lit(1.0)
    if smoothing == "tf_idf":
        n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
        return F.lit(1.0) / (F.lit(1.0) + F.log(F.col("tf").cast("double")) * F.log(n))
    raise ValueError(f"unknown smoothing {smoothing!r}")


def doc_vectors_smoothed(postings: DataFrame, word_vectors: DataFrame, smoothing: str = "mean",
                         n_docs=None) -> DataFrame:
    """Document side of R10: Σ wv(t)/s(t) over the document's distinct terms (see :func:`smoothing_weight`)."""
    return word_vector_sum(postings.select("doc_id", "term", "tf"), word_vectors, ["doc_id"],
                           smoothing_weight(smoothing, n_docs), out="dvec")


def rank_word_embeddings(postings: DataFrame, qterms: DataFrame, word_vectors: DataFrame,
                         smoothing: str = "mean", n_docs=None, k: int = 10) -> DataFrame:
    """The top ``k`` per query of :func:`score_word_embeddings`."""
    return top_k(score_word_embeddings(postings, qterms, word_vectors, smoothing, n_docs, k), k)


def score_word_embeddings(postings: DataFrame, qterms: DataFrame, word_vectors: DataFrame,
                          smoothing: str = "mean", n_docs=None, best: int | None = None) -> DataFrame:
    """score = Σ over matching query terms with a vector of
    cos(wv(term), document vector), as ``(query_id, doc_id, score)``.

    The document vectors are summed and compared where the postings of the document lie, so neither they nor the
    word vectors are shuffled; one number per query and document is
    (:func:`quarry.operators.vectors_agg.word_cosine_sum`). With ``best``, rows that cannot be among the ``best`` of
    their query may be left out.
    """
    return word_cosine_sum(postings.select("doc_id", "term", "tf"), qterms.select("query_id", "term").distinct(),
                           word_vectors, ["doc_id"], smoothing_weight(smoothing, n_docs), best)


# ---- exact nearest neighbours ----------------------------------------------
def _best_per_query(q, ids, val, k):
    """First ``k`` rows of each query by (value, id); values are compared after rounding, as the final rank is."""
    order = np.argsort(ids, kind="stable")
    order = order[np.lexsort((np.round(val[order], SCORE_DIGITS), q[order]))]
    q, ids, val = q[order], ids[order], val[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate((start, [len(q)]))))
    keep = rank < k
    return q[keep], ids[keep], val[keep]


def _knn_partition_fn(qids, Q, k, metric, id_col, vec_col):
    """One running top-k per query over all batches of a partition, yielded once.

    A batch is scored with one matrix product per slice of queries. Every row whose product lies within the product's
    rounding error of a query's k-th is scored again from the vectors themselves, so ties are kept for the id to decide.
    """
    Q = np.asarray(Q, dtype=np.float64)
    if metric == "cosine":
        Q = _unit_rows(Q)
    q2 = (Q * Q).sum(axis=1)

    def fn(batches):
        best = (np.zeros(0, np.int64), None, np.zeros(0))
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            if metric == "cosine":
                X = _unit_rows(X)
            ids, x2, kk = pdf[id_col].to_numpy(), (X * X).sum(axis=1), min(k, len(pdf))
            step = max(1, _SCORE_BYTES // (8 * len(X)))
            for at in range(0, len(Q), step):
                S = x2[:, None] + q2[None, at:at + step] - 2.0 * (X @ Q[at:at + step].T)
                kth = np.partition(S, kk - 1, axis=0)[kk - 1]
                slack = 1e-9 * (x2.max() + q2[at:at + step] + 1.0)
                rows_x, rows_q = np.nonzero(S <= kth + slack)
                rows_q = rows_q + at
                for part in range(0, len(rows_x), _PAIRS):
                    x, q = rows_x[part:part + _PAIRS], rows_q[part:part + _PAIRS]
                    if metric == "cosine":
                        val = -(X[x] * Q[q]).sum(axis=1)
                    else:
                        val = np.sqrt(((X[x] - Q[q]) ** 2).sum(axis=1))
                    old = best if best[1] is not None else (best[0], ids[:0], best[2])
                    best = _best_per_query(np.concatenate((old[0], q)), np.concatenate((old[1], ids[x])),
                                           np.concatenate((old[2], val)), k)
        if best[1] is not None:
            yield pd.DataFrame({"query_id": np.asarray(qids)[best[0]], "id": best[1],
                                "value": -best[2] if metric == "cosine" else best[2]})
    return fn


def _unit_rows(a: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def knn(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "euclidean",
        id_col: str = "vec_id", vec_col: str = "embedding", qid_col: str = "query_id",
        qvec_col: str = "qvec", block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """V6 (euclidean) / V5 (cosine): exact k nearest corpus rows per query, ties to the smaller id.

    Output ``(query_id, <id_col>, distance|similarity, rank)``. Queries are processed in broadcast blocks of at most
    about ``block_bytes`` of vectors; more queries make more passes, never a bigger broadcast.
    """
    spark = corpus.sparkSession
    qsel = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("qvec"))
    size = qsel.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qvec")).alias("d")).first()
    n_blocks = max(1, -(-size["n"] * 8 * (size["d"] or 0) // block_bytes))
    parts = []
    qid_type = dict(qsel.dtypes)["query_id"]
    id_type = dict(corpus.dtypes)[id_col]
    for b in range(n_blocks):
        qb = qsel if n_blocks == 1 else qsel.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        rows = qb.collect()  # bounded: about block_bytes of query vectors
        if not rows:
            continue
        qids = [r[0] for r in rows]
        Q = np.array([np.asarray(r[1], dtype=np.float64) for r in rows])
        fn = _knn_partition_fn(qids, Q, k, metric, id_col, vec_col)
        parts.append(corpus.select(id_col, vec_col).mapInPandas(
            fn, f"query_id {qid_type}, id {id_type}, value double"))
    if not parts:
        name = "similarity" if metric == "cosine" else "distance"
        return spark.createDataFrame([], f"query_id {qid_type}, {id_col} {id_type}, {name} double, rank int")
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    if metric == "cosine":
        best = top_k(cand, k, score_col="value", id_col="id")
        name = "similarity"
    else:
        best = top_k(cand.withColumn("neg", -F.col("value")), k, score_col="neg", id_col="id").drop("neg")
        name = "distance"
    return best.select("query_id", F.col("id").alias(id_col), F.col("value").alias(name), "rank")


def knn_rerank(hits: DataFrame, vectors: DataFrame, query_vectors: DataFrame, fields,
               threshold: float = float("inf"), k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """V7: rerank candidate hits by distances over one or more vector fields.

    ``hits(query_id, id, score)``; ``vectors(id, <field>...)``;
    ``query_vectors(query_id, <field>...)``. Each distance gets +1e-10; a hit
    is dropped when any distance exceeds the threshold or is not finite; the
    score grows by Σ 1/distance; best k kept.
    """
    qv = checked_broadcast(query_vectors.select("query_id", *[F.col(f).alias(f"q_{f}") for f in fields]))
    j = hits.join(vectors.select(id_col, *fields), id_col).join(qv, "query_id")
    dists = [VX.euclidean(f, f"q_{f}") + F.lit(1e-10) for f in fields]
    j = j.select("query_id", id_col, "score", *[d.alias(f"d{i}") for i, d in enumerate(dists)])
    ok = F.lit(True)
    for i in range(len(fields)):
        d = F.col(f"d{i}")
        ok = ok & d.isNotNull() & ~F.isnan(d) & (d <= F.lit(threshold)) & (d != F.lit(float("inf")))
    bonus = sum((F.lit(1.0) / F.col(f"d{i}") for i in range(len(fields))), F.lit(0.0))
    scored = j.filter(ok).select("query_id", id_col, (F.col("score") + bonus).alias("score"))
    return top_k(scored, k, id_col=id_col)


# ---- projection, PCA, post-processing, clustering ---------------------------
def gram_sums(pairs: DataFrame, src_col: str = "src", tgt_col: str = "tgt") -> tuple[np.ndarray, np.ndarray]:
    """V9 helper: ``SᵀS`` and ``SᵀT`` as partial sums per partition, summed by
    Spark; only two ``d×d`` matrices reach the driver."""
    def part(batches):
        sts = stt = None
        for pdf in batches:
            if pdf.empty:
                continue
            S = np.stack(pdf[src_col].to_numpy()).astype(np.float64)
            T = np.stack(pdf[tgt_col].to_numpy()).astype(np.float64)
            a, b = S.T @ S, S.T @ T
            sts = a if sts is None else sts + a
            stt = b if stt is None else stt + b
        if sts is not None:
            yield pd.DataFrame({"sts": [sts.ravel()], "stt": [stt.ravel()],
                                "d": [S.shape[1]], "e": [T.shape[1]]})
    parts = pairs.select(src_col, tgt_col).mapInPandas(
        part, "sts array<double>, stt array<double>, d int, e int")
    d_e = parts.select("d", "e").first()
    if d_e is None:
        raise ValueError("no dictionary pairs with vectors on both sides")
    d, e = d_e
    from quarry.operators.vectors_agg import vector_sum as vs
    sums = vs(parts.withColumn("_k", F.lit(0)), ["_k"], "sts", out="sts").join(
        vs(parts.withColumn("_k", F.lit(0)), ["_k"], "stt", out="stt"), "_k").first()
    return np.array(sums["sts"]).reshape(d, d), np.array(sums["stt"]).reshape(d, e)


def translation_matrix(pairs: DataFrame, src_col: str = "src", tgt_col: str = "tgt") -> np.ndarray:
    """V9: least squares W with S·W ≈ T, i.e. ``pinv(SᵀS)·SᵀT`` (= pinv(S)·T)."""
    sts, stt = gram_sums(pairs, src_col, tgt_col)
    return np.linalg.pinv(sts) @ stt


def translation_matrices(pairs: DataFrame, keys: list[str], src_col: str = "src", tgt_col: str = "tgt",
                         diagonal: bool = False) -> DataFrame:
    """V9 for many language pairs at once: ``(keys..., matrix array<double>, d, e)``, row by row, one pass over all.

    Every partition emits one Gram sum per key it holds; the sums are added by key and each solved in a task, so neither
    pairs nor matrices pass the driver. With ``diagonal`` each dimension is scaled alone, by ``Σ s t / Σ s s``.
    """
    def part(batches):
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False):
                S, T = (np.stack(g[c].to_numpy()).astype(np.float64) for c in (src_col, tgt_col))
                if diagonal:
                    sums = [(S * S).sum(axis=0), (S * T).sum(axis=0)]
                else:
                    sums = [(S.T @ S).ravel(), (S.T @ T).ravel()]
                old = held.get(key)
                held[key] = [S.shape[1], T.shape[1], *(sums if old is None else [a + b for a, b in zip(old[2:], sums, strict=True)])]
        if held:
            yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=[*keys, "d", "e", "sts", "stt"])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                sts, stt = np.array(r.sts), np.array(r.stt)
                if diagonal:
                    m = np.diag(np.divide(stt, sts, out=np.zeros_like(stt), where=sts != 0))
                else:
                    m = np.linalg.pinv(sts.reshape(r.d, r.d)) @ stt.reshape(r.d, r.e)
                out.append(m.ravel().tolist())
            yield pdf[[*keys, "d", "e"]].assign(matrix=out)[[*keys, "matrix", "d", "e"]]

    kind = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    parts = pairs.select(*keys, src_col, tgt_col).mapInPandas(part, f"{kind}, d int, e int, sts array<double>, stt array<double>")
    both = vector_sum(parts, [*keys, "d", "e"], "sts", out="sts").join(
        vector_sum(parts, [*keys, "d", "e"], "stt", out="stt"), [*keys, "d", "e"])
    return both.mapInPandas(solve, f"{kind}, matrix array<double>, d int, e int")


def project_by(df: DataFrame, vec_col: str, matrices: DataFrame, keys: list[str], out: str = "projected") -> DataFrame:
    """``df`` with its vector mapped by the matrix of its key; rows without a matrix are left out."""
    j = df.join(checked_broadcast(matrices), keys)
    cell = F.transform(F.sequence(F.lit(0), F.col("e") - 1), lambda c: F.aggregate(
        F.zip_with(F.col(vec_col), F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda r: F.get("matrix", r * F.col("e") + c)),
                   lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y))
    return j.withColumn(out, cell).drop("matrix", "d", "e")


def project(df: DataFrame, vec_col: str, W: np.ndarray, out: str = "projected") -> DataFrame:
    """Multiply each vector by the matrix ``W`` (d×e), one matrix product per Arrow batch; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(W, dtype=np.float64))

    @F.pandas_udf(ArrayType(DoubleType()))
    def times(v: pd.Series) -> pd.Series:
        res = pd.Series([None] * len(v), dtype=object)
        ok = v.notna().to_numpy()
        if ok.any():
            got = np.stack(v[ok].to_list()).astype(np.float64) @ shared.value
            res[ok] = pd.Series(list(got), index=res.index[ok])
        return res

    return df.withColumn(out, times(vec_col))


def pca_fit_transform(df: DataFrame, vec_col: str, k: int, out: str = "pca"):
    """Standardise (mean and unit variance) and project on the top-k principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(VX.to_double(vec_col)))
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(v)
    s = scaler.transform(v)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(s)
    return model.transform(s).withColumn(out, vector_to_array("_p")).drop("_v", "_s", "_p"), model


def remove_top_components(df: DataFrame, vec_col: str, d: int, out: str = "post"):
    """V13: "all-but-the-top" post-processing: subtract the per-dimension mean,
    then remove the projections on the top-d principal directions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    mean = vector_sum(df.withColumn("_k", F.lit(0)), ["_k"], vec_col, mean=True, out="mu").first()["mu"]
    mu = F.array(*[F.lit(float(x)) for x in mean])
    c = df.withColumn("_c", F.zip_with(VX.to_double(vec_col), mu, lambda x, m: x - m))
    model = PCA(k=d, inputCol="_cv", outputCol="_p").fit(c.withColumn("_cv", array_to_vector("_c")))
    U = model.pc.toArray()  # dims × d, bounded
    # remove projections one direction at a time (U columns are orthonormal)
    for j in range(U.shape[1]):
        u = F.array(*[F.lit(float(x)) for x in U[:, j]])
        c = c.withColumn("_p", VX.dot("_c", u)).withColumn(
            "_c", F.zip_with("_c", u, lambda x, y: x - F.col("_p") * y))
    return c.withColumnRenamed("_c", out).drop("_p"), U


def kmeans_codebook(df: DataFrame, vec_col: str, k: int = 8, max_iter: int = 15, seed: int = 42):
    """MLlib k-means; returns (assignments frame, centres array)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("_v", array_to_vector(VX.to_double(vec_col)))
    model = KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("_v"), np.array([c for c in model.clusterCenters()])


def nearest_centroid(df: DataFrame, vec_col: str, centers, out: str = "cluster") -> DataFrame:
    """Assign each vector to its closest centre (ties: lowest index). The
    codebook is a small driver-side matrix inlined as a literal."""
    cb = F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(float(v)) for v in c]).alias("centroid"))
                   for i, c in enumerate(np.asarray(centers))])
    best = F.aggregate(
        cb, F.struct(F.lit(-1).alias("c"), F.lit(float("inf")).alias("d")),
        lambda acc, e: F.when(VX.sq_euclidean(vec_col, e["centroid"]) < acc["d"],
                              F.struct(e["cluster"].alias("c"), VX.sq_euclidean(vec_col, e["centroid"]).alias("d")))
        .otherwise(acc))
    return df.withColumn(out, best["c"])


def histogram(df: DataFrame, keys, bin_col: str, n_bins: int, normalise: bool = True,
              out: str = "histogram") -> DataFrame:
    """Per key, counts of each bin 0..n_bins-1 as a dense array."""
    keys = list(keys)
    c = df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias("_n"))
    m = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(bin_col, "_n"))).alias("_m"),
                             F.sum("_n").alias("_t"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)),
                        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)).cast("double"))
    if normalise:
        dense = F.transform(dense, lambda x: x / F.col("_t"))
    return m.select(*keys, dense.alias(out))
