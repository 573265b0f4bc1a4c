"""Q1–Q12: boolean, phrase and ranked retrieval over an :class:`Index`.

Queries are tables. ``query_terms(query_id, term, qtf)`` is joined to
``term_stats`` (query side broadcast, vocabulary streamed) and the result,
never larger than the query-term table, is broadcast against the postings, so
the postings are streamed once with no shuffle. Scores are summed by
``(query_id, doc_id)`` — a key that spreads evenly however hot a term is — and
top-k uses ``row_number() <= k`` directly over the window so Spark plans a
partial ``WindowGroupLimit`` before the shuffle by ``query_id``.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import similarity as similarity_expr
from quarry.operators.index import Index
from quarry.session import checked_broadcast, cut_lineage

SCORE_DIGITS = 9  # scores are ranked after rounding so ties do not depend on summation order


def term_matches(index: Index, qterms: DataFrame, extra_cols=()) -> DataFrame:
    """Postings of the query terms with all statistics attached.

    Output: query_id, doc_id, term, qtf, tf, dl, df, cf, n_docs, sum_ttf, avgdl (+extra).
    """
    qt = checked_broadcast(qterms)
    qs = index.with_stats(qt.join(index.term_stats, "term"))  # rows <= query terms: unique term key
    if qt is not qterms:  # the query side passed the size check, so does qs
        qs = F.broadcast(qs)
    cols = ["doc_id", "term", "tf", "dl", *extra_cols]
    return index.postings.select(*cols).join(qs, "term")


def score(index: Index, qterms: DataFrame, similarity: str = "bm25", **params) -> DataFrame:
    """Sum of per-term contributions by (query_id, doc_id) → ``score``."""
    m = term_matches(index, qterms)
    contrib = F.col("qtf") * similarity_expr(similarity, **params)
    return m.groupBy("query_id", "doc_id").agg(F.sum(contrib).alias("score"),
                                               F.count(F.lit(1)).alias("matched"))


def top_k(scored: DataFrame, k: int, score_col: str = "score", group_col: str = "query_id",
          id_col: str = "doc_id", rank_col: str = "rank") -> DataFrame:
    """Q10: best ``k`` per group, ties broken by id, rank 1-based."""
    groups = [group_col] if isinstance(group_col, str) else list(group_col)
    w = Window.partitionBy(*groups).orderBy(F.col("_s").desc(), F.col(id_col).asc())
    return (scored.withColumn("_s", F.round(F.col(score_col), SCORE_DIGITS))
            .withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k).drop("_s"))


def hit_summary(scored: DataFrame, score_col: str = "score", group_col: str = "query_id") -> DataFrame:
    """Total hits and max score per query (partial aggregation, no window)."""
    return scored.groupBy(group_col).agg(F.count(F.lit(1)).alias("total_hits"),
                                         F.max(score_col).alias("max_score"))


def rank(index: Index, qterms: DataFrame, similarity: str = "bm25", k: int = 10, **params) -> DataFrame:
    """Ranked hits ``(query_id, doc_id, score, rank)``."""
    return top_k(score(index, qterms, similarity, **params), k).select("query_id", "doc_id", "score", "rank")


def clause_terms(queries: DataFrame, clause_col: str, analyzer=None, id_col: str = "query_id") -> DataFrame:
    """Explode an ``array<string>`` clause column into distinct ``(query_id, term)``."""
    return (queries.select(F.col(id_col).alias("query_id"), F.explode(clause_col).alias("term"))
            .dropDuplicates(["query_id", "term"]))


def boolean_search(index: Index, must: DataFrame | None = None, should: DataFrame | None = None,
                   must_not: DataFrame | None = None, min_should_match=None,
                   similarity: str = "bm25", **params) -> DataFrame:
    """Q1–Q3, Q6: boolean retrieval with scores.

    Clause frames are ``(query_id, term)`` (distinct). A document matches when
    it holds every MUST term, none of the MUST_NOT terms and — when there is no
    MUST clause, or a minimum is set — at least ``min_should_match`` SHOULD
    terms (an int or a ``(query_id, msm)`` frame). The score sums the
    similarity over matching MUST and SHOULD terms.
    """
    parts = []
    if must is not None:
        parts.append(must.select("query_id", "term", F.lit(1).alias("is_must")))
    if should is not None:
        parts.append(should.select("query_id", "term", F.lit(0).alias("is_must")))
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    terms = terms.groupBy("query_id", "term").agg(F.max("is_must").alias("is_must"),
                                                  F.lit(1).alias("qtf"))
    m = term_matches(index, terms, )
    contrib = similarity_expr(similarity, **params)
    hits = m.groupBy("query_id", "doc_id").agg(
        F.sum(contrib).alias("score"),
        F.sum("is_must").alias("n_must_hit"),
        F.sum(1 - F.col("is_must")).alias("n_should_hit"))
    need = terms.groupBy("query_id").agg(F.sum("is_must").alias("n_must"),
                                         F.sum(1 - F.col("is_must")).alias("n_should"))
    hits = hits.join(checked_broadcast(need), "query_id")
    cond = F.col("n_must_hit") == F.col("n_must")
    if min_should_match is None:
        cond = cond & ((F.col("n_must") > 0) | (F.col("n_should_hit") >= 1))
    elif isinstance(min_should_match, DataFrame):
        hits = hits.join(checked_broadcast(min_should_match), "query_id")
        cond = cond & (F.col("n_should_hit") >= F.col("msm"))
    else:
        cond = cond & (F.col("n_should_hit") >= F.lit(int(min_should_match)))
    hits = hits.filter(cond)
    if must_not is not None:
        excluded = (index.postings.select("doc_id", "term")
                    .join(checked_broadcast(must_not.select("query_id", "term")), "term")
                    .select("query_id", "doc_id"))
        hits = hits.join(excluded, ["query_id", "doc_id"], "left_anti")
    return hits.select("query_id", "doc_id", "score")


def min_should_match_from_similarity(should: DataFrame, sim: float) -> DataFrame:
    """Q6: ``msm = ceil(n_should * sim)`` per query."""
    return should.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) * F.lit(float(sim))).cast("long").alias("msm"))


def phrase_search(index: Index, phrases: DataFrame) -> DataFrame:
    """Q4: exact phrase matches ``(query_id, doc_id, freq)``.

    ``phrases(query_id, offset, term)`` gives the phrase tokens. Candidates are
    first narrowed to documents holding the phrase's rarest term (one posting
    list per query), then only the candidates' positions are exploded; a start
    position matches when every offset lines up.
    """
    plen = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("plen"))
    ph = checked_broadcast(phrases.join(index.term_stats.select("term", "df"), "term"))
    w = Window.partitionBy("query_id").orderBy(F.col("df").asc(), F.col("term").asc())
    rarest = ph.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("query_id", "term")
    cand = (index.postings.select("doc_id", "term").join(checked_broadcast(rarest), "term")
            .select("query_id", "doc_id"))
    cand = checked_broadcast(cand)
    post = index.postings.select("doc_id", "term", "positions").join(
        ph.select("query_id", "offset", "term"), "term").join(cand, ["query_id", "doc_id"], "left_semi")
    starts = (post.select("query_id", "doc_id", "offset", F.explode("positions").alias("pos"))
              .withColumn("start", F.col("pos") - F.col("offset"))
              .groupBy("query_id", "doc_id", "start").agg(F.countDistinct("offset").alias("n"))
              .join(checked_broadcast(plen), "query_id").filter(F.col("n") == F.col("plen")))
    return starts.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("freq"))


def explain(index: Index, qterms: DataFrame, hits: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Q11: per-term BM25 explanation rows for given hits ``(query_id, doc_id)``.

    The hits are computed once, and only postings of their documents meet the query terms.
    """
    hits = cut_lineage(hits.select("query_id", "doc_id"))
    near = index.postings.join(checked_broadcast(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    m = term_matches(replace(index, postings=near), qterms).join(checked_broadcast(hits), ["query_id", "doc_id"], "left_semi")
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    tfn = F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)
    return m.select("query_id", "doc_id", "term", "tf", "df", "dl", idf.alias("idf"),
                    tfn.alias("tf_norm"), (F.col("qtf") * idf * tfn).alias("contribution"))


def fetch(hits: DataFrame, docs: DataFrame, cols, id_col: str = "doc_id") -> DataFrame:
    """Q12: late materialisation of stored fields, for the hits alone.

    The join carries no hint: Spark broadcasts few hits, and for many it shuffles them and may send their ids as a
    runtime Bloom filter into the scan of ``docs`` before that side is shuffled. Fields stored by
    :func:`store_fields` are bucketed by document and need no shuffle at all.
    """
    return docs.select(F.col(id_col).alias("doc_id"), *cols).join(hits, "doc_id")


FIELDS_PER_BUCKET = 2_000_000


def store_fields(docs: DataFrame, table: str, path: str, id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Writes stored fields as an external table bucketed and sorted by document, and returns it.

    Buckets follow the number of rows unless given.
    """
    n = buckets or max(1, -(-docs.count() // FIELDS_PER_BUCKET))
    (docs.repartition(n, id_col).write.bucketBy(n, id_col).sortBy(id_col).mode("overwrite").option("path", path)
     .saveAsTable(table))
    return docs.sparkSession.table(table)


def clause_search(index: Index, clauses: DataFrame, similarity: str = "bm25", **params) -> DataFrame:
    """Q7–Q9: boolean query of *sub-queries*. ``clauses(query_id, clause_id,
    must, term, qtf)``: a clause matches a document when any of its terms
    does; a document must match every MUST clause (``must = 1``) and, when a
    query has no MUST clause, at least one SHOULD clause. Score = Σ over
    matching clauses of Σ qtf · similarity. Output ``(query_id, doc_id, score)``."""
    qt = clauses.groupBy("query_id", "term").agg(F.lit(1).alias("qtf"))
    m = term_matches(index, qt).select("query_id", "doc_id", "term", (similarity_expr(similarity, **params))
                                       .alias("s"))
    cl = checked_broadcast(clauses.select("query_id", "clause_id", "must", "term", "qtf"))
    per_clause = (m.join(cl, ["query_id", "term"]).groupBy("query_id", "doc_id", "clause_id", "must")
                  .agg(F.sum(F.col("qtf") * F.col("s")).alias("s")))
    docs = per_clause.groupBy("query_id", "doc_id").agg(
        F.sum("s").alias("score"), F.count_distinct(F.when(F.col("must") == 1, F.col("clause_id"))).alias("hm"))
    need = clauses.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("must") == 1, F.col("clause_id"))).alias("n_must"))
    return (docs.join(checked_broadcast(need), "query_id")
            .filter(F.col("hm") == F.col("n_must")).select("query_id", "doc_id", "score"))


def top_k_pruned(index: Index, qterms: DataFrame, k: int, post=None, common_df: int | None = None,
                 similarity: str = "bm25", **params) -> DataFrame:
    """Exact top-k per query without scoring every document of a common term.

    Query terms split into *rare* (``df <= common_df``) and *common*. Only
    documents matching a rare term are candidates; they are scored on all the
    query's terms by an equi-join on ``(doc_id, term)`` (volume ≤ candidates ×
    query terms). A document matching only common terms scores at most
    ``UB(q) = Σ qtf · max_d contribution(t, d)`` over the common terms, so a
    query whose k-th candidate score beats ``UB(q)`` is exact (MaxScore).
    The remaining queries are scored in full. ``post`` filters scored
    ``(query_id, doc_id, score)`` rows (self-exclusion, MUST clauses) in both
    paths — filtering only removes documents, so the bound stays valid.
    Output ``(query_id, doc_id, score, rank)``.
    """
    post = post or (lambda s: s)
    n_docs = index.stats()["n_docs"]
    cut = common_df if common_df is not None else max(1000, int(n_docs // 100))
    qt = qterms.select("query_id", "term", "qtf").join(index.term_stats.select("term", "df"), "term")
    rare = qt.filter(F.col("df") <= cut).drop("df")
    common = qt.filter(F.col("df") > cut).drop("df")
    contrib = similarity_expr(similarity, **params)

    # per-term upper bound over the common terms' postings (one aggregation)
    cterms = common.select("term").distinct().select(F.lit(0).alias("query_id"), "term", F.lit(1).alias("qtf"))
    ub_t = term_matches(index, cterms).groupBy("term").agg(F.max(contrib).alias("ub"))
    ub_q = common.join(ub_t, "term").groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("ub")).alias("ub_q"))

    # candidates: documents holding a rare query term, scored on every query term
    cand = term_matches(index, rare).select("query_id", "doc_id").distinct()
    pairs = cand.join(qt.select("query_id", "term", "qtf"), "query_id")
    st = index.with_stats(index.term_stats.select("term", "df", "cf"))
    scored = (pairs.join(index.postings.select("doc_id", "term", "tf", "dl"), ["doc_id", "term"])
              .join(st, "term")
              .groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * contrib).alias("score")))
    best = cut_lineage(top_k(post(scored), k))
    kth = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    queries = qterms.select("query_id").distinct()
    # fewer than k candidates give no k-th score, which proves nothing
    beaten = F.coalesce(F.round("kth", SCORE_DIGITS) > F.round("ub_q", SCORE_DIGITS), F.lit(False))
    verdict = (queries.join(ub_q, "query_id", "left").join(kth, "query_id", "left")
               .select("query_id", (F.col("ub_q").isNull() | beaten).alias("exact")))
    exact_q = verdict.filter("exact").select("query_id")
    rest_q = verdict.filter(~F.col("exact")).select("query_id")
    fast = best.join(exact_q, "query_id", "left_semi")
    rest_terms = qterms.join(rest_q, "query_id", "left_semi")
    slow = top_k(post(score(index, rest_terms, similarity, **params).select("query_id", "doc_id", "score")), k)
    return fast.select("query_id", "doc_id", "score", "rank").unionByName(
        slow.select("query_id", "doc_id", "score", "rank"))
