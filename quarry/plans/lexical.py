"""Index statistics, boolean/phrase retrieval and lexical rankers over
``documents`` with the ``benchmark`` passages as the query table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans import register
from quarry.plans.vectors import SQL_WV, sql_word_embeddings
from quarry.plans.common import (SQL_BENCH_TERMS, SQL_INDEX, bench_terms, doc_index, r6,
                                 sql_bm25, sql_classic, sql_lm_dirichlet, sql_lm_jm, sql_topk, tbl)

K = 10


def _ranked(spark, sf_dir, similarity, **params):
    idx = doc_index(spark, sf_dir)
    hits = search.rank(idx, bench_terms(spark, sf_dir), similarity, K, **params)
    return hits.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"))


def _ranked_sql(expr: str) -> str:
    return f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS},
scored AS (SELECT qt.query_id, m.doc_id, sum(qt.qtf * ({expr})) AS score
           FROM qt JOIN m USING (term) GROUP BY qt.query_id, m.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {sql_topk('scored', K)}"""


@register("rank_bm25", _ranked_sql(sql_bm25()))
def rank_bm25(spark, sf_dir):
    """R2 + Q1 + Q10: BM25 (1.2, 0.75) top-10 per benchmark passage."""
    return _ranked(spark, sf_dir, "bm25")


@register("rank_classic", _ranked_sql(sql_classic()))
def rank_classic(spark, sf_dir):
    """Classic tf-idf (idf squared) top-10."""
    return _ranked(spark, sf_dir, "classic")


@register("rank_lm_jm", _ranked_sql(sql_lm_jm()))
def rank_lm_jm(spark, sf_dir):
    """Language model, Jelinek-Mercer λ=0.1, top-10."""
    return _ranked(spark, sf_dir, "lm_jm")


@register("rank_lm_dirichlet", _ranked_sql(sql_lm_dirichlet()))
def rank_lm_dirichlet(spark, sf_dir):
    """Language model, Dirichlet μ=2000, top-10."""
    return _ranked(spark, sf_dir, "lm_dirichlet")


@register("rank_multi", _ranked_sql(f"({sql_bm25()}) + ({sql_lm_jm()})"))
def rank_multi(spark, sf_dir):
    """BM25 + LM-JM summed per term, top-10."""
    return _ranked(spark, sf_dir, "bm25+lm_jm")


# ---- boolean, phrase, top-k, explain (Q1–Q4, Q6, Q10, Q11) ------------------
from quarry.operators.index import tokenize  # noqa: E402
from quarry.plans.common import sql_std_tokens, tbl  # noqa: E402

# Function words of the other three corpus languages, excluded by search_not.
FOREIGN_MARKERS = ("le", "la", "les", "der", "die", "das", "el", "los")

_SQL_Q = "q AS (SELECT DISTINCT query_id, term FROM qt)"


def _distinct_terms(spark, sf_dir):
    return bench_terms(spark, sf_dir).select("query_id", "term")


def _scored_out(df):
    return df.select("query_id", "doc_id", r6("score").alias("score"))


@register("search_or", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {_SQL_Q}
SELECT q.query_id, m.doc_id, round(sum({sql_bm25()}), 6) AS score FROM q JOIN m USING (term)
GROUP BY q.query_id, m.doc_id""")
def search_or(spark, sf_dir):
    """Q1: OR over the distinct passage terms, BM25 scored, all matches."""
    idx = doc_index(spark, sf_dir)
    return _scored_out(search.boolean_search(idx, should=_distinct_terms(spark, sf_dir)))


@register("search_must", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {_SQL_Q},
nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
h AS (SELECT q.query_id, m.doc_id, sum({sql_bm25()}) AS score, count(*) AS hit
      FROM q JOIN m USING (term) GROUP BY q.query_id, m.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM h JOIN nq USING (query_id) WHERE hit = n""")
def search_must(spark, sf_dir):
    """Q2: every passage term is a MUST clause (conjunctive search)."""
    idx = doc_index(spark, sf_dir)
    return _scored_out(search.boolean_search(idx, must=_distinct_terms(spark, sf_dir)))


_FM_SQL = "[" + ", ".join(f"'{w}'" for w in FOREIGN_MARKERS) + "]"


@register("search_not", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {_SQL_Q},
h AS (SELECT q.query_id, m.doc_id, sum({sql_bm25()}) AS score
      FROM q JOIN m USING (term) GROUP BY q.query_id, m.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM h
WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE list_contains({_FM_SQL}, term))""")
def search_not(spark, sf_dir):
    """Q3: passage terms SHOULD, foreign function words MUST_NOT."""
    idx = doc_index(spark, sf_dir)
    should = _distinct_terms(spark, sf_dir)
    must_not = should.select("query_id").distinct().select(
        "query_id", F.explode(F.array(*[F.lit(w) for w in FOREIGN_MARKERS])).alias("term"))
    return _scored_out(search.boolean_search(idx, should=should, must_not=must_not))


@register("min_should_match", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {_SQL_Q},
nq AS (SELECT query_id, ceil(count(*) * 0.5)::BIGINT AS msm FROM q GROUP BY query_id),
h AS (SELECT q.query_id, m.doc_id, sum({sql_bm25()}) AS score, count(*) AS hit
      FROM q JOIN m USING (term) GROUP BY q.query_id, m.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM h JOIN nq USING (query_id) WHERE hit >= msm""")
def min_should_match(spark, sf_dir):
    """Q6: at least ceil(0.5 · n) of the distinct passage terms must match."""
    idx = doc_index(spark, sf_dir)
    should = _distinct_terms(spark, sf_dir)
    msm = search.min_should_match_from_similarity(should, 0.5)
    return _scored_out(search.boolean_search(idx, should=should, min_should_match=msm))


@register("search_phrase", f"""WITH {SQL_INDEX.split('post AS')[0].rstrip().rstrip(',')},
ph AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS off, len(t) AS plen
       FROM (SELECT item_id AS query_id, {sql_std_tokens('text')} AS t FROM benchmark)),
st AS (SELECT ph.query_id, toks.doc_id, toks.pos - ph.off AS start, count(DISTINCT ph.off) AS n, any_value(plen) AS plen
       FROM ph JOIN toks USING (term) GROUP BY ph.query_id, toks.doc_id, toks.pos - ph.off)
SELECT query_id, doc_id, count(*)::BIGINT AS freq FROM st WHERE n = plen GROUP BY query_id, doc_id""")
def search_phrase(spark, sf_dir):
    """Q4: each whole benchmark passage as an exact phrase; phrase frequency per document."""
    idx = doc_index(spark, sf_dir, positions=True)
    ph = tokenize(tbl(spark, sf_dir, "benchmark"), "text", "item_id").select(
        F.col("doc_id").alias("query_id"), F.col("pos").alias("offset"), "term")
    return search.phrase_search(idx, ph).select("query_id", "doc_id", F.col("freq").cast("long"))


@register("topk", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS},
scored AS (SELECT qt.query_id, m.doc_id, sum(qt.qtf * ({sql_bm25()})) AS score
           FROM qt JOIN m USING (term) GROUP BY qt.query_id, m.doc_id),
summ AS (SELECT query_id, count(*)::BIGINT AS total_hits, round(max(score), 6) AS max_score FROM scored GROUP BY query_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank, total_hits, max_score
FROM {sql_topk('scored', 5)} JOIN summ USING (query_id)""")
def topk(spark, sf_dir):
    """Q10: top-5 with total hits and max score per query."""
    idx = doc_index(spark, sf_dir)
    scored = search.score(idx, bench_terms(spark, sf_dir), "bm25")
    best = search.top_k(scored, 5)
    summ = search.hit_summary(scored)
    return best.join(summ, "query_id").select(
        "query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"),
        F.col("total_hits").cast("long"), r6("max_score").alias("max_score"))


@register("fetch_hits", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS},
scored AS (SELECT qt.query_id, m.doc_id, sum(qt.qtf * ({sql_bm25()})) AS score
           FROM qt JOIN m USING (term) GROUP BY qt.query_id, m.doc_id)
SELECT query_id, h.doc_id, rank, lang, source, md5(text) AS text_md5 FROM {sql_topk('scored', K)} h
JOIN documents d ON d.doc_id = h.doc_id""")
def fetch_hits(spark, sf_dir):
    """Q12: stored fields of each query's top-10 hits, read for the hits alone."""
    hits = search.rank(doc_index(spark, sf_dir), bench_terms(spark, sf_dir), "bm25", K).select("query_id", "doc_id", "rank")
    r = search.fetch(hits, tbl(spark, sf_dir, "documents"), ["lang", "source", "text"])
    return r.select("query_id", "doc_id", F.col("rank").cast("long"), "lang", "source", F.md5("text").alias("text_md5"))


@register("explain_bm25", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS},
mq AS MATERIALIZED (SELECT qt.query_id, m.doc_id, m.term, tf, df, n_docs, dl, avgdl, qtf, {sql_bm25()} AS part
                    FROM qt JOIN m USING (term)),
scored AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * part) AS score FROM mq GROUP BY query_id, doc_id),
best AS MATERIALIZED (SELECT query_id, doc_id FROM {sql_topk('scored', 3)})
SELECT mq.query_id, mq.doc_id, mq.term, tf::BIGINT AS tf, df::BIGINT AS df,
       round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf,
       round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS tf_norm, round(qtf * part, 6) AS contribution
FROM best JOIN mq ON best.query_id = mq.query_id AND best.doc_id = mq.doc_id""")
def explain_bm25(spark, sf_dir):
    """Q11: per-term BM25 explanation of each query's top-3 hits."""
    idx = doc_index(spark, sf_dir)
    qt = bench_terms(spark, sf_dir)
    best = search.top_k(search.score(idx, qt, "bm25"), 3)
    e = search.explain(idx, qt, best)
    return e.select("query_id", "doc_id", "term", F.col("tf").cast("long"), F.col("df").cast("long"),
                    r6("idf").alias("idf"), r6("tf_norm").alias("tf_norm"), r6("contribution").alias("contribution"))


# ---- tf-idf vectors, cosine, multi-ranker (R6–R9, R12) ---------------------
from quarry.functions import vectors as VX  # noqa: E402
from quarry.operators import ranking  # noqa: E402
from quarry.operators.vectors_agg import vector_sum  # noqa: E402

SQL_TFIDF = "w AS (SELECT doc_id, term, 1 + ln(tf) * ln(n_docs / df) AS weight FROM m)"


@register("tfidf_weight", f"""WITH {SQL_INDEX}, {SQL_TFIDF}
SELECT doc_id, term, round(weight, 6) AS weight FROM w""")
def tfidf_weight(spark, sf_dir):
    """``1 + ln(tf) · ln(N/df)`` for every posting."""
    return ranking.tfidf_long(doc_index(spark, sf_dir)).select("doc_id", "term", r6("weight").alias("weight"))


@register("tfidf_vectors", f"""WITH {SQL_INDEX}, {SQL_TFIDF}
SELECT doc_id, count(*)::BIGINT AS nnz, round(sqrt(sum(weight * weight)), 6) AS norm,
       round(sum(weight), 6) AS total FROM w GROUP BY doc_id""")
def tfidf_vectors(spark, sf_dir):
    """Sparse tf-idf document vectors summarised as (nnz, L2 norm, sum)."""
    w = ranking.tfidf_long(doc_index(spark, sf_dir))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("nnz"),
                                   r6(F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("norm"),
                                   r6(F.sum("weight")).alias("total"))


@register("cosine_sim", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS c FROM e GROUP BY label, i)
SELECT vec_id, label::BIGINT AS label, round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 6) AS cosine
FROM e JOIN c USING (label, i) GROUP BY vec_id, label""")
def cosine_sim(spark, sf_dir):
    """Cosine of every embedding with its label's centroid."""
    e = tbl(spark, sf_dir, "embeddings")
    cent = vector_sum(e, ["label"], "embedding", mean=True, out="centroid")
    return (e.join(cent, "label")  # centroids: one row per label, joined by key
            .select("vec_id", F.col("label").cast("long"), r6(VX.cosine("embedding", "centroid")).alias("cosine")))


@register("rank_cosine_tfidf", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {SQL_TFIDF},
dn AS (SELECT doc_id, sqrt(sum(weight * weight)) AS dnorm FROM w GROUP BY doc_id),
qv AS (SELECT q.query_id, q.term, 1 + ln(ts.cf) * ln(fs.n_docs / ts.df) AS qw
       FROM (SELECT DISTINCT query_id, term FROM qt) q JOIN ts USING (term) CROSS JOIN fs),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qv GROUP BY query_id),
dots AS (SELECT qv.query_id, w.doc_id, sum(qw * weight) AS dot FROM qv JOIN w USING (term) GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, dot / (qnorm * dnorm) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (query_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {sql_topk('scored', K)}""")
def rank_cosine_tfidf(spark, sf_dir):
    """Cosine between the query's cf-based tf-idf vector and document tf-idf vectors."""
    hits = ranking.rank_cosine_tfidf(doc_index(spark, sf_dir), bench_terms(spark, sf_dir), K)
    return hits.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"))


_RANKER_SQL = {"bm25": sql_bm25(), "classic": sql_classic(), "lm_jm": sql_lm_jm(),
               "lm_dirichlet": sql_lm_dirichlet()}
_MULTI_UNION = " UNION ALL ".join(
    [f"SELECT qt.query_id, m.doc_id, '{n}' AS ranker, sum(qt.qtf * ({e})) AS score FROM qt JOIN m USING (term) "
     f"GROUP BY qt.query_id, m.doc_id" for n, e in _RANKER_SQL.items()]
    + ["SELECT query_id, doc_id, 'word_embedding' AS ranker, score FROM we_scored"])


def five_rankers(spark, sf_dir, k):
    """Four lexical rankers and word embeddings with tf-idf smoothing over the document index."""
    from quarry.operators import vectors
    from quarry.plans.vectors import word_vectors

    idx, terms = doc_index(spark, sf_dir), bench_terms(spark, sf_dir)
    embedded = vectors.score_word_embeddings(idx.postings, terms, word_vectors(spark, sf_dir), "tf_idf",
                                             n_docs=idx.stats()["n_docs"], best=k)
    return ranking.multi_rank(idx, terms, k=k, scored={"word_embedding": embedded})


@register("multi_ranker", f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {SQL_WV}, {sql_word_embeddings("tf_idf")},
scored AS ({_MULTI_UNION}),
mx AS (SELECT query_id, ranker, round(max(score), 6) AS max_score FROM scored GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ranker ORDER BY round(score, 9) DESC, doc_id) AS rank
         FROM scored) WHERE rank <= 3)
SELECT query_id, ranker, doc_id, round(score, 6) AS score, rank, max_score FROM best JOIN mx USING (query_id, ranker)""")
def multi_ranker(spark, sf_dir):
    """Four lexical rankers from one postings join and the word-embedding ranker, top-3 each with max score."""
    r = five_rankers(spark, sf_dir, 3)
    return r.select("query_id", "ranker", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"),
                    r6("max_score").alias("max_score"))
