"""Query expansion (Q7–Q9): the benchmark passage as a MUST (or SHOULD)
sub-query plus generated alternatives, scored clause by clause with BM25."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators import vectors as V
from quarry.operators.corpus import global_ordinal
from quarry.operators.index import query_terms, tokenize
from quarry.plans import _REGISTRY, register
from quarry.plans.common import (SQL_BENCH_TERMS, SQL_INDEX, bench_terms, doc_index, r6, sql_bm25, sql_std_tokens,
                                 sql_topk, tbl)
from quarry.plans.vectors import SQL_WV, word_vectors
from quarry.session import checkpoint_dir
from quarry.sources.files import read_dictionary

K = 10


def _orig(spark, sf_dir, must=1):
    return bench_terms(spark, sf_dir).select("query_id", F.lit(0).alias("clause_id"), F.lit(must).alias("must"),
                                             "term", "qtf")


def _translation(spark, sf_dir):
    from quarry.plans.vectors import translate_text
    return translate_text(spark, sf_dir)


def _out(spark, sf_dir, clauses):
    hits = search.top_k(search.clause_search(doc_index(spark, sf_dir), clauses), K)
    return hits.select("query_id", "doc_id", r6("score").alias("score"), F.col("rank").cast("long"))


def _sql(clauses_cte: str, extra: str) -> str:
    return f"""WITH {SQL_INDEX}, {SQL_BENCH_TERMS}, {extra},
cl AS ({clauses_cte}),
cs AS (SELECT cl.query_id, m.doc_id, clause_id, must, sum(cl.qtf * ({sql_bm25()})) AS s
       FROM cl JOIN m USING (term) GROUP BY 1, 2, 3, 4),
nm AS (SELECT query_id, count(DISTINCT CASE WHEN must = 1 THEN clause_id END) AS n_must FROM cl GROUP BY 1),
d AS (SELECT cs.query_id, doc_id, sum(s) AS score, count(DISTINCT CASE WHEN must = 1 THEN clause_id END) AS hm
      FROM cs GROUP BY 1, 2),
ok AS (SELECT d.query_id, doc_id, score FROM d JOIN nm USING (query_id) WHERE hm = n_must)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM {sql_topk('ok', K)}"""


def _alt_terms_sql(src: str, text_col: str) -> str:
    return (f"SELECT query_id, 1 AS clause_id, 0 AS must, term, count(*) AS qtf FROM "
            f"(SELECT query_id, unnest({sql_std_tokens(text_col)}) AS term FROM {src}) GROUP BY query_id, term")


@register("expand_alternatives", _sql(
    f"SELECT query_id, 0 AS clause_id, 1 AS must, term, qtf FROM qt UNION ALL {_alt_terms_sql('alt', 'translation')}",
    f"alt AS ({_REGISTRY['translate_text'][1]})"))
def expand_alternatives(spark, sf_dir):
    """Q7: original passage MUST + its generated alternative (word-by-word
    nearest-neighbour rewrite) SHOULD."""
    alt = query_terms(_translation(spark, sf_dir), "translation", "query_id").select(
        "query_id", F.lit(1).alias("clause_id"), F.lit(0).alias("must"), "term", "qtf")
    return _out(spark, sf_dir, _orig(spark, sf_dir).unionByName(alt))


@register("expand_joined", _sql(
    "SELECT query_id, 0 AS clause_id, 1 AS must, term, qtf FROM qt UNION ALL "
    "SELECT query_id, 1, 0, term, count(*) FROM syn WHERE type = 'SYNONYM' GROUP BY query_id, term",
    f"syn AS ({_REGISTRY['expand_synonyms'][1]})"))
def expand_joined(spark, sf_dir):
    """Q8: original passage MUST + one SHOULD made of all generated synonym
    tokens joined."""
    from quarry.plans.vectors import expand_synonyms

    syn = (expand_synonyms(spark, sf_dir).filter(F.col("type") == "SYNONYM")
           .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
           .select("query_id", F.lit(1).alias("clause_id"), F.lit(0).alias("must"), "term", "qtf"))
    return _out(spark, sf_dir, _orig(spark, sf_dir).unionByName(syn))


# The translators that stand in for a detected language without one, in order.
FALLBACKS = ("en", "it")


def _cross_language_sql() -> str:
    extra = f"""{SQL_WV},
lg AS (SELECT query_id, lang FROM ({_REGISTRY['detect_language'][1]})),
spoken AS (SELECT DISTINCT lang, term AS word FROM (SELECT lang, unnest({sql_std_tokens('text')}) AS term FROM documents)),
hx AS (SELECT word, unnest(vector[1:32]) AS src, unnest(vector[33:64]) AS tgt, unnest(range(1, 33)) AS i FROM wv),
scale AS (SELECT lang, i, sum(src * tgt) / sum(src * src) AS w FROM spoken JOIN hx USING (word) GROUP BY lang, i),
qtok AS (SELECT DISTINCT lang, term AS word FROM qt JOIN lg USING (query_id)),
px AS (SELECT lang, word, i, src * w AS v FROM qtok JOIN hx USING (word) JOIN scale USING (lang, i)),
pn AS (SELECT lang, word, sqrt(sum(v * v)) AS n FROM px GROUP BY ALL),
tn AS (SELECT word, sqrt(sum(tgt * tgt)) AS n FROM hx GROUP BY word),
sims AS (SELECT px.lang, px.word, hx.word AS dst, sum(px.v * hx.tgt) AS dot FROM px JOIN hx ON hx.i = px.i AND hx.word <> px.word
         GROUP BY ALL),
tr AS (SELECT lang, word, dst FROM (SELECT lang, word, dst, row_number() OVER (PARTITION BY lang, word
         ORDER BY round(dot / (pn.n * tn.n), 9) DESC, dst) AS r FROM sims JOIN pn USING (lang, word)
         JOIN tn ON tn.word = dst) WHERE r = 1),
alt AS (SELECT query_id, coalesce(dst, term) AS term, sum(qtf)::BIGINT AS qtf FROM qt JOIN lg USING (query_id)
        LEFT JOIN tr ON tr.lang = lg.lang AND tr.word = qt.term GROUP BY ALL)"""
    return (_sql("SELECT query_id, 0 AS clause_id, 0 AS must, term, qtf FROM qt UNION ALL "
                 "SELECT query_id, 1, 0, term, qtf FROM alt", extra)
            .replace("SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (", "SELECT h.*, lang FROM ("
                     "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (") + ") h JOIN lg USING (query_id)")


def language_matrices(spark, sf_dir):
    """V9: one projection per language of ``documents``, fitted in one pass on the word vectors of its words."""
    wv = word_vectors(spark, sf_dir)
    d = tbl(spark, sf_dir, "documents").withColumn("k", F.struct("doc_id", "lang"))
    spoken = tokenize(d, "text", "k").select(F.col("doc_id.lang").alias("lang"), F.col("term").alias("word")).distinct()
    pairs = spoken.join(wv, "word").select("lang", F.slice("vector", 1, 32).alias("src"), F.slice("vector", 33, 32).alias("tgt"))
    return V.translation_matrices(pairs, ["lang"], diagonal=True)


@register("cross_language_search", _cross_language_sql())
def cross_language_search(spark, sf_dir):
    """Q9: detect the passage language, translate its tokens with that language's projection (or the first fallback's
    that exists) to their nearest target words, then original SHOULD + translation SHOULD."""
    from quarry.plans.related import detect_language

    lang = detect_language(spark, sf_dir).select("query_id", "lang")
    matrices = language_matrices(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    have = {r["lang"] for r in matrices.select("lang").collect()}  # one row per language
    spare = next((x for x in FALLBACKS if x in have), None)
    chosen = lang.select("query_id", F.when(F.col("lang").isin(*have), F.col("lang")).otherwise(F.lit(spare)).alias("lang"))
    terms = bench_terms(spark, sf_dir).join(chosen, "query_id", "left")
    wv = word_vectors(spark, sf_dir)
    source = (terms.select("lang", F.col("term").alias("word")).distinct().join(wv, "word")
              .select("lang", "word", F.slice("vector", 1, 32).alias("src")))
    asked = V.project_by(source, "src", matrices, ["lang"], out="qvec").select(
        F.concat("lang", F.lit("|"), "word").alias("query_id"), "qvec")
    target = wv.select("word", F.slice("vector", 33, 32).alias("vector"))
    near = V.knn(target, asked, k=2, metric="cosine", id_col="word", vec_col="vector")
    near = search.top_k(near.filter(~F.col("query_id").endswith(F.concat(F.lit("|"), "word"))), 1, score_col="similarity",
                        id_col="word").select(F.col("query_id").alias("asked"), F.col("word").alias("dst"))
    j = terms.join(near, F.concat("lang", F.lit("|"), "term") == F.col("asked"), "left")
    alt = (j.groupBy("query_id", F.coalesce("dst", "term").alias("term")).agg(F.sum("qtf").alias("qtf"))
           .select("query_id", F.lit(1).alias("clause_id"), F.lit(0).alias("must"), "term", "qtf"))
    hits = _out(spark, sf_dir, _orig(spark, sf_dir, must=0).unionByName(alt))
    return hits.join(lang, "query_id", "left")


@register("dictionary_projection", f"""WITH {SQL_WV},
pairs AS (SELECT a.vector[1:32] AS s, b.vector[33:64] AS t FROM (SELECT word, vector, row_number() OVER (ORDER BY word) AS r FROM wv) a
  JOIN (SELECT word, vector, row_number() OVER (ORDER BY word) AS r FROM wv) b ON b.r = a.r + 1),
x AS (SELECT unnest(s) AS s, unnest(t) AS t, unnest(range(0, 32)) AS dim FROM pairs)
SELECT dim::BIGINT AS dim, round(sum(s * t) / sum(s * s), 6) AS value FROM x GROUP BY dim""")
def dictionary_projection(spark, sf_dir):
    """S8 + V9: a dictionary file, written with each word's successor as its translation, read back and fitted."""
    wv = word_vectors(spark, sf_dir)
    r = global_ordinal(wv.select("word"), [F.col("word").asc()], out="r")
    lines = r.join(r.select(F.col("word").alias("next"), (F.col("r") - 1).alias("r")), "r").select(
        F.concat_ws(" ", "word", "next").alias("value"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-dictionary-{uuid.uuid4().hex}"
    lines.write.text(path)
    pairs = (read_dictionary(spark, path)
             .join(wv.select(F.col("word").alias("source"), F.slice("vector", 1, 32).alias("src")), "source")
             .join(wv.select(F.col("word").alias("target"), F.slice("vector", 33, 32).alias("tgt")), "target")
             .withColumn("pair", F.lit("a-b")))
    m = V.translation_matrices(pairs, ["pair"], diagonal=True)
    return m.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.get("matrix", i * F.col("e") + i)))
                    .alias("dim", "value")).select(F.col("dim").cast("long"), r6("value").alias("value"))
