"""Analysis (A1–A11, A14–A16) and index tables (I1–I4) over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import index as I
from quarry.plans import register
from quarry.plans.common import SQL_STOP_EN, doc_index, r6, sql_std_tokens, tbl

FIXTURE_STOP = ("a", "an", "the")


def _joined(toks):
    return F.array_join(toks, " ")


def _doc_tokens(spark, sf_dir, fn):
    d = tbl(spark, sf_dir, "documents")
    return d.select("doc_id", fn(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), _joined(F.col("t")).alias("tokens"))


def _doc_tokens_sql(expr: str) -> str:
    return (f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens "
            f"FROM (SELECT doc_id, {expr} AS t FROM documents)")


SQL_WS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


@register("tok_whitespace", _doc_tokens_sql(SQL_WS))
def tok_whitespace(spark, sf_dir):
    """A1: whitespace tokens of every document."""
    return _doc_tokens(spark, sf_dir, T.whitespace_tokens)


@register("tok_standard", _doc_tokens_sql(sql_std_tokens("text")))
def tok_standard(spark, sf_dir):
    """A2: standard (letter/digit) lower-cased tokens."""
    return _doc_tokens(spark, sf_dir, T.standard_tokens)


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in FIXTURE_STOP) + "]"


@register("tok_stop", f"""
SELECT doc_id, len(k)::BIGINT AS n_tokens, array_to_string(k, ' ') AS tokens FROM (
  SELECT doc_id, list_filter(list_transform(w, lambda x, i: (i - 1) || ':' || x),
                             lambda y: NOT list_contains({_STOP_SQL}, lower(substr(y, strpos(y, ':') + 1)))) AS k
  FROM (SELECT doc_id, {SQL_WS} AS w FROM documents))""")
def tok_stop(spark, sf_dir):
    """A3: stop words ``a an the`` removed from whitespace tokens, positions kept as gaps."""
    d = tbl(spark, sf_dir, "documents")
    stop = F.array(*[F.lit(w) for w in FIXTURE_STOP])
    w = T.whitespace_tokens(F.col("text"))
    tagged = F.transform(w, lambda x, i: F.struct(i.alias("pos"), x.alias("tok")))
    kept = F.filter(tagged, lambda s: ~F.array_contains(stop, F.lower(s["tok"])))
    k = F.transform(kept, lambda s: F.concat(s["pos"].cast("string"), F.lit(":"), s["tok"]))
    return d.select("doc_id", k.alias("k")).select(
        "doc_id", F.size("k").cast("long").alias("n_tokens"), _joined(F.col("k")).alias("tokens"))


def _sql_s_stem(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '[^ae]ies$') THEN regexp_replace({x}, 'ies$', 'y') "
            f"WHEN regexp_matches({x}, '[^aeo]es$') THEN regexp_replace({x}, 'es$', 'e') "
            f"WHEN regexp_matches({x}, '[^us]s$') THEN regexp_replace({x}, 's$', '') ELSE {x} END")


SQL_ENGLISH = (
    "list_transform(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), "
    f"'{T.ENGLISH_WORD_RE.replace(chr(39), chr(39) * 2)}'), lambda w: regexp_replace(w, '''s$', '')), "
    f"lambda w: NOT list_contains({SQL_STOP_EN}, w)), lambda x: {_sql_s_stem('x')})")


@register("tok_english", _doc_tokens_sql(SQL_ENGLISH))
def tok_english(spark, sf_dir):
    """A4: English analysis (possessive, stop words, S-stemmer)."""
    return _doc_tokens(spark, sf_dir, T.english_tokens)


@register("analyze_per_field", f"""
SELECT doc_id, array_to_string({SQL_ENGLISH}, ' ') AS text_terms,
       array_to_string({sql_std_tokens('source')}, ' ') AS source_terms, lang AS lang_term
FROM documents""")
def analyze_per_field(spark, sf_dir):
    """A5: per-field analysers in one projection: text → English, source →
    standard (the default), lang → keyword (verbatim)."""
    d = tbl(spark, sf_dir, "documents")
    return d.select("doc_id", _joined(T.english_tokens(F.col("text"))).alias("text_terms"),
                    _joined(T.standard_tokens(F.col("source"))).alias("source_terms"),
                    F.col("lang").alias("lang_term"))


_SPEC = T.regex_class_escape(T.SPECIALS)
_SQL_SPEC_TOKS = f"regexp_extract_all(coalesce(text, ''), '[^ \\t{_SPEC}]+|[{_SPEC}]')"


@register("tok_specials", f"""
SELECT doc_id, array_to_string(list_filter(a, lambda x: NOT regexp_matches(x, '^[{_SPEC}]$')), ' ') AS words,
       array_to_string(a, ' ') AS words_and_specials, len(a)::BIGINT AS n_tokens
FROM (SELECT doc_id, {_SQL_SPEC_TOKS} AS a FROM documents)""")
def tok_specials(spark, sf_dir):
    """blank/tab split, words split at the 27 specials; with and without specials."""
    d = tbl(spark, sf_dir, "documents")
    a = T.special_tokens(F.col("text"), keep_specials=True)
    w = T.special_tokens(F.col("text"), keep_specials=False)
    return d.select("doc_id", _joined(w).alias("words"), _joined(a).alias("words_and_specials"),
                    F.size(a).cast("long").alias("n_tokens"))


def feature_string(vec_col="embedding", scale: int = 1000):
    """L2: a vector as a ``", "``-separated string of integer thousandths."""
    return F.array_join(F.transform(F.col(vec_col), lambda x: F.round(x.cast("double") * scale)
                                    .cast("long").cast("string")), ", ")


SQL_FEATURE_STRING = ("array_to_string(list_transform(embedding, lambda x: "
                      "round(x::DOUBLE * 1000)::BIGINT::VARCHAR), ', ')")
SQL_FEATURE_TOKENS = f"list_filter(string_split_regex({SQL_FEATURE_STRING}, '[\\s,]+'), lambda x: x <> '')"


@register("feature_tokens", f"""
SELECT vec_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT vec_id, {SQL_FEATURE_TOKENS} AS t FROM embeddings)""")
def feature_tokens(spark, sf_dir):
    """A8 (+L2): feature strings of the embedding vectors split at blanks/commas."""
    e = tbl(spark, sf_dir, "embeddings")
    t = T.feature_tokens(feature_string())
    return e.select("vec_id", F.size(t).cast("long").alias("n_tokens"), _joined(t).alias("tokens"))


@register("truncate_tokens", f"""
SELECT vec_id, array_to_string(list_transform({SQL_FEATURE_TOKENS}, lambda x: substr(x, 1, 3)), ' ') AS tokens
FROM embeddings""")
def truncate_tokens(spark, sf_dir):
    """Feature tokens truncated to 3 characters."""
    e = tbl(spark, sf_dir, "embeddings")
    return e.select("vec_id", _joined(T.truncate_tokens(T.feature_tokens(feature_string()), 3)).alias("tokens"))


@register("position_tokens", f"""
SELECT vec_id, array_to_string(list_transform(list_transform({SQL_FEATURE_TOKENS}, lambda x: substr(x, 1, 3)),
       lambda x, i: i || '_' || x), ' ') AS tokens FROM embeddings""")
def position_tokens(spark, sf_dir):
    """A10: truncated feature tokens prefixed with their 1-based position."""
    e = tbl(spark, sf_dir, "embeddings")
    t = T.position_tokens(T.truncate_tokens(T.feature_tokens(feature_string()), 3))
    return e.select("vec_id", _joined(t).alias("tokens"))


@register("shingles", f"""
SELECT doc_id, len(s)::BIGINT AS n_shingles, array_to_string(s, '|') AS shingles FROM (
  SELECT doc_id, CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1),
         lambda i: array_to_string(t[i:i + 2], ' ')) ELSE [] END AS s
  FROM (SELECT doc_id, {sql_std_tokens('text')} AS t FROM documents))""")
def shingles(spark, sf_dir):
    """Word 3-grams (no unigrams) of every document."""
    d = tbl(spark, sf_dir, "documents").select("doc_id", T.standard_tokens(F.col("text")).alias("t"))
    s = T.shingles(F.col("t"), 3, 3)  # over a materialised column: the lambda must not re-tokenise
    return d.select("doc_id", F.size(s).cast("long").alias("n_shingles"),
                    F.array_join(s, "|").alias("shingles"))


@register("prefixes", """
SELECT p_partkey, len(p)::BIGINT AS n_prefixes, array_to_string(p, '|') AS prefixes FROM (
  SELECT p_partkey, CASE WHEN length(p_name) = 0 THEN [''] ELSE
         list_transform(range(1, length(p_name) + 1), lambda i: substr(p_name, 1, i)) END AS p FROM part)""")
def prefixes(spark, sf_dir):
    """All prefixes of every part name."""
    p = tbl(spark, sf_dir, "part")
    x = T.prefixes(F.col("p_name"))
    return p.select("p_partkey", F.size(x).cast("long").alias("n_prefixes"),
                    F.array_join(x, "|").alias("prefixes"))


_CF = ("a-zA-Z0-9" + T.regex_class_escape(T.CHAR_FILTER_EXTRA)).replace("'", "''")


@register("char_filter", f"""
SELECT doc_id, regexp_replace(coalesce(text, ''), '[^{_CF}]', '', 'g') AS kept,
       length(regexp_replace(coalesce(text, ''), '[^{_CF}]', '', 'g'))::BIGINT AS n_kept FROM documents""")
def char_filter(spark, sf_dir):
    """Characters outside the 77-character set removed."""
    d = tbl(spark, sf_dir, "documents")
    k = T.char_filter(F.col("text"))
    return d.select("doc_id", k.alias("kept"), F.length(k).cast("long").alias("n_kept"))


@register("term_freq", f"""
SELECT term, count(*)::BIGINT AS freq
FROM (SELECT unnest({sql_std_tokens('text')}) AS term FROM documents) GROUP BY term""")
def term_freq(spark, sf_dir):
    """Collection term frequencies (partial aggregation before the shuffle)."""
    d = tbl(spark, sf_dir, "documents")
    return (d.select(F.explode_outer(T.standard_tokens(F.col("text"))).alias("term")).filter(F.col("term").isNotNull())
            .groupBy("term").agg(F.count(F.lit(1)).alias("freq")))


SQL_POSTINGS = f"""
WITH toks AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos, len(t) AS dl
              FROM (SELECT doc_id, {sql_std_tokens('text')} AS t FROM documents))"""


@register("build_postings", SQL_POSTINGS + """
SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(dl)::BIGINT AS dl,
       array_to_string(list_sort(list(pos)), ',') AS positions
FROM toks GROUP BY doc_id, term""")
def build_postings(spark, sf_dir):
    """Postings with tf, document length and positions."""
    idx = doc_index(spark, sf_dir, positions=True)
    return idx.postings.select("doc_id", "term", F.col("tf").cast("long"), F.col("dl").cast("long"),
                               F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@register("term_stats", SQL_POSTINGS + """,
post AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term)
SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term""")
def term_stats(spark, sf_dir):
    """Document frequency and collection frequency per term."""
    return doc_index(spark, sf_dir).term_stats.select("term", F.col("df").cast("long"), F.col("cf").cast("long"))


@register("field_stats", SQL_POSTINGS + """,
dls AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY doc_id)
SELECT count(*)::BIGINT AS n_docs, sum(dl)::BIGINT AS sum_ttf, round(sum(dl) / count(*), 6) AS avgdl,
       (SELECT count(DISTINCT term) FROM toks)::BIGINT AS n_terms FROM dls""")
def field_stats(spark, sf_dir):
    """Collection statistics (with vocabulary size)."""
    idx = doc_index(spark, sf_dir)
    n_terms = idx.term_stats.count()
    return idx.field_stats.select(
        F.col("n_docs").cast("long"), F.col("sum_ttf").cast("long"), r6("avgdl").alias("avgdl"),
        F.lit(n_terms).cast("long").alias("n_terms"))


@register("doc_length", SQL_POSTINGS + """
SELECT doc_id, count(*)::BIGINT AS dl FROM toks GROUP BY doc_id""")
def doc_length(spark, sf_dir):
    """I4: token count per document (derived from the postings, no rescan)."""
    return doc_index(spark, sf_dir).doc_lengths.select("doc_id", F.col("dl").cast("long"))


from quarry.sources.markup import CATEGORY_DROP_RE as SX_DROP  # noqa: E402
from quarry.sources.markup import CATEGORY_RE as _CRE  # noqa: E402

SX_CATEGORY_RE_SQL = _CRE.replace("'", "''")


@register("gen_queries")
def gen_queries(spark, sf_dir):
    """100 queries of 1–4 words drawn (seeded) from the document vocabulary."""
    from quarry.operators.corpus import global_ordinal
    from quarry.operators.index import random_queries
    from quarry.plans.common import doc_index

    ts = doc_index(spark, sf_dir).term_stats.select(F.col("term").alias("word"), "cf")
    ranked = global_ordinal(ts, [F.col("cf").desc(), F.col("word").asc()], out="r")
    return random_queries(ranked, 100, 4)


@register("extract_categories", f"""SELECT page_id, unnest(list_distinct(list_filter(flatten(list_transform(
  regexp_extract_all(html, '{SX_CATEGORY_RE_SQL}', 1), lambda c: string_split(regexp_replace(c, '{SX_DROP}', '', 'g'), '|'))),
  lambda c: c <> ''))) AS category FROM pages""")
def extract_categories(spark, sf_dir):
    """S3: category names found in the pages, one row per (page, category)."""
    from quarry.sources.markup import categories

    p = tbl(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(categories(F.col("html"))).alias("category"))
