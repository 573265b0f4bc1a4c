"""Suggesters G1–G8 and the dictionary source S7.

Lookups are "everything typed so far": all prefixes of every distinct part
name (whole names), the analogue of the prefixes of a logged query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import suggest as G
from quarry.plans import _REGISTRY, register
from quarry.plans.common import doc_index, r6, sql_std_tokens, tbl
from quarry.plans.vectors import SQL_WV

SQL_LOOKUPS = """
names AS (SELECT DISTINCT p_name FROM part WHERE length(p_name) > 0),
lk AS (SELECT p_name || '#' || i AS lookup_id, substr(p_name, 1, i) AS prefix FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS i FROM names))"""

SQL_DICT = "dict AS (SELECT p_name AS entry, count(*)::BIGINT AS weight FROM part GROUP BY p_name)"


def lookups(spark, sf_dir):
    names = tbl(spark, sf_dir, "part").select("p_name").distinct().filter(F.length("p_name") > 0)
    return names.select("p_name", F.explode(TX.prefixes(F.col("p_name"))).alias("prefix")).select(
        F.concat("p_name", F.lit("#"), F.length("prefix").cast("string")).alias("lookup_id"), "prefix")


def part_dictionary(spark, sf_dir):
    """Dictionary of entries with weights (part names, weight = occurrences)."""
    return tbl(spark, sf_dir, "part").groupBy(F.col("p_name").alias("entry")).agg(F.count(F.lit(1)).alias("weight"))


@register("suggest_dictionary", f"WITH {SQL_DICT} SELECT entry, weight FROM dict")
def suggest_dictionary(spark, sf_dir):
    """Weighted dictionary built from a field (part names, weight = count)."""
    return part_dictionary(spark, sf_dir).select("entry", F.col("weight").cast("long"))


@register("suggest_prefix", f"""WITH {SQL_LOOKUPS},
dict AS (SELECT term AS entry, count(DISTINCT doc_id)::BIGINT AS weight FROM
         (SELECT doc_id, unnest({sql_std_tokens('text')}) AS term FROM documents) GROUP BY term),
m AS (SELECT lk.lookup_id, dict.entry, dict.weight FROM lk JOIN dict ON starts_with(dict.entry, lk.prefix)),
r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY entry) AS rank FROM m)
SELECT lookup_id, entry, weight, rank FROM r WHERE rank <= 3""")
def suggest_prefix(spark, sf_dir):
    """G1: trie-style completion (alphabetical, top-3) of every lookup over the
    document vocabulary (weight = document frequency)."""
    d = doc_index(spark, sf_dir).term_stats.select(F.col("term").alias("entry"), F.col("df").alias("weight"))
    r = G.suggest_prefix(d, lookups(spark, sf_dir), k=3, by="alpha")
    return r.select("lookup_id", "entry", F.col("weight").cast("long"), F.col("rank").cast("long"))


def _sql_analyzed(x: str) -> str:
    t = sql_std_tokens(x)
    return (f"CASE WHEN len({t}) > 0 AND regexp_matches({x}, '\\s$') THEN array_to_string({t}, ' ') || ' ' "
            f"ELSE array_to_string({t}, ' ') END")


@register("suggest_analyzing", f"""WITH {SQL_LOOKUPS}, {SQL_DICT},
m AS (SELECT lk.lookup_id, dict.entry, dict.weight FROM lk JOIN dict
      ON length({_sql_analyzed('lk.prefix')}) > 0 AND starts_with({_sql_analyzed('dict.entry')}, {_sql_analyzed('lk.prefix')})),
r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY weight DESC, entry) AS rank FROM m)
SELECT lookup_id, entry, weight, rank FROM r WHERE rank <= 3""")
def suggest_analyzing(spark, sf_dir):
    """Prefix match on analysed forms, by weight desc (top-3)."""
    r = G.suggest_analyzing(part_dictionary(spark, sf_dir), lookups(spark, sf_dir), k=3)
    return r.select("lookup_id", "entry", F.col("weight").cast("long"), F.col("rank").cast("long"))


@register("suggest_infix", f"""WITH {SQL_LOOKUPS}, {SQL_DICT},
l AS (SELECT lookup_id, lt, regexp_matches(prefix, '\\s$') AS eb FROM (SELECT lookup_id, prefix, {sql_std_tokens('prefix')} AS lt FROM lk) WHERE len(lt) > 0),
l2 AS (SELECT lookup_id, CASE WHEN eb THEN lt ELSE lt[1:len(lt) - 1] END AS fulls, CASE WHEN eb THEN NULL ELSE lt[len(lt)] END AS partial FROM l),
d AS (SELECT entry, weight, {sql_std_tokens('entry')} AS et FROM dict),
m AS (SELECT l2.lookup_id, d.entry, d.weight FROM l2, d
      WHERE len(list_filter(l2.fulls, lambda t: NOT list_contains(d.et, t))) = 0
        AND (l2.partial IS NULL OR len(list_filter(d.et, lambda x: starts_with(x, l2.partial))) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY weight DESC, entry) AS rank FROM m)
SELECT lookup_id, entry, weight, rank FROM r WHERE rank <= 3""")
def suggest_infix(spark, sf_dir):
    """Infix completion — complete tokens anywhere, last token as prefix; weight desc."""
    r = G.suggest_infix(part_dictionary(spark, sf_dir), lookups(spark, sf_dir), k=3)
    return r.select("lookup_id", "entry", F.col("weight").cast("long"), F.col("rank").cast("long"))


@register("suggest_ngram", f"""WITH {SQL_LOOKUPS},
tk AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {sql_std_tokens('text')} AS t FROM documents)),
uni AS (SELECT term AS w, count(*) AS c FROM tk GROUP BY term),
nt AS (SELECT sum(c)::DOUBLE AS n FROM uni),
bi AS (SELECT a.term AS w1, b.term AS w2, count(*) AS c FROM tk a JOIN tk b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY 1, 2),
l0 AS (SELECT lookup_id, lt, regexp_matches(prefix, '\\s$') AS eb FROM (SELECT lookup_id, prefix, {sql_std_tokens('prefix')} AS lt FROM lk) WHERE len(lt) > 0),
l AS (SELECT lookup_id, CASE WHEN eb THEN lt[len(lt)] WHEN len(lt) > 1 THEN lt[len(lt) - 1] END AS prev,
             CASE WHEN eb THEN '' ELSE lt[len(lt)] END AS partial FROM l0),
bc AS (SELECT l.lookup_id, bi.w2 AS word, bi.c / uni.c AS score FROM l JOIN bi ON bi.w1 = l.prev JOIN uni ON uni.w = l.prev
       WHERE starts_with(bi.w2, l.partial)),
bt AS (SELECT lookup_id, word, score FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY round(score, 9) DESC, word) AS r FROM bc) WHERE r <= 3),
nb AS (SELECT lookup_id, count(*) AS nb FROM bt GROUP BY lookup_id),
uc AS (SELECT l.lookup_id, uni.w AS word, uni.c / nt.n * (CASE WHEN l.prev IS NULL THEN 1.0 ELSE 0.4 END) AS score
       FROM l JOIN uni ON starts_with(uni.w, l.partial) CROSS JOIN nt
       WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.lookup_id = l.lookup_id AND bt.word = uni.w)),
uf AS (SELECT uc.lookup_id, word, score FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY round(score, 9) DESC, word) AS r FROM uc) uc
       LEFT JOIN nb USING (lookup_id) WHERE r <= 3 - coalesce(nb.nb, 0)),
a AS (SELECT * FROM bt UNION ALL SELECT * FROM uf),
r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY round(score, 9) DESC, word) AS rank FROM a)
SELECT lookup_id, word, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def suggest_ngram(spark, sf_dir):
    """Free-text (bigram with unigram back-off 0.4) completion, top-3."""
    # unigram counts are the index's collection frequencies (same analyser)
    uni = doc_index(spark, sf_dir).term_stats.select(F.col("term").alias("w"), F.col("cf").alias("c"))
    bi = G.bigram_counts(tbl(spark, sf_dir, "documents"))
    r = G.suggest_ngram(uni, bi, lookups(spark, sf_dir), k=3)
    return r.select("lookup_id", "word", r6("score").alias("score"), F.col("rank").cast("long"))


@register("char_lm_counts", """
SELECT substr(g, 1, 3) AS context, substr(g, 4, 1) AS next, count(*)::BIGINT AS count FROM (
  SELECT unnest(list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4))) AS g
  FROM documents WHERE length(text) > 3) GROUP BY 1, 2""")
def char_lm_counts(spark, sf_dir):
    """Order-3 character model counts over every document."""
    c = G.char_lm_counts(tbl(spark, sf_dir, "documents"), n=3)
    return c.select("context", "next", F.col("count").cast("long"))


def _char_model(spark, sf_dir):
    return G.char_lm_table(G.char_lm_counts(tbl(spark, sf_dir, "documents"), n=3))


@register("suggest_char_lm")
def suggest_char_lm(spark, sf_dir):
    """Three sampled continuations (<= 40 chars) per lookup from the
    character model; weight = log-probability."""
    p = lookups(spark, sf_dir).select(F.col("lookup_id").alias("prompt_id"), F.col("prefix").alias("prompt"))
    s = G.sample_continuations(p, _char_model(spark, sf_dir), n=3, num=3, max_len=40)
    return s.select(F.col("prompt_id").alias("lookup_id"), F.col("sample").cast("long"),
                    F.col("text").alias("suggestion"), "logp")


@register("alt_queries")
def alt_queries(spark, sf_dir):
    """Three continuations of each benchmark passage + newline; the text
    after the first newline is the alternative query."""
    b = tbl(spark, sf_dir, "benchmark")
    p = b.select(F.col("item_id").alias("prompt_id"), F.concat(F.lower("text"), F.lit("\n")).alias("prompt"))
    s = G.sample_continuations(p, _char_model(spark, sf_dir), n=3, num=3, max_len=40, end="\n")
    return s.select(F.col("prompt_id").alias("query_id"), F.col("sample").cast("long"),
                    F.trim(F.col("text")).alias("alternative"), "logp")


def _diversify_sql() -> str:
    prefix = _REGISTRY["suggest_prefix"][1]
    return f"""WITH {SQL_WV},
sugg AS (SELECT lookup_id, entry, weight FROM ({prefix})),
each AS (SELECT *, string_split(entry, ' ') AS ws, unnest(range(1, len(string_split(entry, ' ')) + 1)) AS k FROM sugg),
nn AS (SELECT p.word, w2.word AS alt, list_cosine_similarity(w1.vector, w2.vector) AS sim
       FROM (SELECT DISTINCT ws[k] AS word FROM each) p JOIN wv w1 ON w1.word = p.word JOIN wv w2 ON w2.word <> p.word),
best AS (SELECT word, alt FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(sim, 9) DESC, alt) AS r FROM nn)
         WHERE r = 1 AND sim > 0.7),
rep AS (SELECT lookup_id, array_to_string(list_concat(ws[:k - 1], [alt], ws[k + 1:]), ' ') AS entry,
               floor(weight * 0.7::DOUBLE)::BIGINT AS weight FROM each JOIN best ON best.word = ws[k])
SELECT lookup_id, entry, weight FROM sugg UNION SELECT lookup_id, entry, weight FROM rep"""


@register("suggest_diversify", _diversify_sql())
def suggest_diversify(spark, sf_dir):
    """Each prefix suggestion plus, for each of its words, a copy with that word replaced by its nearest
    word-vector neighbour (similarity above 0.7), weight × 0.7 truncated."""
    from quarry.plans.vectors import _nearest_other

    sugg = suggest_prefix(spark, sf_dir).select("lookup_id", "entry", "weight")
    parts = F.split("entry", " ")
    each = sugg.select("*", F.posexplode(parts).alias("at", "part"))
    nn = _nearest_other(spark, sf_dir, each.select(F.col("part").alias("word")).distinct(), 1).filter(
        F.col("similarity") > 0.7).select(F.col("query_id").alias("part"), F.col("word").alias("alt"))
    swapped = F.transform(parts, lambda w, i: F.when(i == F.col("at"), F.col("alt")).otherwise(w))
    rep = each.join(nn, "part").select("lookup_id", F.array_join(swapped, " ").alias("entry"),
                                       F.floor(F.col("weight") * 0.7).cast("long").alias("weight"))
    return sugg.unionByName(rep).distinct()
