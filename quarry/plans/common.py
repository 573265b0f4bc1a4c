"""Shared inputs of the registered queries: tables, cached indexes, SQL pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import ENGLISH_STOP_WORDS, WORD_RE
from quarry.operators.index import Index, query_terms

_INDEX_CACHE: dict = {}


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_index(spark: SparkSession, sf_dir: str, analyzer: str = "standard",
              positions: bool = False) -> Index:
    """Index over ``documents.text``, built once per session and reused."""
    key = (spark.sparkContext.applicationId, sf_dir, analyzer, positions)
    idx = _INDEX_CACHE.get(key)
    if idx is None:
        idx = Index.build(tbl(spark, sf_dir, "documents"), analyzer=analyzer, with_positions=positions)
        _INDEX_CACHE[key] = idx
    return idx


def bench_terms(spark: SparkSession, sf_dir: str, analyzer: str = "standard") -> DataFrame:
    """Query terms of the benchmark passages, whole text: ``(query_id, term, qtf)``."""
    return query_terms(tbl(spark, sf_dir, "benchmark"), "text", "item_id", analyzer)


def r6(c) -> F.Column:
    """Round a computed double for cross-engine comparison."""
    return F.round(c.cast("double") if not isinstance(c, str) else F.col(c).cast("double"), 6)


# ---- SQL pieces (DuckDB) ---------------------------------------------------
def sql_std_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '{WORD_RE}')"


SQL_STOP_EN = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]"

# Index over documents.text with the standard analyser.
SQL_INDEX = f"""
toks AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos
         FROM (SELECT doc_id, {sql_std_tokens('text')} AS t FROM documents)),
post AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM toks GROUP BY doc_id, term),
dls AS (SELECT doc_id, count(*)::DOUBLE AS dl FROM toks GROUP BY doc_id),
ts AS (SELECT term, count(*)::DOUBLE AS df, sum(tf) AS cf FROM post GROUP BY term),
fs AS (SELECT count(*)::DOUBLE AS n_docs, sum(dl) AS sum_ttf, sum(dl) / count(*) AS avgdl FROM dls),
m AS (SELECT post.doc_id, post.term, post.tf, dls.dl, ts.df, ts.cf, fs.n_docs, fs.sum_ttf, fs.avgdl
      FROM post JOIN dls USING (doc_id) JOIN ts USING (term) CROSS JOIN fs)"""

SQL_BENCH_TERMS = f"""
qt AS (SELECT query_id, term, count(*)::DOUBLE AS qtf
       FROM (SELECT item_id AS query_id, unnest({sql_std_tokens('text')}) AS term FROM benchmark)
       GROUP BY query_id, term)"""


def sql_bm25(k1=1.2, b=0.75) -> str:
    return (f"ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {k1 + 1.0} / "
            f"(tf + {k1} * ({1.0 - b} + {b} * dl / avgdl))")


def sql_classic(p=2.0) -> str:
    return f"sqrt(tf) * pow(1 + ln((n_docs + 1) / (df + 1)), {p}) / sqrt(dl)"


def sql_lm_jm(lam=0.1) -> str:
    return f"ln(1 + ({1.0 - lam} * tf / dl) / ({lam} * (cf + 1) / (sum_ttf + 1)))"


def sql_lm_dirichlet(mu=2000.0) -> str:
    return (f"greatest(ln(1 + tf / ({mu} * (cf + 1) / (sum_ttf + 1))) + ln({mu} / (dl + {mu})), 0.0)")


def sql_topk(scored_cte: str, k: int, group: str = "query_id", idc: str = "doc_id",
             score: str = "score") -> str:
    """Ranks rows of ``scored_cte`` like :func:`quarry.operators.search.top_k`."""
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY round({score}, 9) DESC, "
            f"{idc}) AS rank FROM {scored_cte}) WHERE rank <= {k})")
