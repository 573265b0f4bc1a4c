"""Ranking functions as per-term Column expressions.

A similarity maps the statistics of one matching (query term, document) pair to
that term's contribution; a document's score is the sum over matching query
terms. Statistics columns (all double):

    tf       term frequency in the document
    df       number of documents holding the term
    cf       total occurrences of the term in the collection
    dl       document length in tokens
    n_docs   documents with at least one token in the field
    avgdl    sum_ttf / n_docs
    sum_ttf  total tokens in the field
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAT_COLUMNS = ("tf", "df", "cf", "dl", "n_docs", "avgdl", "sum_ttf")


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def classic(idf_power: float = 2.0) -> Column:
    """sqrt(tf) * idf^p / sqrt(dl), idf = 1 + ln((N+1)/(df+1))."""
    idf = F.lit(1.0) + F.log((_c("n_docs") + 1.0) / (_c("df") + 1.0))
    return F.sqrt(_c("tf")) * F.pow(idf, F.lit(float(idf_power))) / F.sqrt(_c("dl"))


def bm25(k1: float = 1.2, b: float = 0.75) -> Column:
    """R2: ln(1 + (N - df + .5)/(df + .5)) * tf (k1+1) / (tf + k1 (1 - b + b dl/avgdl))."""
    idf = F.log(F.lit(1.0) + (_c("n_docs") - _c("df") + 0.5) / (_c("df") + 0.5))
    norm = F.lit(float(k1)) * (F.lit(1.0 - b) + F.lit(float(b)) * _c("dl") / _c("avgdl"))
    return idf * _c("tf") * F.lit(k1 + 1.0) / (_c("tf") + norm)


def _collection_p() -> Column:
    return (_c("cf") + 1.0) / (_c("sum_ttf") + 1.0)


def lm_jelinek_mercer(lam: float = 0.1) -> Column:
    """ln(1 + ((1-λ) tf/dl) / (λ p)), p = (cf+1)/(sum_ttf+1)."""
    return F.log(F.lit(1.0) + (F.lit(1.0 - lam) * _c("tf") / _c("dl")) / (F.lit(float(lam)) * _collection_p()))


def lm_dirichlet(mu: float = 2000.0) -> Column:
    """max(0, ln(1 + tf/(μ p)) + ln(μ/(dl+μ)))."""
    s = (F.log(F.lit(1.0) + _c("tf") / (F.lit(float(mu)) * _collection_p()))
         + F.log(F.lit(float(mu)) / (_c("dl") + F.lit(float(mu)))))
    return F.greatest(s, F.lit(0.0))


def tfidf_weight(tf="tf", df="df", n_docs="n_docs") -> Column:
    """1 + ln(tf) * ln(N/df) (exactly this precedence)."""
    tf, df, n = (F.col(x).cast("double") if isinstance(x, str) else x for x in (tf, df, n_docs))
    return F.lit(1.0) + F.log(tf) * F.log(n / df)


SIMILARITIES = {
    "classic": classic,
    "bm25": bm25,
    "lm_jm": lm_jelinek_mercer,
    "lm_dirichlet": lm_dirichlet,
}


def similarity(name: str, **params) -> Column:
    """Per-term contribution for a named similarity ("a+b" sums several, R5)."""
    parts = [p.strip() for p in name.split("+")]
    exprs = []
    for p in parts:
        if p not in SIMILARITIES:
            raise ValueError(f"unknown similarity {p!r}; known: {sorted(SIMILARITIES)}")
        own = params.get(p, params if len(parts) == 1 else {})
        exprs.append(SIMILARITIES[p](**own))
    out = exprs[0]
    for e in exprs[1:]:
        out = out + e
    return out
