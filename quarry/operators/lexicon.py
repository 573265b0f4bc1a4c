"""Character-level word similarity (V17) as a join over bigram 'postings'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import top_k
from quarry.session import checked_broadcast


def bigrams(words: DataFrame, col: str = "word") -> DataFrame:
    """``(word, bigram, c)``: character bigram counts per word."""
    b = words.select(col, F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 1, F.lit(1))),
                                                lambda i: F.substring(F.col(col), i, 2))).alias("bigram"))
    b = b.filter(F.length("bigram") == 2)  # also drops the null row of explode_outer
    return b.groupBy(col, "bigram").agg(F.count(F.lit(1)).alias("c"))


def similar_by_bigrams(queries: DataFrame, vocab: DataFrame, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """Top-k vocabulary words (≠ the query word) with bigram-count cosine >= threshold.

    The vocabulary is dealt by word once; a word's bigrams stay with it, so pairs are summed and cut where they arise.
    """
    vb = bigrams(vocab.select("word").repartition("word"))
    qb = checked_broadcast(bigrams(queries))
    vn = vb.groupBy("word").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("vn"))
    qn = qb.groupBy("word").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("qn"))
    s = (vb.withColumnRenamed("c", "vc").join(qb.select(F.col("word").alias("query_word"), "bigram",
                                                        F.col("c").alias("qc")), "bigram")
         .filter(F.col("word") != F.col("query_word"))
         .groupBy("query_word", "word").agg(F.sum(F.col("vc") * F.col("qc")).alias("dot")))
    c = (s.join(vn, "word").join(checked_broadcast(qn.withColumnRenamed("word", "query_word")), "query_word")
         .select("query_word", F.col("word").alias("similar"), (F.col("dot") / (F.col("qn") * F.col("vn"))).alias("similarity"))
         .filter(F.col("similarity") >= threshold))
    return top_k(c, k, score_col="similarity", group_col="query_word", id_col="similar")
