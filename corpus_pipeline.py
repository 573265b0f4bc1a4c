"""Corpus pipeline: quality rules, near-duplicate removal, substring deduplication, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on everything its predecessor kept and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` writes each stage as Parquet into the cluster's shared folder and
reads it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import neardup, packing, quality, spans
from quarry.llm.common import stage, unstage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the certified cutoffs reject."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at similarity 0.8 on five-word shingles."""
    return neardup.keep_one(docs, k=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts sentence spans that occur earlier in the corpus; documents left without a word go."""
    cut = spans.dedup_spans(docs, report=False)
    cut = cut.filter(F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all remaining documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicate removal", near_dedup),
          ("substring deduplication", substring_dedup), ("best-fit packing", best_fit_packing)]

#: Certified cutoffs, near-duplicate groups and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        out = stage(step(spark, docs, sf_dir), f"pipeline-{i}")
        if i:
            unstage(docs)
        docs = out
    return docs
