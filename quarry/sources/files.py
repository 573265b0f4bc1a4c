"""S5, S6, S8, S9, S10 readers and K1, K3, K6 writers."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an order key ``(file, block_start, line_in_block)``
    — the order of the file even when its splits are read by several tasks."""
    d = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("_mid"))
    return d.select("file", "block_start", "_mid", F.col("value").alias("line"))


def read_delimited(spark: SparkSession, path: str, columns=(0, 4), names=None, header: bool = True,
                   multi_line: bool = False) -> DataFrame:
    """A real CSV reader (quotes, embedded commas), keeping the given column positions.

    Doubled quotes are read as the sink writes them. Files split over tasks unless ``multi_line`` fields are allowed.
    """
    d = (spark.read.option("header", str(header).lower()).option("multiLine", str(multi_line).lower())
         .option("escape", '"').csv(path))
    cols = [d.columns[i] for i in columns]
    names = names or cols
    return d.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Bilingual dictionary lines ``"src tgt"`` → ``(source, target)``."""
    p = F.split(F.col("value"), " ", 2)
    return (spark.read.text(path).select(F.element_at(p, 1).alias("source"), F.element_at(p, 2).alias("target"))
            .filter(F.col("target").isNotNull()))


def read_embedding_file(spark: SparkSession, path: str) -> DataFrame:
    """Embedding text files → ``(label, vector)``; the first line of a file may be its header."""
    lines = read_lines(spark, path)
    first = lines.groupBy("file").agg(F.min(F.struct("block_start", "_mid")).alias("s")).select(
        F.col("file").alias("_f"), F.col("s._mid").alias("_first"))
    at = lines.join(first, F.col("file") == F.col("_f")).withColumn("_head", F.col("_mid") == F.col("_first"))
    return parse_embedding_lines(at, "line", "_head")


def parse_embedding_lines(lines: DataFrame, col: str = "value", first_col: str | None = None) -> DataFrame:
    """``label v1 v2 …`` lines → ``(label, vector array<double>)``; labels
    with a ``B64:`` prefix are base64-decoded. A header line ``NUM_WORDS VECTOR_SIZE NUM_DOCS`` (three integers) is
    dropped where ``first_col`` marks the first line of a file; without positions, where its VECTOR_SIZE is the size of the
    frame's vectors. Elsewhere such a line is a vector."""
    f = F.split(F.trim(F.col(col)), " ")
    is_header = (F.size(f) == 3) & F.forall(f, lambda x: x.rlike("^[0-9]+$"))
    if first_col:
        is_header = is_header & F.col(first_col)
    else:
        size = lines.agg(F.max(F.size(f))).first()[0] or 0
        is_header = is_header & (F.element_at(f, 2) == F.lit(str(size - 1)))
    raw = F.element_at(f, 1)
    label = F.when(raw.startswith("B64:"), F.unbase64(F.substring(raw, 5, 1 << 30)).cast("string")).otherwise(raw)
    vec = F.transform(F.slice(f, 2, F.size(f) - 1), lambda x: x.cast("double"))
    return lines.filter((F.length(F.trim(F.col(col))) > 0) & ~is_header).select(label.alias("label"), vec.alias("vector"))


def embedding_lines(vectors: DataFrame, label_col: str = "label", vec_col: str = "vector") -> DataFrame:
    """Writer side of S9: one ``label v1 v2 …`` line per vector (labels with a
    blank are base64-encoded behind ``B64:``)."""
    lab = F.col(label_col).cast("string")
    lab = F.when(lab.contains(" "), F.concat(F.lit("B64:"), F.base64(lab.cast("binary")))).otherwise(lab)
    vals = F.array_join(F.transform(F.col(vec_col), lambda x: x.cast("double").cast("string")), " ")
    return vectors.select(F.concat_ws(" ", lab, vals).alias("value"))


@pandas_udf(ArrayType(DoubleType()))
def decode_vectors(b: pd.Series) -> pd.Series:
    """Big-endian float64 bytes → double array; one byte swap over all vectors of an Arrow batch."""
    ok = b.notna().to_numpy()
    sizes = np.array([len(x) // 8 for x in b[ok]], dtype=np.int64)
    flat = np.frombuffer(b"".join(b[ok]), dtype=">f8").astype(np.float64)
    out = pd.Series([None] * len(b), dtype=object)
    out[ok] = pd.Series(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], index=out.index[ok], dtype=object)
    return out


@pandas_udf(BinaryType())
def encode_vectors(v: pd.Series) -> pd.Series:
    """Writer side of S10: double array → big-endian float64 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype=">f8").tobytes())


def append_batches(docs: DataFrame, root: str, batch_col: str = "batch_id") -> DataFrame:
    """K1/K2: append documents to an index folder, one commit (partition) per
    batch, in one distributed write; a replayed batch overwrites only its own
    partition. Returns ``(batch_id, n_docs)`` read back from storage."""
    spark = docs.sparkSession
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(root)
    return spark.read.parquet(root).groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_docs"))


def append_commits(docs: DataFrame, root: str, batch_col: str = "batch_id") -> DataFrame:
    """K1/K2: like :func:`append_batches`, but one commit after the other, each counted and timed while it is written.

    Returns ``(batch_id, n_docs, seconds)``, one row per commit; the count comes from the write itself, not from a scan.
    """
    spark, rows = docs.sparkSession, []
    for r in docs.select(batch_col).distinct().orderBy(batch_col).toLocalIterator():  # one row per commit
        seen, began = Observation(), time.monotonic()
        (docs.filter(F.col(batch_col) == r[0]).observe(seen, F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col).parquet(root))
        rows.append((r[0], seen.get["n"], time.monotonic() - began))
    kind = docs.schema[batch_col].dataType.simpleString()
    return spark.createDataFrame(rows, f"`{batch_col}` {kind}, n_docs long, seconds double")


def write_results_csv(results: DataFrame, path: str, strip_commas: tuple[str, ...] = ()) -> None:
    """K3: CSV sink, overwrite; proper quoting (multi-line fields survive). Commas go from the named columns."""
    results = results.withColumns({c: F.regexp_replace(c, ",", "") for c in strip_commas}) if strip_commas else results
    results.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def upsert(puts: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """K6: last write wins per key — ``max_by(value, version)`` as one aggregation."""
    return puts.groupBy(key).agg(F.max_by(F.col(value), F.col(version)).alias(value),
                                 F.max(version).alias(version))
