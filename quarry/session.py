"""Session construction and small plan helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, NumericType, StringType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# A side is small enough to ship to every executor under both bounds: rows, and bytes at the width of its types. The
# driver holds it about four times, as rows, serialised, as a hash table and in blocks.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Session tuned for the operators: AQE with skew splitting, no UI, UTC."""
    master = master or os.environ.get("QUARRY_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # explode() otherwise gets an inferred size(...) > 0 filter pushed below
         # the projection, which re-evaluates analysers per row (see tokenize)
         .config("spark.sql.optimizer.excludedRules",
                 "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
         .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A private folder is made only where the setting is unset and the master is local, as in tests; on a cluster an
    unset folder is an error, since driver and executors would write to different machines.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` only when its rows and their bytes are proven to be within the bounds.

    Rows and widths are counted by one partial aggregate; no rows meet in one task. Beyond a bound the frame is
    returned unhinted and the join falls back to a shuffle join (AQE may still convert it at run time).
    """
    n, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def _row_bytes(df: DataFrame):
    """About how many bytes a row takes in memory: fixed types by width, strings and arrays by length."""
    total = F.lit(16)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            width = F.octet_length(c) + 8
        elif isinstance(f.dataType, ArrayType):
            each = 8 if isinstance(f.dataType.elementType, NumericType) else 48
            width = F.size(c) * each + 16
        else:
            width = F.lit(8 if isinstance(f.dataType, NumericType) else 64)
        total = total + F.coalesce(width, F.lit(8)).cast("long")
    return total


def load_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    names = names or TABLES
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
