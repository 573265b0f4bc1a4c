"""Helpers that the operators of this subpackage share: staging, checked broadcasts, hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

#: A side is broadcast only if its rows, at the given width, stay under this many bytes.
BROADCAST_BYTES = 48 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage with a table that outlives any executor, so a retried task reads the same rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, n_rows: int | None = None) -> DataFrame:
    """Broadcast hint if ``n_rows * row_bytes`` is within the bound; otherwise the join shuffles."""
    n = df.count() if n_rows is None else n_rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element, wrapping."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def one_by_one(column):
    """The values of an Arrow column as Python objects, made one at a time, so that a batch is not held twice."""
    for x in column:
        yield x.as_py()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as set them apart from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]
