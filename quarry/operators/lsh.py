"""Min-hash sketches and locality-sensitive search.

A sketch holds ``buckets`` values per document: every shingle is hashed
(first 32 bits of its md5), lands in bucket ``h mod buckets`` and each bucket
keeps its minimum; an empty bucket takes the value of the next filled bucket
(cyclically) — "rotation". The per-bucket minimum is one aggregation keyed by
``(id, bucket)`` after the hashes were shuffled once by id; rotation then runs
inside the row over at most ``buckets`` entries.

The index is the long table ``(id, bucket, hash)``. A search joins the
(size-checked, broadcast) query sketches to it on ``(bucket, hash)`` and counts
matches per pair — queries against the index, never the index against itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import top_k
from quarry.session import checked_broadcast

DEFAULT_BUCKETS = 512


def hash32(c) -> Column:
    """First 32 bits of md5 as a non-negative bigint (same value in any engine with md5)."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def minhash_entries(df: DataFrame, id_col: str, shingles_col: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``(id, entries)``: sorted ``array<struct<bucket,h>>`` of per-bucket minima.

    A document's hashes are shuffled once, as one row; both aggregations run where they lie.
    """
    hashed = df.select(id_col, F.transform(F.array_distinct(shingles_col), hash32).alias("_h")).repartition(id_col)
    ex = hashed.select(id_col, F.explode_outer("_h").alias("h")).filter(F.col("h").isNotNull())
    mins = (ex.groupBy(id_col, F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.min("h").alias("h")))
    return mins.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("bucket", "h"))).alias("entries"))


def rotate(entries: Column, buckets: int = DEFAULT_BUCKETS) -> Column:
    """Dense ``array<bigint>`` of ``buckets`` values with rotation fill.

    Entry i (bucket b_i) covers buckets (b_{i-1}, b_i]; buckets after the
    last filled one wrap round to the first entry.
    """
    first = F.element_at(entries, 1)["h"]
    last_b = F.element_at(entries, -1)["bucket"]
    segs = F.transform(entries, lambda e, i: F.array_repeat(
        e["h"], (e["bucket"] - F.when(i == 0, F.lit(-1)).otherwise(F.element_at(entries, i)["bucket"])).cast("int")))
    tail = F.array_repeat(first, (F.lit(buckets - 1) - last_b).cast("int"))
    return F.when(F.size(entries) > 0, F.concat(F.flatten(segs), tail)).otherwise(F.array().cast("array<bigint>"))


def sketch(df: DataFrame, id_col: str, shingles_col: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``(id, n_filled, sketch array<bigint>)``; rows without shingles are absent."""
    e = minhash_entries(df, id_col, shingles_col, buckets)
    return e.select(id_col, F.size("entries").alias("n_filled"), rotate(F.col("entries"), buckets).alias("sketch"))


def sketch_long(sk: DataFrame, id_col: str) -> DataFrame:
    """The LSH index: ``(id, bucket, hash)``."""
    return sk.select(id_col, F.posexplode_outer("sketch").alias("bucket", "hash")).filter(F.col("bucket").isNotNull())


def lsh_search(index_long: DataFrame, query_long: DataFrame, id_col: str, k: int = 10,
               min_should_match: int | None = None) -> DataFrame:
    """L3 (+Q5, Q6): score = number of (bucket, hash) tokens shared with the query."""
    q = checked_broadcast(query_long.select("query_id", "bucket", "hash"))
    m = index_long.join(q, ["bucket", "hash"]).groupBy("query_id", id_col).agg(
        F.count(F.lit(1)).cast("double").alias("score"))
    if min_should_match is not None:
        m = m.filter(F.col("score") >= min_should_match)
    return top_k(m, k, id_col=id_col)


def band_size(num_hash: int, similarity: float, expected_true_positive: float) -> int:
    """L4: rows per band — for bands = 1..n the first whose true-positive rate
    ``1 - (1 - s^(n div bands))^bands`` exceeds the target; else 1."""
    for bands in range(1, num_hash + 1):
        rows = num_hash // bands
        if 1 - math.pow(1 - math.pow(similarity, rows), bands) > expected_true_positive:
            return rows
    return 1


def band_size_col(num_hash: Column, similarity: Column, etp: Column) -> Column:
    """L4 as a Column expression (per-row parameters)."""
    cands = F.filter(F.sequence(F.lit(1), num_hash), lambda b: (
        F.lit(1.0) - F.pow(F.lit(1.0) - F.pow(similarity, F.floor(num_hash / b)), b)) > etp)
    return F.coalesce(F.floor(num_hash / F.element_at(cands, 1)), F.lit(1)).cast("long")


def band_keys(sketch_col: Column, rows: int) -> Column:
    """One md5 key per band of ``rows`` hashes; the last incomplete band is
    padded by wrapping round from the first hashes."""
    n = F.size(sketch_col)
    n_bands = F.ceil(n / F.lit(rows)).cast("int")
    padded = F.concat(sketch_col, F.slice(sketch_col, 1, F.lit(rows)))
    return F.transform(F.sequence(F.lit(0), n_bands - 1), lambda b: F.md5(F.array_join(
        F.slice(padded, b * rows + 1, rows).cast("array<string>"), ",")))


def banded_search(index_sk: DataFrame, query_sk: DataFrame, id_col: str, rows: int, k: int = 10) -> DataFrame:
    """A document matches when a whole band equals the query's; score =
    number of equal bands; top-k."""
    ib = (index_sk.select(id_col, F.posexplode_outer(band_keys(F.col("sketch"), rows)).alias("band", "key"))
          .filter(F.col("band").isNotNull()))
    qb = checked_broadcast(query_sk.select("query_id", F.posexplode_outer(band_keys(F.col("sketch"), rows))
                                           .alias("band", "key")).filter(F.col("band").isNotNull()))
    m = ib.join(qb, ["band", "key"]).groupBy("query_id", id_col).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return top_k(m, k, id_col=id_col)
