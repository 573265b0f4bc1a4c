"""Merkle fixity audit of WARC replicas.

A replica is a table of records ``warc, offset, record``. Each record is hashed with its offset and length; record
hashes are hashed in order over fixed byte ranges of the file, and ranges over 16 ranges of the level below, up to one
root per file. Replicas build their trees on their own. The audit joins the roots, and at each level joins only the
children of ranges that differ, so that sound files cost one comparison and damage is found without reading the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, stage

#: Bytes of a file that one lowest range covers, ranges under one node, and the size at which a file is closed.
RANGE_BYTES = 1 << 16
FAN_OUT = 16
FILE_BYTES = 1 << 24


def warc_record(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record as binary; null url and payload count as empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:quarry:"), record_id,
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Lays the records of ``pages`` (``page_id, url, html``) into files: ``warc, offset, length, page_id, record``.

    Every task fills files of its own and closes one once it has ``file_bytes``; nothing is shuffled. Repeated rows
    and null ids become records like any other; record ids need not be unique. An empty table gives no files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), warc_record(
        F.col("url"), F.col("html"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))).alias("record"))

    def run(batches):
        part, number, at = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = pc.binary_length(b.column("record")).to_numpy(zero_copy_only=False).astype(np.int64)
            files, offsets = [], []
            for n in size.tolist():
                if at >= file_bytes:
                    number, at = number + 1, 0
                files.append(f"part-{part:06d}-{number:06d}.warc")
                offsets.append(at)
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(size), b.column("page_id"),
                 b.column("record").cast(pa.binary())], ["warc", "offset", "length", "page_id", "record"])

    return rows.mapInArrow(run, "warc string, offset long, length long, page_id long, record binary")


def leaves(replica: DataFrame) -> DataFrame:
    """``warc, offset, digest`` of a replica's records; repeated rows of one record are one leaf."""
    place = F.concat_ws(":", F.col("offset").cast("string"), F.octet_length("record").cast("string"), F.lit(""))
    return replica.select("warc", "offset", F.sha2(F.concat(
        place.cast("binary"), F.coalesce("record", F.lit("").cast("binary"))), 256).alias("digest"))


def reach(*leaf: DataFrame) -> int:
    """The greatest offset of any replica, which fixes the height of their trees (-1 without records)."""
    tops = [x.agg(F.max("offset")).first()[0] for x in leaf]
    return max((t for t in tops if t is not None), default=-1)


def tree(leaf: DataFrame, longest: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``level, warc, idx, digest`` of every node above the leaves; the root of a file is its highest level.

    All files get the same number of levels, as many as offset ``longest`` needs. A node has at most ``FAN_OUT`` children,
    and the lowest range holds as many records as fit its bytes.
    """
    def node(rows: DataFrame, key: Column) -> DataFrame:
        return (rows.groupBy("warc", F.floor(key).alias("idx"))
                .agg(F.sort_array(F.collect_set(F.struct("at", "digest"))).alias("c"))
                .select("warc", "idx", F.sha2(F.array_join(F.transform(
                    "c", lambda x: F.concat(x["at"].cast("string"), F.lit("="), x["digest"])), "\n"), 256)
                    .alias("digest")))

    level = node(leaf.withColumnRenamed("offset", "at"), F.col("at") / range_bytes)
    out, top, number = level.select(F.lit(0).alias("level"), "*"), longest // range_bytes, 0
    while top > 0:  # -1 without any record
        level = node(level.withColumnRenamed("idx", "at"), F.col("at") / FAN_OUT)
        top, number = top // FAN_OUT, number + 1
        out = out.unionByName(level.select(F.lit(number).alias("level"), "*"))
    return out


def _differ(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of either side without an equal one on the other: ``warc, key, da, db``."""
    x = a.select("warc", key, F.col("digest").alias("da"))
    y = b.select("warc", key, F.col("digest").alias("db"))
    return x.join(y, ["warc", key], "full_outer").filter(~F.col("da").eqNullSafe(F.col("db")))


def audit(leaf_a: DataFrame, leaf_b: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Damaged records: ``warc, offset, status, digest_a, digest_b``; ``a`` is the replica of reference.

    Status is ``changed``, ``missing`` (not in ``b``) or ``extra`` (only in ``b``). Leaves come from :func:`leaves`.
    """
    longest = reach(leaf_a, leaf_b)
    ta, tb = (stage(tree(x, longest, range_bytes), "tree") for x in (leaf_a, leaf_b))
    top, width = 0, longest // range_bytes
    while width > 0:
        top, width = top + 1, width // FAN_OUT
    bad = stage(_differ(*(t.filter(F.col("level") == top) for t in (ta, tb)), "idx"), "differ")
    for level in range(top - 1, -1, -1):
        under = broadcast_if_small(bad.select(F.col("warc").alias("w"), F.col("idx").alias("p")), 64)
        below = [t.filter(F.col("level") == level).join(
            under, (F.col("warc") == F.col("w")) & (F.floor(F.col("idx") / FAN_OUT) == F.col("p")), "left_semi")
            for t in (ta, tb)]
        bad = stage(_differ(*below, "idx"), "differ")
    bad = bad.select(F.col("warc").alias("w"), F.col("idx").alias("p"))
    bad = broadcast_if_small(bad, 64)
    a, b = (t.join(bad, (t["warc"] == F.col("w")) & (F.floor(t["offset"] / range_bytes) == F.col("p")), "left_semi")
            for t in (leaf_a, leaf_b))
    # the records of the differing ranges alone
    status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("changed")
    return (_differ(a.distinct(), b.distinct(), "offset")
            .select("warc", "offset", status.alias("status"), F.col("da").alias("digest_a"), F.col("db").alias("digest_b")))


def roots(t: DataFrame) -> DataFrame:
    """``warc, root`` from a tree."""
    top = t.agg(F.max("level").alias("top"))
    return t.join(F.broadcast(top), F.col("level") == F.col("top")).select("warc", F.col("digest").alias("root"))
