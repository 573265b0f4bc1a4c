"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is cut into words. Its grams are the words and word pairs (A-Z lower-cased), the shapes of one to three words
(letters, capitals and digits stand for their kind, runs fold to one, all marks stay), the pairs that repeat what came
before, and the order of the text's length. Every gram is hashed into one of ``2**BITS`` coordinates; within a family
of grams the value is the square root of the gram's share, so each family is a unit vector whatever the length.

Training is FTRL-proximal, one document at a time, with per-coordinate rates. The training rows are dealt into
``SHARDS`` shards by a hash of their content; every epoch all shards start from the same state, and their changes of
``(z, n)`` are averaged per coordinate by a grouped sum of fixed-point numbers, which has one result in any order.
The model is a vector of ``2**BITS`` numbers at any corpus size; a score is one sparse dot product in a scan.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix64, one_by_one, stage, unstage

BITS = 18
SHARDS = 8
EPOCHS = 4
#: Most labelled rows that are trained on; of more, an equal share of all is taken by a hash of the row.
MAX_TRAINING_ROWS = 16_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 0.1
CUTOFF = 0.7
#: Rows whose id leaves this remainder are never learned from.
HELD_OUT, FOLDS = 2, 4
_FIXED = float(1 << 32)
_SPREAD = 0x9E3779B97F4A7C15
#: Bytes to their kind: lower-case and all non-ASCII letters, capitals, digits; anything else stands for itself.
_KIND = bytes(ord("a") if 97 <= c < 123 or c >= 128 else ord("A") if 65 <= c < 91 else ord("0") if 48 <= c < 58 else c
              for c in range(256))
_RUN = re.compile(rb"([aA0])\1+")


def _hashes(words: list[bytes]) -> np.ndarray:
    code, uniq = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(uniq, categorize=False)[code]


def grams(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a whole text; the constant gram comes last and is all that an empty text has."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.lower().split()  # bytes: A-Z and the six ASCII separators
    n = len(words)
    where, value = [], []

    def add(family: int, found: np.ndarray) -> None:
        if len(found):
            slot = mix64(found + np.uint64(family * _SPREAD & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)
            u, c = np.unique(slot, return_counts=True)
            where.append(u.astype(np.int64))
            value.append(np.sqrt(c / n))

    if n:
        w, s = _hashes(words), _hashes(_RUN.sub(rb"\1", data.translate(_KIND)).split())
        pairs, shape_pairs = mix64(w[:-1]) + w[1:], mix64(s[:-1]) + s[1:]
        add(1, w)
        add(2, pairs)
        add(3, s)
        add(4, shape_pairs)
        add(5, mix64(shape_pairs[:-1]) + s[2:])
        again = [int((w[1:] == w[:-1]).sum()), int((w[2:] == w[:-2]).sum()),
                 n - len(np.unique(w)), len(pairs) - len(np.unique(pairs))]
        add(6, np.repeat(np.arange(4, dtype=np.uint64), again))
        where.append((mix64(np.array([n.bit_length()], np.uint64)) >> np.uint64(64 - bits)).astype(np.int64))
        value.append(np.ones(1))
    where.append(np.zeros(1, np.int64))
    value.append(np.ones(1))
    return np.concatenate(where), np.concatenate(value)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights for the state ``(z, n)``; coordinates with ``|z| <= L1`` are zero."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, where: np.ndarray, value: np.ndarray, label: int) -> None:
    """One FTRL update of the state, in place. Coordinates that two families share are updated by their sum."""
    if len(np.unique(where)) < len(where):
        where, slot = np.unique(where, return_inverse=True)
        value = np.bincount(slot, value)
    w = weights(z[where], n[where])
    g = (probability(w @ value) - label) * value
    new = n[where] + g * g
    z[where] += g - (np.sqrt(new) - np.sqrt(n[where])) / ALPHA * w
    n[where] = new


def probability(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def held_out():
    """Whether a row's label must stay unseen; a row without an id has no label."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """``shard, turn, text, good`` of at most about ``max_rows`` labelled rows that are not held out.

    An id labelled both ways counts by its majority and is left out on a tie; labels other than 0 and 1 are ignored.
    Rows that repeat an id and a text are learned once.
    """
    marks = (labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id"))
             .agg(F.avg("quality").alias("share")).filter("share <> 0.5"))
    known = (docs.filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(marks, F.col("doc_id") == F.col("label_id")))
    n = known.count()
    turn = F.xxhash64("doc_id", "text")
    share = min(1.0, max_rows / max(n, 1))
    return (known.select("text", (F.col("share") > 0.5).cast("int").alias("good"), turn.alias("turn"))
            .filter(F.pmod("turn", F.lit(1 << 20)) < int(share * (1 << 20)))
            .groupBy("turn", F.xxhash64(F.lit(1), "text").alias("copy")).agg(F.first("text").alias("text"),
                                                                           F.max("good").alias("good"))
            .select(F.pmod(F.xxhash64(F.lit(2), "turn"), F.lit(SHARDS)).cast("int").alias("shard"), "turn", "text",
                    "good"))


def train(rows: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` over the output of :func:`training_rows`; the same for any partitioning of it."""
    rows = stage(rows, "training")
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for epoch in range(epochs):
        state = rows.sparkSession.sparkContext.broadcast((z, n))

        def run(batches, state=state, epoch=epoch):
            shard, own = None, None
            for b in batches:
                for k, text, good in zip(b.column("shard").to_pylist(), one_by_one(b.column("text")),
                                         b.column("good").to_pylist(), strict=True):
                    if k != shard:
                        if own:
                            yield changes(state.value, own)
                        shard, own = k, tuple(x.copy() for x in state.value)
                    learn(*own, *grams(text, bits), good)
            if own:
                yield changes(state.value, own)

        order = F.xxhash64(F.lit(epoch), "turn")
        dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", order, "turn", "text")
        moved = (dealt.select("shard", "text", "good").mapInArrow(run, "slot int, dz long, dn long")
                 .groupBy("slot").agg(F.sum("dz").alias("dz"), F.sum("dn").alias("dn")).toPandas())
        at = moved["slot"].to_numpy(np.int64)
        z[at] += moved["dz"].to_numpy(np.float64) / _FIXED / SHARDS
        n[at] += moved["dn"].to_numpy(np.float64) / _FIXED / SHARDS
        state.unpersist()
    unstage(rows)
    return weights(z, n)


def changes(old: tuple, new: tuple) -> pa.RecordBatch:
    """What a shard changed, as fixed-point numbers whose sums do not depend on their order."""
    at = np.flatnonzero((old[0] != new[0]) | (old[1] != new[1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), *(pa.array(np.rint((b[at] - a[at]) * _FIXED).astype(np.int64))
                                          for a, b in zip(old, new, strict=True))], ["slot", "dz", "dn"])


def score(docs: DataFrame, model: np.ndarray, cutoff: float = CUTOFF) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``, from the whole text alone."""
    bits = len(model).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = shared.value
        for b in batches:
            found = np.empty(b.num_rows)
            for i, text in enumerate(one_by_one(b.column("text"))):
                where, value = grams(text, bits)
                found[i] = probability(w[where] @ value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found),
                                              pa.array((found >= cutoff).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Trains on the labelled rows of ``docs`` that are not held out and scores every row.

    Null and empty texts get the score of the constant gram. Rows with a null or repeated ``doc_id`` are scored each by
    its own text. Without any label every score is 0.5. An empty table gives an empty result. Only ``doc_id`` and
    ``text`` of ``docs`` and ``doc_id`` and ``quality`` of ``labels`` are read, whatever other columns there are.
    """
    return score(docs, train(training_rows(docs, labels, max_rows)))
