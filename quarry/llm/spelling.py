"""Spelling variants: words one edit apart, found by dense prefix-suffix comparison of blocks of words.

Two words are one inserted, deleted or replaced code point apart if and only if their common prefix and common suffix
together reach the longer length minus one. Words are laid into matrices of code points, padded with marks that match
nothing, once from the left and once from the right; comparing two blocks of rows gives the prefix and suffix lengths
of all their pairs at once.

Which blocks meet. A pair shares at least ``t`` code points, ``m - 1`` for two words of length ``m`` and ``m`` for lengths
``m`` and ``m + 1``. The possible prefix lengths 0 to ``t`` are cut into ``PARTS`` ranges of ``w``. A pair whose prefix lies
in the range from ``i w`` agrees in its first ``i w`` and its last ``t - (i + 1) w + 1`` code points, about three quarters
of the words, and meets in the group of these; only there does it count, so each pair counts once. A group of many words
is cut into tiles by a hash and every pair of its tiles is a task of its own, so no task holds a group. Links are summed
up per word before they are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, one_by_one, stage, unstage

MIN_LENGTH, MIN_COUNT = 5, 3
#: A damaged run is one whose hash this divides.
DAMAGE = 97
#: Words of a tile, and code points that a comparison lays out at once.
TILE = 1024
_CELLS = 1 << 22
#: Ranges of the common prefix's length by which words are dealt.
PARTS = 4
_HELD = 1 << 17


def occurrences(docs: DataFrame, min_length: int = MIN_LENGTH, damage: int = DAMAGE) -> DataFrame:
    """``word, n`` of the runs of letters of every whole text, summed up per stretch of rows.

    A run whose crc32 with its ``doc_id`` is divisible by ``damage`` loses one code point (0: none does).
    """
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}")

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), one_by_one(b.column("text")), strict=True):
                if not text:
                    continue
                # bytes lower A-Z alone
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                head = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs.findall(low)).items():
                    if damage:
                        h = zlib.crc32(word.encode(), head)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_length:
                                continue
                    total[word] += n
                if len(total) > _HELD:
                    yield _counts(total)
                    total = Counter()
        if total:
            yield _counts(total)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                      ["word", "n"])


def groups(words: DataFrame) -> DataFrame:
    """``kind, m, part, ends, side, word, n``: every group a word belongs to.

    Kind 0 pairs words of length ``m``; kind 1 pairs those of length ``m`` (side 0) with those of ``m + 1`` (side 1).
    """
    size = F.length("word")

    def group(kind, m, part):
        shared, wide = m - 1 + kind, F.ceil((m + kind) / PARTS).cast("int")
        head, tail = part * wide, F.greatest(shared - (part + 1) * wide + 1, F.lit(0))
        # a digit is no letter, so the two ends cannot run together
        ends = F.concat(F.substring("word", F.lit(1), head), F.lit("0"), F.substring("word", size - tail + 1, tail))
        side = F.lit(0) if kind == 0 else (size - m).cast("int")
        return F.when(head <= shared, F.struct(
            F.lit(kind).alias("kind"), m.cast("int").alias("m"), F.lit(part).alias("part"), ends.alias("ends"),
            side.alias("side")))

    every = F.array(*[group(kind, m, part) for kind, m in ((0, size), (1, size), (1, size - 1))
                      for part in range(PARTS)])
    return words.select("word", "n", F.explode(F.array_compact(every)).alias("g")).select("g.*", "word", "n")


_GROUP = ["kind", "m", "part", "ends"]


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of :func:`groups` that can meet another, each once for every pair of tiles it takes part in.

    ``t0, t1`` number the tile pair; in a pair of two tiles ``side`` tells them apart, in a tile by itself it is 0.
    """
    rows = groups(words)
    # how many words a group has on each side; groups without a pair go
    sizes = (rows.groupBy(*_GROUP).agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1)
                                       .alias("c1"))
             .filter("(kind = 0 and c0 > 1) or (kind = 1 and c0 > 0 and c1 > 0)")
             .select(*[F.col(c).alias(f"_{c}") for c in _GROUP],
                     *[F.ceil(F.col(c) / tile).cast("int").alias(c) for c in ("c0", "c1")]))
    same = [F.col(c) == F.col(f"_{c}") for c in _GROUP]
    # Spark sizes an exploded table by the rows before; the hint keeps the groups out of a broadcast
    j = rows.join(sizes.hint("merge"), same).select(*_GROUP, "side", "word", "n", "c0", "c1")
    own = F.pmod(F.xxhash64("word"), F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c1"))).cast("int")
    j = j.withColumn("own", own)
    alone = F.transform(F.sequence(F.lit(0), F.col("c0") - 1), lambda u: F.struct(
        F.least("own", u).alias("t0"), F.greatest("own", u).alias("t1"), (F.col("own") > u).cast("int").alias("side")))
    first = F.transform(F.sequence(F.lit(0), F.col("c1") - 1), lambda u: F.struct(
        F.col("own").alias("t0"), u.alias("t1"), F.lit(0).alias("side")))
    second = F.transform(F.sequence(F.lit(0), F.col("c0") - 1), lambda u: F.struct(
        u.alias("t0"), F.col("own").alias("t1"), F.lit(1).alias("side")))
    meets = F.when(F.col("kind") == 0, alone).when(F.col("side") == 0, first).otherwise(second)
    return j.select(*_GROUP, "word", "n", F.explode(meets).alias("p")).select(*_GROUP, "p.*", "word", "n")


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``words`` padded on the right and padded on the left, and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = int(size.max(initial=0))
    left, right = np.zeros((len(words), wide), np.uint32), np.zeros((len(words), wide), np.uint32)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    col = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    left[row, col] = points
    right[row, np.repeat(wide - size, size) + col] = points
    return left, right, size


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of ``x`` and ``y``; padding (0) matches nothing."""
    same = (x == y) & (x != 0)
    return np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))


def near_pairs(group: np.ndarray, side: np.ndarray, alone: np.ndarray, low: np.ndarray, high: np.ndarray,
               words: list[str]):
    """Index pairs of rows one edit apart. Rows are sorted by ``group`` and ``side``.

    ``alone`` marks groups that are paired with themselves, others pair side 0 with side 1. A pair counts in a group if
    its prefix length is in the group's range ``[low, high)``. Pairs are laid out in bounded blocks.
    """
    n = len(words)
    rows = np.arange(n)
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    which = np.searchsorted(new, rows, side="right") - 1
    end = np.concatenate((new[1:], [n]))[which]
    split = new[which] + np.bincount(which, side == 0)[which].astype(np.int64)
    start = np.where(alone, rows + 1, split)  # the first row that this one is compared with
    count = np.where(alone | (side == 0), end - start, 0)
    left, right, size = matrices(words)
    flip = right[:, ::-1]
    total = np.concatenate(([0], np.cumsum(count)))
    per = max(1, _CELLS // max(left.shape[1], 1))
    for at in range(0, int(total[-1]), per):
        k = np.arange(at, min(at + per, int(total[-1])))
        i = np.searchsorted(total, k, side="right") - 1
        j = start[i] + k - total[i]
        p = common(left[i], left[j])
        keep = (p >= low[i]) & (p < high[i])
        i, j, p = i[keep], j[keep], p[keep]
        s = common(flip[i], flip[j])
        hit = p + s >= np.maximum(size[i], size[j]) - 1
        yield i[hit], j[hit]


def links(paired: DataFrame) -> DataFrame:
    """``word, n_near, best`` partial sums over the near words; ``best`` is ``struct<minus n, word>``, least first."""
    key = [*_GROUP, "t0", "t1"]
    dealt = paired.repartition(*key).sortWithinPartitions("m", *[c for c in key if c != "m"], "side", "word")

    def run(batches):
        held = None
        for b in batches:
            f = b.to_pandas()
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            if len(held) < 2 * TILE:
                continue
            last = held[key].iloc[-1]
            open_ = (held[key] == last).all(axis=1).to_numpy()  # the last group may go on in the next batch
            done = held[~open_]
            if len(done):
                yield from settle(done)
                held = held[open_]
        if held is not None and len(held):
            yield from settle(held)

    def settle(f):
        f = f.reset_index(drop=True)
        for _, part in f.groupby("m", sort=False):  # words of one block have about one length
            new = (part[key] != part[key].shift()).any(axis=1)
            group = new.cumsum().to_numpy()
            words, n = part["word"].tolist(), part["n"].to_numpy()
            kind, at = part["kind"].to_numpy(np.int64), part["part"].to_numpy(np.int64)
            alone = (kind == 0) & (part["t0"] == part["t1"]).to_numpy()
            wide = -(-(part["m"].to_numpy(np.int64) + kind) // PARTS)
            for i, j in near_pairs(group, part["side"].to_numpy(), alone, at * wide, (at + 1) * wide, words):
                if not len(i):
                    continue
                a, b = np.concatenate((i, j)), np.concatenate((j, i))
                name = np.array(words, dtype=object)
                found = pd.DataFrame({"word": name[a], "minus": -n[b], "near": name[b]})
                found = found.sort_values(["word", "minus", "near"])
                first = found.drop_duplicates("word")
                count = found.groupby("word", sort=False).size()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first["word"], pa.string()), pa.array(count.loc[first["word"]].to_numpy(np.int64)),
                     pa.array(first["minus"].to_numpy(np.int64)), pa.array(first["near"], pa.string())],
                    ["word", "n_near", "minus", "near"])

    return dealt.mapInArrow(run, "word string, n_near long, minus long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words in ``word, form``: forms are followed to their ends by doubling steps."""
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        more = at.join(step.hint("merge"), F.col("root") == F.col("_w"), "left")  # a file's size says little of its rows
        nxt = stage(more.select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")),
                    "roots")
        done = nxt.filter("moved").isEmpty()
        unstage(at)
        at = nxt.drop("moved")
        if done:
            return at


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             damage: int = DAMAGE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``); see the module.

    A word's form is its near word of largest count (the smallest on a tie) if that is at least twice its own count.
    Null and empty texts have no words. A null ``doc_id`` is written as nothing in the hash that damages a run; rows
    that repeat an id count each. An empty table gives an empty result; no other columns are read.
    """
    words = (occurrences(docs, min_length, damage).groupBy("word").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= min_count))
    words = stage(words, "words")
    near = (links(tiles(words)).groupBy("word")
            .agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "near")).alias("best"))
            .select(F.col("word").alias("_word"), "n_near", F.col("best.near").alias("near"),
                    (-F.col("best.minus")).alias("near_n")))
    known = words.join(near, F.col("word") == F.col("_word"), "left")
    takes = F.col("near_n") >= 2 * F.col("n")
    known = stage(known.select("word", F.when(takes, F.col("near")).alias("form"), "n",
                               F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(takes, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(known.filter("form is not null")).select(F.col("word").alias("_w"), "root")
    ends = broadcast_if_small(ends.hint("merge"), 128)  # the outer hint, if given, holds
    return (known.join(ends, F.col("word") == F.col("_w"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
