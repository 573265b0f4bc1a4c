"""Substring deduplication by sliding spans of consecutive sentences.

A text is cut into units at sentence ends, clause marks, line ends and before capitalised words; units keep their white
space, so they concatenate to the text. A span is the shortest run of consecutive units, from each unit on, that holds
``min_words`` words. Spans are hashed over the words alone (96 bits), joined over the whole corpus, and every unit
covered by a span that also occurs earlier is removed. Earlier means in a smaller ``doc_id`` or earlier in the same
text. Cutting at clause marks as well as sentence ends lets a passage pasted into the middle of a sentence line up with
its other copies after at most one clause.

Clauses of ``WINDOW`` words or more are cut further, at places their words choose: after the word of least hash of every
``WINDOW`` neighbouring words of the clause. Copies of a passage choose alike but for windows that reach out of it, and no
unit is longer than a window, so at 25 words a passage of 47 is found wherever it starts and whatever surrounds it.

How the join stays small. The spans of a text leave its task as one row of hashes. Hashes that occur twice are found by
a grouped count of 64 bits each. Their Bloom filter, while its size is within a bound, then drops all other spans where
they lie (beyond the bound the spans are shuffled to them instead), and what it lets through by error falls out of the
exact join of the rest. Only hashes come back to the texts; the places are found by hashing the few texts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_BYTES, broadcast_if_small, mix64, one_by_one, stage, unstage, unused

MIN_WORDS = 25
_ROWS = 256
#: Words of which one ends a unit.
WINDOW = 8
_B0, _B1, _B2 = 0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so they have inverses modulo 2**64
#: Bytes of a shard of the Bloom filter, bits a key, and probes.
SHARD, BITS, PROBES = 1 << 16, 10, 6

_CHARS = [chr(c) for c in range(256)]
_SPACE = np.array([c.isspace() for c in _CHARS])
_MARK = np.array([c in ".!?,;:" for c in _CHARS])


def _capital(c: str) -> bool:
    """Whether a word that starts with ``c`` starts a unit: letters but for the lower-case ones of Latin-1."""
    return c.isalnum() and not c.isdecimal() and not ("a" <= c <= "z" or "ß" <= c <= "ö" or "ø" <= c <= "ÿ")


_CAPITAL = np.array([_capital(c) for c in _CHARS])


def _test(points: np.ndarray, table: np.ndarray, rule) -> np.ndarray:
    """``rule`` of every code point, from the table where it reaches."""
    out = table[np.minimum(points, 255)]
    wide = np.flatnonzero(points > 255)
    if len(wide):
        uniq, back = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([rule(chr(c)) for c in uniq])[back]
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_TABLE = {b: _powers(b, 1 << 15) for b in (_B0, *(x for b in (_B1, _B2) for x in (b, pow(b, -1, 1 << 64))))}


def powers(base: int, n: int) -> np.ndarray:
    return _TABLE[base][:n] if n <= 1 << 15 else _powers(base, n)


class Units:
    """The units of a text: where each starts (``at``, code points) and its first word (``first``, with an end)."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~_test(points, _SPACE, str.isspace)
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        n = len(start)
        self.words, self.n_chars = n, len(points)
        if not n:
            self.hash = np.zeros(0, np.uint64)
            self.at = np.zeros(min(len(points), 1), np.int64)
            self.first = np.zeros(len(self.at) + 1, np.int64)
            return
        size = end - start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        each = (points[inside].astype(np.uint64) + np.uint64(1)) * powers(_B0, int(size.max()))[place]
        self.hash = mix64(np.add.reduceat(each, begin))
        lines = np.cumsum(points == 10)
        last = _test(points[end - 1], _MARK, lambda c: False)
        last[:-1] |= (lines[start[1:]] > lines[end[:-1] - 1]) | _test(points[start[1:]], _CAPITAL, _capital)
        last[-1] = True
        clause = np.cumsum(last) - last
        last[chosen_ends(self.hash, clause)] = True
        ends = np.flatnonzero(last) + 1
        self.first = np.concatenate(([0], ends))
        self.at = start[self.first[:-1]].astype(np.int64)
        self.at[0] = 0


def chosen_ends(h: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """Words of least hash (the last on a tie) of each window of words inside a clause."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(clause[WINDOW - 1:] == clause[:len(clause) - WINDOW + 1])
    least, last = h[at], at.copy()
    for d in range(1, WINDOW):
        lower = h[at + d] <= least
        least, last = np.where(lower, h[at + d], least), np.where(lower, at + d, last)
    return np.unique(last)


def units(text: str) -> list[str]:
    """The units of a text; concatenated they give the text back."""
    u = Units(text)
    at = [*u.at.tolist(), u.n_chars]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def span_table(text: str, min_words: int = MIN_WORDS, u: Units | None = None):
    """``(start unit, end unit, hash 1, hash 2)`` arrays of every span of a text, in order of the start unit."""
    u = u or Units(text)
    if u.words < min_words:
        return None
    last = np.searchsorted(u.first, u.first[:-1] + min_words)  # first boundary at which the run is long enough
    start = np.flatnonzero(last < len(u.first))
    last = last[start]
    a, b = u.first[start], u.first[last]
    out = []
    for base, salt in ((_B1, 0), (_B2, 1)):
        h = mix64(u.hash + np.uint64(salt)) * powers(base, u.words)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
        out.append(mix64((total[b] - total[a]) * powers(pow(base, -1, 1 << 64), u.words)[a]))
    return start, last, out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def one_key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Both hashes in one number, for comparisons inside a text."""
    return mix64(h1.view(np.uint64) + mix64(h2.astype(np.int64).view(np.uint64)))


def seen_before(key: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tkey"), "text")


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, tkey, h1, h2, again`` of every text that has a ``doc_id`` and a span.

    The arrays hold each different span of the text once; ``again`` tells whether one occurs in it twice.
    """
    def run(batches):
        for b in batches:
            rows, held = [], 0
            for i, text in enumerate(one_by_one(b.column("text"))):
                got = span_table(text, min_words)
                if got is not None:
                    twice = seen_before(one_key(got[2], got[3]))
                    rows.append((i, got[2][~twice], got[3][~twice], bool(twice.any())))
                    held += len(twice)
                if held > 50_000:
                    yield frame(b, rows)
                    rows, held = [], 0
            if rows:
                yield frame(b, rows)

    def frame(b, rows):
        at, h1, h2, again = zip(*rows, strict=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in h1]))), pa.int32())
        at = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(at), b.column("tkey").take(at),
             *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (h1, h2)), pa.array(again)],
            ["doc_id", "tkey", "h1", "h2", "again"])

    return (keyed(docs).filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
            .mapInArrow(run, "doc_id long, tkey int, h1 array<long>, h2 array<int>, again boolean"))


def probes(key: np.ndarray) -> np.ndarray:
    """Bit numbers ``(probes, keys)`` inside a shard of the Bloom filter."""
    bits, out = np.uint64((SHARD * 8).bit_length() - 1), []
    for salt in range(-(-PROBES // 3)):
        x = mix64(key.view(np.uint64) + np.uint64(salt + 1))
        out += [(x >> np.uint64(64) - bits * np.uint64(i + 1)) & np.uint64(SHARD * 8 - 1) for i in range(3)]
    return np.stack(out[:PROBES]).astype(np.int64)


def bloom(keys: DataFrame, n: int, column: str):
    """The shards ``(count, SHARD)`` of a Bloom filter over ``n`` keys, or None if it would exceed the bound.

    A key lies in one shard, so shards are built apart and only their bits leave the tasks.
    """
    shards = max(1, -(-n * BITS // (8 * SHARD)))
    if shards * SHARD > BROADCAST_BYTES:
        return None

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at, key = b.column("shard").to_numpy(), b.column(column).to_numpy()
            bit = probes(key)
            for k in np.unique(at):
                bits = held.setdefault(int(k), np.zeros(SHARD, np.uint8))
                mine = bit[:, at == k].ravel()
                np.bitwise_or.at(bits, mine >> 3, np.left_shift(1, mine & 7).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()),
                                              pa.array([x.tobytes() for x in held.values()], pa.binary())],
                                             ["shard", "bits"])

    out = np.zeros((shards, SHARD), np.uint8)
    parts = (keys.select(F.pmod(F.col(column), F.lit(shards)).cast("int").alias("shard"), column)
             .repartition("shard").mapInArrow(run, "shard int, bits binary"))
    for r in parts.toLocalIterator():
        out[r["shard"]] |= np.frombuffer(r["bits"], np.uint8)
    return out


def hits(sp: DataFrame, filter_) -> DataFrame:
    """``doc_id, tkey, h1, h2`` of the spans that a Bloom filter lets through; all of them without a filter."""
    shared = sp.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        bits = shared.value
        for b in batches:
            h1, h2 = b.column("h1"), b.column("h2")
            row = np.repeat(np.arange(b.num_rows), np.diff(h1.offsets.to_numpy()))
            k1, k2 = h1.flatten().to_numpy(), h2.flatten().to_numpy()
            if bits is not None and len(k1):
                at = np.mod(k1, len(bits))
                bit = probes(k1)
                keep = ((bits[at, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(axis=0)
                row, k1, k2 = row[keep], k1[keep], k2[keep]
            if len(row):
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("tkey").take(row),
                                                  pa.array(k1), pa.array(k2)], ["doc_id", "tkey", "h1", "h2"])

    return sp.select("doc_id", "tkey", "h1", "h2").mapInArrow(run, "doc_id long, tkey int, h1 long, h2 int")


def repeated(sp: DataFrame) -> DataFrame:
    """``doc_id, tkey, h1, h2`` of the spans that occur in an earlier document, from the output of :func:`spans`.

    Counts are grouped with a partial sum and only joined back on hashes seen in two texts, so a passage that a third of
    all documents share is neither sorted nor gathered in one place; AQE splits its side of the join.
    """
    shared = stage(sp.select(F.explode("h1").alias("k1")).groupBy("k1").agg(F.count(F.lit(1)).alias("c"))
                   .filter("c > 1").select("k1"), "shared-spans")
    n = shared.count()
    filter_ = bloom(shared, n, "k1")
    found = hits(sp, filter_)
    if filter_ is None:
        found = found.join(shared, F.col("h1") == F.col("k1"), "left_semi")
    found = stage(found, "span-hits")
    unstage(shared)
    lead = (found.groupBy(F.col("h1").alias("l1"), F.col("h2").alias("l2"))
            .agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("hi")).filter("lead < hi").drop("hi"))
    lead = broadcast_if_small(lead, 48, n)
    return (found.join(lead, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2"))).filter("doc_id > lead")
            .select("doc_id", "tkey", "h1", "h2"))


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = True) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``, plus ``n_units``, ``n_removed`` and ``removed``.

    ``removed`` lists the cut stretches as ``struct<start, end>`` in code points of the old text. The three replace
    columns of ``docs`` of their names; without ``report`` they are left out and ``docs`` keeps its own. Null texts stay
    null and empty ones empty (no units). Rows without a ``doc_id`` take no part and keep their text. Rows that share a
    ``doc_id`` count as one document, so copies of a row stay alike. Other columns pass through; an empty table gives
    an empty result. No word outside a repeated span is removed.
    """
    sp = stage(spans(docs, min_words), "spans")
    late = repeated(sp).unionByName(sp.filter("again").select(
        "doc_id", "tkey", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("int").alias("h2")))
    cid, ckey, k1, k2 = unused(docs, "cid", "ckey", "k1", "k2")
    cut = (late.groupBy(F.col("doc_id").alias(cid), F.col("tkey").alias(ckey))
           .agg(F.collect_list("h1").alias(k1), F.collect_list("h2").alias(k2)))
    names = docs.columns
    j = docs.join(cut, (F.col("doc_id").cast("long") == F.col(cid)) & (F.hash("text") == F.col(ckey)), "left")
    kinds = {"n_units": pa.int32(), "n_removed": pa.int32(),
             "removed": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))} if report else {}
    extra = [c for c in kinds if c not in names]

    def apply(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                texts, a, z = part.column("text"), part.column(k1), part.column(k2)
                rows = [cut_text(t, (x.values.to_numpy(), y.values.to_numpy()) if x.is_valid else None, min_words,
                                 report) for t, x, y in zip(one_by_one(texts), a, z, strict=True)]
                new = dict(zip(("text", "n_units", "n_removed", "removed"), zip(*rows, strict=True), strict=True))
                cols = {c: part.column(c) for c in names} | {"text": pa.array(new["text"], texts.type)} | {
                    c: pa.array(new[c], t) for c, t in kinds.items()}
                yield pa.RecordBatch.from_arrays([cols[c] for c in [*names, *extra]], [*names, *extra])

    sql = {"n_units": "int", "n_removed": "int", "removed": "array<struct<start:int,end:int>>"} if report else {}
    types = {f.name: f.dataType.simpleString() for f in docs.schema} | sql
    out = ", ".join(f"`{c}` {types[c]}" for c in [*names, *extra])
    return j.select(*[F.col(f"`{c}`") for c in names], k1, k2).mapInArrow(apply, out)


def cut_text(text: str | None, late: tuple | None, min_words: int = MIN_WORDS, count: bool = True) -> tuple:
    """``(text without the cut units, units, units removed, removed stretches)``.

    ``late`` holds the hashes of the text's spans that occur in earlier documents; None if there is nothing to cut.
    """
    if not text or late is None and not count:
        return text, 0, 0, []
    u = Units(text)
    got = span_table(text, min_words, u) if late is not None else None
    if got is None:
        return text, len(u.at), 0, []
    first, last, h1, h2 = got
    key = one_key(h1, h2)
    hit = seen_before(key) | np.isin(key, one_key(late[0].astype(np.int64), late[1].astype(np.int32)))
    gone = np.zeros(len(u.at) + 1, np.int64)
    np.add.at(gone, first[hit], 1)
    np.add.at(gone, last[hit], -1)
    gone = np.cumsum(gone)[:-1] > 0
    at = np.append(u.at, u.n_chars)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    stretches = [(int(at[a]), int(at[b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    kept, pos = [], 0
    for a, b in stretches:
        kept.append(text[pos:a])
        pos = b
    kept.append(text[pos:])
    return "".join(kept), len(u.at), int(gone.sum()), [{"start": a, "end": b} for a, b in stretches]
