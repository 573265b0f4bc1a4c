"""Best-fit packing of tokenised documents into fixed-length sequences, improved by swap-based local search.

Every document becomes its token ids and an end id. Only documents longer than a sequence are cut; whole pieces fill a
sequence each, and the rest are packed in blocks of a fixed number of items. A block starts from best-fit decreasing;
then items move between underfull bins, one for nothing, one for one, two for one or one for two, whenever that raises
the sum of squared fills. Raising it drains the emptiest bins until they vanish. Bins that stay underfull are pooled
over blocks and packed again, with a block count that shrinks to one, so leftovers do not add up over blocks.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import one_by_one, stage

CAPACITY = 2048
END_ID = 0
#: Items that one task packs at a time, and the fill below which a bin is packed again with those of other blocks.
BLOCK = 8192
FULL = 0.995
_PASSES = 4


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


@functools.lru_cache(maxsize=2)
def encoder(vocab_json: str):
    """A fast byte-level BPE encoder of the vocabulary in a tokenizer file, with the file's added tokens.

    The file's merges are listed in the order of their results' ids, so its vocabulary is a table of ranks.
    """
    import public_tokenizers
    import tiktoken

    with open(vocab_json, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    code = {c: b for b, c in enumerate(byte_alphabet())}
    ranks = {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("vocab", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, vocab_json: str, end_id: int = END_ID, added: bool = False) -> np.ndarray:
    """Ids of a text (null: empty), then the end id.

    With ``added``, the file's added tokens get their ids, as the tokenizers library gives by default; packing does so.
    Without, they are ordinary text.
    """
    ids = (encoder(vocab_json).encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())
           if text else np.zeros(0, np.uint32))
    return np.append(ids, end_id).astype("<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; of one that is too long, the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, vocab_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row of ``docs``, in one scan."""
    def run(batches):
        for b in batches:
            rows = []
            for at, t in enumerate(one_by_one(b.column("text"))):
                ids = token_ids(t, vocab_json, end_id, added=True)
                rows += [(at, i, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                         for i, (s, n) in enumerate(cuts(len(ids), capacity))]
            if not rows:
                continue
            at, piece, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"))


class Bins:
    """Bins of one block; keeps the underfull ones' items findable by length."""

    def __init__(self, lengths, capacity: int):
        self.size, self.cap = [int(x) for x in lengths], capacity
        self.items: list[set[int]] = []
        self.fill: list[int] = []
        self.home = [-1] * len(self.size)
        self.by: dict[int, set[int]] = {}
        self.sizes: list[int] = []

    def best_fit(self) -> None:
        room: list[tuple[int, int]] = []  # (free, bin), sorted
        for i in sorted(range(len(self.size)), key=lambda i: (-self.size[i], i)):
            n = self.size[i]
            at = bisect_right(room, (n, -1))
            if at < len(room):
                free, b = room.pop(at)
            else:
                free, b = self.cap, len(self.items)
                self.items.append(set())
                self.fill.append(0)
            self.items[b].add(i)
            self.fill[b] += n
            self.home[i] = b
            if free > n:
                insort(room, (free - n, b))

    def show(self, i: int) -> None:
        n = self.size[i]
        if n not in self.by:
            self.by[n] = set()
            insort(self.sizes, n)
        self.by[n].add(i)

    def hide(self, i: int) -> None:
        n = self.size[i]
        own = self.by.get(n)
        if own is not None:
            own.discard(i)
            if not own:
                del self.by[n]
                self.sizes.pop(bisect_right(self.sizes, n) - 1)

    def put(self, i: int, b: int) -> None:
        a = self.home[i]
        self.items[a].discard(i)
        self.fill[a] -= self.size[i]
        self.items[b].add(i)
        self.fill[b] += self.size[i]
        self.home[i] = b

    def partner(self, low: int, high: int, a: int, base: int) -> int | None:
        """The longest item with ``low < length <= high`` of another bin, whose move into ``a`` raises the objective.

        ``base`` is what ``a`` gives in exchange; ``a`` grows by ``length - base`` and must end fuller than the other.
        """
        at = bisect_right(self.sizes, high) - 1
        while at >= 0 and self.sizes[at] > low:
            n = self.sizes[at]
            for i in self.by[n]:
                b = self.home[i]
                if b != a and self.fill[a] + n - base > self.fill[b]:
                    return i
            at -= 1
        return None

    def improve(self, a: int) -> bool:
        """One exchange that fills bin ``a`` further, the largest gain over all kinds of exchange; False if none."""
        gap = self.cap - self.fill[a]
        own = sorted(self.items[a], key=lambda i: (self.size[i], i))
        give: list[tuple[int, ...]] = [()] + [(i,) for i in own]
        give += [(own[i], own[j]) for i in range(len(own)) for j in range(i + 1, len(own))] if len(own) <= 12 else []
        best, gain = None, 0
        for out in give:
            base = sum(self.size[i] for i in out)
            i = self.partner(base + gain, base + gap, a, base)
            if i is not None:
                best, gain = (out, (i,)), self.size[i] - base
                if gain == gap:
                    break
        if gain < gap:  # one of ours for two of another bin
            for x in own:
                i = self.partner(0, self.size[x] + gap - 1, a, 0)
                if i is None:
                    continue
                b = self.home[i]
                rest = self.size[x] + gap - self.size[i]
                for y in self.items[b]:
                    d = self.size[i] + self.size[y] - self.size[x]
                    if y != i and self.size[y] <= rest and d > gain and self.fill[a] + d > self.fill[b]:
                        best, gain = ((x,), (i, y)), d
        if best is None:
            return False
        out, into = best
        b = self.home[into[0]]
        for i in out:
            self.put(i, b)
        for i in into:
            self.put(i, a)
        return True

    def search(self) -> None:
        """Fill underfull bins, the fullest first, until a pass changes nothing."""
        for _ in range(_PASSES):
            open_ = [b for b in range(len(self.fill)) if 0 < self.fill[b] < self.cap]
            self.by, self.sizes = {}, []
            for b in open_:
                for i in self.items[b]:
                    self.show(i)
            changed = False
            for a in sorted(open_, key=lambda b: (-self.fill[b], b)):
                while 0 < self.fill[a] < self.cap and self.improve(a):
                    changed = True
                if self.fill[a] >= self.cap:
                    for i in self.items[a]:
                        self.hide(i)
            if not changed:
                return


def pack_block(lengths, capacity: int = CAPACITY):
    """``(bin, offset, fill of the bin)`` arrays for items of these lengths."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    offset = [0] * len(lengths)
    for items in bins.items:
        at = 0
        for i in sorted(items):
            offset[i] = at
            at += bins.size[i]
    return np.array(bins.home), np.array(offset), np.array([bins.fill[b] for b in bins.home])


def pack(docs: DataFrame, vocab_json: str, capacity: int = CAPACITY, end_id: int = END_ID,
         block: int = BLOCK) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    Null and empty texts are the end id alone. Repeated rows are packed like any others, with their ids repeated; a
    null ``doc_id`` stays null. Other columns are not read. Within a sequence pieces lie without gaps from offset 0.
    An empty table gives an empty result.
    """
    todo = stage(pieces(docs, vocab_json, capacity, end_id), "pieces")
    whole = todo.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    todo, done, level, before = todo.filter(F.col("length") < capacity), [whole], 0, None
    while n := todo.count():
        blocks = -(-n // block)
        # pooling ends with one block, or when half of what was pooled last time came back
        last = blocks == 1 or (before is not None and 2 * n > before)

        def run(batches, level=level, last=last):
            part, chunk, held = TaskContext.get().partitionId(), 0, []

            def emit(held, chunk):
                rows = pa.Table.from_batches(held).combine_chunks()
                home, offset, fill = pack_block(rows.column("length").to_numpy(), capacity)
                new = {"sequence_id": (level << 56) + (part << 34) + (chunk << 20) + home, "offset": offset,
                       "sealed": (fill >= FULL * capacity) | last}
                for name, values in new.items():
                    rows = rows.append_column(name, pa.array(values))
                yield from rows.to_batches()

            for b in batches:
                held.append(b)
                if sum(map(len, held)) >= 2 * block:
                    yield from emit(held, chunk)
                    held, chunk = [], chunk + 1
            if held:
                yield from emit(held, chunk)

        packed = stage(todo.repartition(blocks).mapInArrow(run, (
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
            "sealed boolean")), "packed")
        done.append(packed.filter("sealed").drop("sealed"))
        todo, level, before = packed.filter("not sealed").drop("sealed", "sequence_id", "offset"), level + 1, n
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def sequences(docs: DataFrame, placed: DataFrame, vocab_json: str, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` in order of offset, from the output of :func:`pack`.

    Needs ``doc_id`` to name one text; a sequence holds at most one capacity of ids, so a group is bounded.
    """
    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return pd.Series([token_ids(t, vocab_json, end_id, added=True).astype(np.int32) for t in text])

    j = placed.join(docs.select(F.col("doc_id").alias("d"), ids("text").alias("all")).dropDuplicates(["d"]),
                    F.col("doc_id") == F.col("d"))
    j = j.select("sequence_id", "offset", F.slice("all", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
                 .alias("part"))
    return (j.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
            .select("sequence_id", F.flatten("parts.part").alias("ids")))
