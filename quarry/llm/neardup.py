"""Near-duplicate documents by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

SuperMinHash gives every element of a set a random permutation of the ``m`` slots, built one step at a time; step ``j``
offers ``j + r`` with ``r`` in [0, 1) to the slot it lands on. Slots are thus filled by correlated ranks (lower variance
than independent hashes), and once every slot holds less than ``j + 1`` no later step can change it, so a set of many
elements stops after a few steps.

The signature is cut into 32 bands of 5. A pair at similarity 0.8 misses all bands with probability
``(1 - 0.8**5)**32 = 3e-6``. Pairs that meet in a band are confirmed on their full shingle sets.

How a bucket is resolved without listing its pairs. Each bucket compares its members with one pivot, the member that
shares the most buckets, so that overlapping buckets take the same one. If all members then
lie in one component, the bucket is done: more links inside it could not change a component. Otherwise pivots are drawn
from the components other than its largest, compared with the members of the other components, and retired, eight times as
many each round, until the rest of the bucket lies in one component. A pair that meets in several torn buckets is made in
the least of them alone; a node that retires from another one is still in that. Every pair of a bucket that is never compared
either lies in one component already or is ruled out: by the sizes of the two sets, by the triangle inequality of the
Jaccard distance to a common pivot, or (large buckets, :func:`settle_rare`) by the elements the two can share at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import broadcast_if_small, mix64, one_by_one, stage, unstage, unused

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
PERCENT = 80
#: Members above which a bucket is split by element frequency, and the nodes that may have an element that is rare.
LARGE, RARE = 64, 64
_RANK_BITS = np.uint64(48)
_CHUNK = 1 << 16
_STEP = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a whole text, A-Z lower-cased.

    Words are runs of anything but the six ASCII separators. Fewer than ``k`` words make one shingle, none make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    code, uniq = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(uniq, categorize=False)[code]
    k = min(k, len(words))
    acc = mix64(h[:len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        acc = mix64(acc * _SPREAD + h[i:len(h) - k + 1 + i])
    return np.unique(acc)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_owners: int, m: int = SLOTS) -> np.ndarray:
    """Signatures ``(n_owners, m)`` of the sets given as element hashes with the row each belongs to.

    A value is ``step << 48 | random``, so integer order is the order of ``step + random``. Elements are taken in
    chunks against shared slots, so memory does not grow with a set.
    """
    sig = np.full((n_owners, m), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    for at in range(0, len(elements), _CHUNK):
        e, o = elements[at:at + _CHUNK], owner[at:at + _CHUNK]
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
        row = np.arange(len(e))
        for j in range(m):
            draw = mix64(e + np.uint64((j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
            k = j + ((draw & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
            slot = perm[row, k]
            perm[row, k] = perm[row, j]
            np.minimum.at(flat, o.astype(np.int64) * m + slot, (np.uint64(j) << _RANK_BITS) | (draw >> np.uint64(16)))
            own = np.unique(o)
            open_ = own[sig[own].max(axis=1) >= np.uint64(j + 1) << _RANK_BITS]
            if len(open_) == 0:
                break
            if len(open_) < len(own):
                live = np.isin(o, open_)
                e, o, perm = e[live], o[live], perm[live]
                row = np.arange(len(e))
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band number is part of the key."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS))
    for r in range(ROWS):
        acc = mix64(acc * _SPREAD + rows[:, :, r])
    return acc.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, d1, d2, bands`` per row: set size, 128-bit digest of the set, band keys (null if empty)."""
    def run(batches):
        for b in batches:
            ids, texts, at = b.column("doc_id"), one_by_one(b.column("text")), 0
            while at < b.num_rows:
                sets, total = [], 0
                while at + len(sets) < b.num_rows and total < 2 * _CHUNK:
                    sets.append(shingles(next(texts), k))
                    total += len(sets[-1])
                n = np.array([len(s) for s in sets])
                sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), len(sets))
                with np.errstate(over="ignore"):
                    digests = [[int((mix64(s + np.uint64(salt)) * mix64(s ^ np.uint64(salt))).sum(dtype=np.uint64)
                                    .view(np.int64)) for s in sets] for salt in (1, 2)]
                keys = [x if c else None for x, c in zip(band_keys(sig), n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array(n), *(pa.array(d, pa.int64()) for d in digests),
                     pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "bands"])
                at += len(sets)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>"))


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``node, shingles`` per row, for confirming links."""
    def run(batches):
        for b in batches:
            texts, at = one_by_one(b.column("text")), 0
            while at < b.num_rows:
                sets, total = [], 0
                while at + len(sets) < b.num_rows and total < 4 * _CHUNK:
                    sets.append(shingles(next(texts), k).view(np.int64))
                    total += len(sets[-1])
                yield pa.RecordBatch.from_arrays([b.column("node").slice(at, len(sets)),
                                                  pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])
                at += len(sets)

    return docs.select(F.col("doc_id").alias("node"), "text").mapInArrow(run, "node long, shingles array<long>")


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find inside each partition: its edges ``a, b`` become ``node, root`` stars of the same components."""
    def run(batches):
        up: dict[int, int] = {}

        def find(x):
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for b in batches:
            for x, y in zip(b["a"].tolist(), b["b"].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = [x for x in up if find(x) != x]
        for at in range(0, len(nodes), 100_000):
            part = nodes[at:at + 100_000]
            yield pd.DataFrame({"a": [up[x] for x in part], "b": part}, dtype="int64")

    return edges.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node reachable) for every node that has an edge ``a, b``.

    Partitions contract their own edges by union-find; large-star and small-star steps join the forests. A step groups
    by node with a partial minimum and joins it back, so a node with very many edges is not gathered in one task.
    """
    e = stage(local_forest(edges), "forest")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = (both.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).filter("b > a")
                .select(F.col("m").alias("a"), "b").filter("a < b").distinct())
        # small star: point each node and its smaller neighbours at the smallest of them
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        small = (star.join(low.withColumnRenamed("b", "u"), F.col("b") == F.col("u"))
                 .select("m", "a", "b"))
        nxt = (small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
               .unionByName(low.select(F.col("m").alias("a"), "b")).distinct())
        nxt = stage(nxt, "stars")
        # done when every node hangs on one root and no root hangs on another
        roots = nxt.select("a").distinct()
        hung = nxt.join(roots.withColumnRenamed("a", "r"), F.col("b") == F.col("r"), "left_semi").limit(1).count()
        twice = nxt.groupBy("b").count().filter("count > 1").limit(1).count()
        unstage(e)
        e = nxt
        if not hung and not twice:
            return (e.select(F.col("b").alias("node"), F.col("a").alias("comp"))
                    .unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``inter`` and ``uni`` to the pairs ``a, b``, from the full shingle sets; JVM-side.

    Pairs with a true ``large`` also get ``beside``: what ``b`` has and ``a`` has not.
    """
    left = sets.select(F.col("node").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("nb"), F.col("shingles").alias("sb"))
    j = (pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
         .withColumn("inter", F.size(F.array_intersect("sa", "sb")).cast("long")))
    uni = (F.size("sa") + F.size("sb") - F.col("inter")).cast("long").alias("uni")
    more = [F.when(F.col("large"), F.array_except("sb", "sa")).alias("beside")] if "large" in pairs.columns else []
    return j.select("a", "b", "inter", uni, *more)


def fits(n1: str, n2: str, percent: int):
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)


def one_of_each(members: DataFrame) -> DataFrame:
    """Of buckets that hold the same nodes, as most bands of a pair do, one stays."""
    print_ = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("p"),
                                        F.bit_xor(F.xxhash64("node")).alias("x"),
                                        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    first = print_.groupBy("c", "p", "x", "y").agg(F.min("key").alias("k"))
    return stage(members.join(first.select("k"), F.col("key") == F.col("k"), "left_semi"), "buckets")


def with_pivots(members: DataFrame) -> DataFrame:
    """Adds each bucket's pivot: the node whose buckets hold the most members, the smallest on a tie.

    The middle of a large group shares more buckets than its outer members, so the overlapping buckets of the group
    agree on it, and few comparisons with few pivots cover the group.
    """
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("key", "k")
    weight = (members.join(held, F.col("key") == F.col("k")).groupBy("node").agg(F.sum("c").alias("w"))
              .withColumnRenamed("node", "m"))
    pivot = (members.join(weight, F.col("node") == F.col("m")).groupBy("key")
             .agg((-F.max(F.struct("w", (-F.col("node")).alias("node")))["node"]).alias("pivot"))
             .withColumnRenamed("key", "k"))
    return stage(members.join(pivot, F.col("key") == F.col("k")).select("key", "pivot", "node", "n"), "pivoted")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    Texts are linked if their sets of ``k``-word shingles have ``100 * intersection >= percent * union``. Null and
    empty texts, and texts without words, have no shingles and link with nothing. Rows that share a ``doc_id`` are one
    document that has all their texts. Rows with a null ``doc_id`` take no part: null component, kept. Exact copies
    are folded by the digest of their sets before any pair is formed. An empty table gives an empty result.
    """
    sig = stage(signatures(docs, k), "signatures")
    usable = sig.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stage(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"),
                                                   F.first("bands").alias("bands")), "classes")
    repeats = not usable.groupBy("doc_id").count().filter("count > 1").isEmpty()
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = (banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
              .select(F.col("key").alias("k")))
    members = one_of_each(stage(banded.join(shared, F.col("key") == F.col("k")).select("key", "node", "n"), "members"))
    same_id = []
    if repeats:  # copies of an id with unlike texts are one node: tie their classes
        same_id = [usable.join(classes.select("d1", "d2", "node"), ["d1", "d2"])
                   .select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b"))
                   .filter("a < b").distinct()]
    links = same_id
    if not members.isEmpty():
        links = links + resolve(docs, with_pivots(members), k, percent, repeats)
    out = sig.join(classes.select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "node"),
                   (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n") > 0), "left")
    if links:
        edges = links[0]
        for x in links[1:]:
            edges = edges.unionByName(x)
        comp = stage(components(edges), "components")
        out = out.join(comp.select(F.col("node").alias("cn"), "comp"), F.col("node") == F.col("cn"), "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("comp", "node", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    if repeats:  # an id may have a linked text and an unlinked one
        least = out.groupBy("doc_id").agg(F.min("component_id").alias("least")).withColumnRenamed("doc_id", "i")
        out = (out.join(least, F.col("doc_id") == F.col("i"), "left")
               .select("doc_id", "n_shingles", F.col("least").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def enough(common, n1, n2, percent: int):
    """Whether two sets of these sizes that share at most ``common`` elements can reach the similarity."""
    return 100 * common >= percent * (n1 + n2 - common)


def unbounded(which) -> list:
    """Aggregates over ``n, pn`` of the rows ``which``: the largest set smaller than the pivot's, the smallest other."""
    return [F.max(F.when(which & (F.col("n") < F.col("pn")), F.col("n"))).alias("below"),
            F.min(F.when(which & (F.col("n") >= F.col("pn")), F.col("n"))).alias("above")]


def meets_unbounded(percent: int):
    """Whether a set whose size fits the pivot's can reach, by size, one of those that :func:`unbounded` sums up."""
    return F.coalesce(fits("n", "below", percent), F.lit(False)) | F.coalesce(fits("n", "above", percent), F.lit(False))


def settle_rare(at: DataFrame, seen: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Splits the work on large torn buckets by what their members have besides their pivot.

    Two members share at most what each shares with the pivot, plus the common elements outside of it that more than
    ``RARE`` members have, plus the rarer ones they share. Pairs that need a rare element are found by joining on it,
    which makes at most ``RARE`` rows an element and member. Pairs that need none are left to the pivots, and members
    too poor in the rest for that leave their bucket. This is what keeps loose copies of a large group from being
    compared with all of it.

    All of this holds only between members that were compared with the pivot. One whose size does not fit the pivot's was
    not, so its pairs are bounded by the sizes alone, and whoever may reach such a member by size stays.

    Returns the remaining rows, with ``m`` elements that a pair of bounded members may share there (null: not bounded),
    and the pairs ``a, b`` found by rare elements.
    """
    torn = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("c"),
                                 F.min("n").alias("n0"), *unbounded(F.col("inter").isNull())).filter("c0 < c1").select(
        F.col("key").alias("tk"), (F.col("c") > LARGE).alias("large"), "n0", "below", "above")
    at = stage(at.join(torn, F.col("key") == F.col("tk")).drop("tk"), "unsettled")
    crowd = stage(at.filter("large and inter is not null").select("pivot", "node", "n", "inter", "comp").distinct(),
                  "crowd")
    beside = seen.filter("beside is not null").select(F.col("a").alias("pivot"), F.col("b").alias("node"), "beside")
    element = crowd.join(beside, ["pivot", "node"]).select("pivot", "node", F.explode("beside").alias("s"))
    often = element.groupBy("pivot", "s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = stage(element.join(often, ["pivot", "s"]).select("pivot", "node", "s", "df"), "elements")
    common = known.filter(F.col("df") > RARE).groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("more"))
    size = stage(crowd.join(common, ["pivot", "node"], "left").select(
        "pivot", "node", "n", "comp", (F.col("inter") + F.coalesce("more", F.lit(0))).alias("m")), "sizes")
    rare = known.filter(F.col("df") <= RARE)
    met = (rare.select("pivot", F.col("node").alias("a"), "s").join(
        rare.select("pivot", F.col("node").alias("b"), "s"), ["pivot", "s"]).filter("a < b")
        .groupBy("pivot", "a", "b").agg(F.count(F.lit(1)).alias("r")))
    sides = [size.select(*[F.col(c).alias(f"{c}_{x}") for c in size.columns]) for x in "ab"]
    met = (met.join(sides[0], (F.col("a") == F.col("node_a")) & (F.col("pivot") == F.col("pivot_a")))
           .join(sides[1], (F.col("b") == F.col("node_b")) & (F.col("pivot") == F.col("pivot_b")))
           .filter((F.col("comp_a") != F.col("comp_b")) & fits("n_a", "n_b", percent) & enough(
               F.col("r") + F.least("m_a", "m_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct())
    at = at.join(size.select(F.col("pivot").alias("mp"), F.col("node").alias("mn"), F.col("m").alias("mm")),
                 (F.col("pivot") == F.col("mp")) & (F.col("node") == F.col("mn")), "left")
    at = at.withColumn("m", F.when(F.col("large"), F.col("mm"))).filter(
        F.col("m").isNull() | enough(F.col("m"), F.col("n"), F.col("n0"), percent) | meets_unbounded(percent))
    return at.select("key", "node", "n", "pn", "near", "far", "comp", "m"), met


def resolve(docs: DataFrame, members: DataFrame, k: int, percent: int, repeats: bool) -> list[DataFrame]:
    """Links ``a, b`` that connect what the buckets in ``members`` (``key, pivot, node, n``) hold; see the module."""
    nodes = broadcast_if_small(stage(members.select("node").distinct(), "nodes"), 24)  # else the texts are shuffled
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        nodes, F.col("doc_id") == F.col("node"), "left_semi")
    if repeats:
        wanted = wanted.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    sets = stage(shingle_sets(wanted, k), "sets")
    size = members.groupBy("key").agg(F.max(F.when(F.col("node") == F.col("pivot"), F.col("n"))).alias("pn"),
                                      F.count(F.lit(1)).alias("c"))
    first = (members.filter("node <> pivot").join(size, "key").filter(fits("n", "pn", percent))
             .groupBy(F.col("pivot").alias("a"), F.col("node").alias("b")).agg(F.max(F.col("c") > LARGE).alias("large")))
    seen = stage(verify(first, sets), "verified")
    links = [seen.filter(f"100 * inter >= {percent} * uni").select("a", "b")]
    # bounds of the distance to the first pivot rule out pairs later on: exact if compared, else from the sizes
    dist = seen.select(F.col("a").alias("pivot"), F.col("b").alias("node"),
                       (1 - F.col("inter") / F.col("uni")).alias("d"), "inter")
    if repeats:  # a node may have several sets, of which the bounds below know nothing
        dist = dist.groupBy("pivot", "node").agg(F.lit(None).cast("double").alias("d"), F.lit(None).cast("long").alias("inter"))
    rest = (members.filter("node <> pivot").join(size.select("key", "pn"), "key").join(dist, ["pivot", "node"], "left")
            .select("key", "pivot", "node", "n", "pn", "inter", F.coalesce("d", 1 - F.least("n", "pn") / F.greatest("n", "pn")).alias("near"),
                    F.coalesce("d", F.lit(1.0)).alias("far")))
    rest = stage(rest, "rest")
    tried, pivots, reach, first_round = seen.select("a", "b"), 16, 1 - percent / 100 + 1e-9, True
    while True:
        edges = links[0]
        for x in links[1:]:
            edges = edges.unionByName(x)
        comp = stage(components(edges), "components")
        placed = at = stage(rest.join(comp.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left").withColumn(
            "comp", F.coalesce("comp", "node")).drop("cn"), "placed")
        unstage(rest)
        if first_round:
            at, met = settle_rare(at, seen, percent)
            by_rare = stage(verify(met.join(tried, ["a", "b"], "left_anti"), sets), "verified")
            tried, first_round = tried.unionByName(by_rare.select("a", "b")), False
        # of the largest component of a bucket only those stay that something outside of it may reach
        crowd = at.groupBy("key", "comp").agg(
            F.count(F.lit(1)).alias("c"), F.min("near").alias("near"), F.max("far").alias("far"), F.min("n").alias("n0"),
            F.max("n").alias("n1"), F.max("m").alias("m1"), *unbounded(F.col("m").isNull()))
        big = crowd.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m")).select(
            F.col("key").alias("bk"), F.col("m.comp").alias("big"))
        outside = (crowd.join(big, (F.col("key") == F.col("bk")) & (F.col("comp") != F.col("big")))
                   .groupBy("key", "big").agg((F.min("near") - reach).alias("from"), (F.max("far") + reach).alias("to"),
                                              F.min("n0").alias("n0"), F.max("n1").alias("n1"), F.max("m1").alias("m1"),
                                              F.max("below").alias("below"), F.min("above").alias("above"))
                   .withColumnRenamed("key", "ok"))
        within = (F.col("far") >= F.col("from")) & (F.col("near") <= F.col("to")) & (
            100 * F.col("n") >= percent * F.col("n0")) & (100 * F.col("n1") >= percent * F.col("n")) & (
            F.col("m").isNull() | meets_unbounded(percent)
            | (F.col("m1").isNotNull() & enough(F.least("m", "m1"), F.col("n"), F.col("n0"), percent)))
        at = stage(at.join(outside, (F.col("key") == F.col("ok")) & ((F.col("comp") != F.col("big")) | within))
                   .select("key", "node", "n", "pn", "m", "near", "far", "comp", "big"), "torn")
        unstage(placed)
        if at.isEmpty():
            return [*links, by_rare.filter(f"100 * inter >= {percent} * uni").select("a", "b")]
        order = Window.partitionBy("key").orderBy("comp", "node")
        picked = (at.filter("comp <> big").withColumn("rank", F.row_number().over(order))
                  .filter(F.col("rank") <= pivots)
                  .select("key", F.col("node").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("np"),
                          F.col("m").alias("pm"), F.col("near").alias("pnear"), F.col("far").alias("pfar")))
        picked = stage(picked, "pivots")
        gone = picked.select("key", F.col("p").alias("node"))
        own = at.groupBy(F.col("node").alias("kn")).agg(F.collect_set("key").alias("keys"))  # a node has few bands
        own = broadcast_if_small(stage(own, "torn-keys"), 24 + 8 * BANDS)
        keyed = at.join(own, F.col("node") == F.col("kn")).drop("kn")
        drawn = picked.join(own.select(F.col("kn"), F.col("keys").alias("pkeys")), F.col("p") == F.col("kn")).drop("kn")
        pairs = (keyed.join(drawn, "key").filter((F.col("comp") != F.col("pc")) & fits("n", "np", percent))
                 .filter(F.array_min(F.array_intersect("keys", "pkeys")) == F.col("key"))
                 .filter((F.col("near") - F.col("pfar") <= reach) & (F.col("pnear") - F.col("far") <= reach)
                         & (F.col("m").isNull() | F.col("pm").isNull()
                            | enough(F.least("m", "pm"), F.col("n"), F.col("np"), percent)))
                 .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
                 .join(tried, ["a", "b"], "left_anti"))
        new = stage(verify(pairs, sets), "verified")
        links = [comp.filter("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")),
                 by_rare.filter(f"100 * inter >= {percent} * uni").select("a", "b"),
                 new.filter(f"100 * inter >= {percent} * uni").select("a", "b")]
        tried = tried.unionByName(new.select("a", "b"))
        rest = stage(at.drop("comp", "big").join(gone, ["key", "node"], "left_anti"), "rest")
        pivots *= 8


def keep_one(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that remain if one document of each group of near duplicates stays.

    The document with the smallest ``doc_id`` stays; repeated rows of it stay as one row. Rows with a null ``doc_id``
    are kept.
    """
    found = near_duplicates(docs, k, percent)
    rid, = unused(docs, "rid")
    out = stage(found.filter(~F.col("kept")).select(F.col("doc_id").alias(rid)).distinct(), "rejected")
    match = F.col("doc_id").cast("long") == F.col(rid)
    left = docs.join(out, match, "left_anti")
    twice = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(rid)).count() \
        .filter("count > 1").select(rid)
    if twice.isEmpty():
        return left
    return left.join(twice, match, "left_anti").unionByName(
        left.join(twice, match, "left_semi").dropDuplicates(["doc_id"]))
