"""Approximate nearest neighbours by NN-descent: a neighbour graph from iterated joins, searched greedily.

Building. Equal vectors are folded into one node first. Each node starts from the neighbours found in the leaves of a
few random-hyperplane trees. Then, round by round, every node takes its neighbours and the nodes it is a neighbour of
(two joins on the edge table) and introduces them to each other: members of one list are neighbours of neighbours. A
pair is offered only if one of its edges is new and it beats the worst neighbour a member has. Rounds end when few
lists change. Long lists are dealt into sub-lists, anew each round, so a node that very many point to is not
gathered in one task, no member is left out, and members that were apart meet in a later round.

Searching. A query keeps a pool of its best nodes. Each round joins the pool's unexpanded nodes with their adjacency
and the candidates with their vectors, until nothing in the pool is unexpanded. Of the many nodes that point to a hub
the hub leads back to the nearest, and to every one that hardly any list holds if the hub is nearest to it, so each node
can be reached. The pool is scored again in double
precision on the original vectors, and nodes give way to the vectors they stand for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quarry.llm.common import broadcast_if_small, stage, unstage

#: Neighbours a node keeps; trees and leaf size of the start; members introduced at once; when to stop.
NEIGHBOURS, TREES, LEAF, LIST = 24, 5, 1024, 96
ROUNDS, SETTLED = 8, 0.02
OFFERS = 8
#: Pool of a query, and the lists that must hold a node for its way back not to matter.
POOL, KNOWN = 160, 3


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>`` of vectors that take part.

    Not null, not zero, every component present and finite, and of the commonest length.
    """
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    v = v.filter(F.exists("v", lambda x: x != 0) & ~F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = v.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).limit(1).collect()
    return v.filter(F.size("v") == (sizes[0]["s"] if sizes else 0))


def _unit(v: pd.Series) -> np.ndarray:
    a = np.stack(v.to_list()).astype(np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


@F.pandas_udf(BinaryType())
def _packed(v: pd.Series) -> pd.Series:
    return pd.Series([x.tobytes() for x in _unit(v).astype(np.float32)] if len(v) else [], dtype=object)


def nodes_of(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, unit`` (packed float32) per distinct vector, and ``vec_id, node`` for every vector."""
    keyed = v.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    first = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"))
    member = stage(keyed.select("vec_id", "k1", "k2").join(first, ["k1", "k2"]).select("vec_id", "node").distinct(),
                   "members")
    own = member.filter("vec_id = node").select("node")
    unit = v.join(own, F.col("vec_id") == F.col("node"), "left_semi").dropDuplicates(["vec_id"])
    return stage(unit.select(F.col("vec_id").alias("node"), _packed("v").alias("unit")), "nodes"), member


def _matrix(packed, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float32)


def leaf_neighbours(nodes: DataFrame, n: int, dim: int, k: int, trees: int, leaf: int) -> DataFrame:
    """``node, nbrs, sims`` from the leaves of each tree: hyperplane sign codes, crowded ones dealt by hash."""
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))

    @F.pandas_udf("array<long>")
    def codes(unit: pd.Series) -> pd.Series:
        planes = np.random.default_rng(17).standard_normal((dim, trees * depth)).astype(np.float32)
        bits = (_matrix(unit.to_list()) @ planes > 0).reshape(len(unit), trees, depth)
        return pd.Series(list((bits * (1 << np.arange(depth, dtype=np.int64))).sum(axis=2) * trees
                              + np.arange(trees)))

    coded = nodes.select("node", "unit", F.explode(codes("unit")).alias("code"))
    crowd = coded.groupBy("code").count().select(
        F.col("code").alias("c"), F.ceil(F.col("count") / (2 * leaf)).alias("parts"))
    dealt = coded.join(crowd, F.col("code") == F.col("c")).withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts")))

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        ids, x = group["node"].to_numpy(), _matrix(group["unit"].to_list())
        rows = []
        for at in range(0, len(ids), 512):
            s = x[at:at + 512] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
            m = min(k, len(ids) - 1)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.zeros((len(s), 0), int)
            rows += [(ids[at + i], ids[b], s[i, b]) for i, b in enumerate(best)]
        return pd.DataFrame(rows, columns=["node", "nbrs", "sims"])

    return (dealt.select("code", "part", "node", "unit").groupBy("code", "part")
            .applyInPandas(inside, "node long, nbrs array<long>, sims array<float>"))


def merged(offers: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all offers to each node: ``node, nbrs, sims, new``; ``new`` marks what was not ``kept``.

    ``offers`` holds ``node, nbrs, sims, kept``; a node has a bounded number of offers of bounded length each round.
    """
    def run(batches):
        for b in batches:
            rows = []
            for node, nbrs, sims, kept in zip(b["node"], b["nbrs"], b["sims"], b["kept"], strict=True):
                old = np.repeat(np.asarray(kept), [len(x) for x in nbrs])
                y, s = np.concatenate(nbrs), np.concatenate(sims)
                order = np.lexsort((~old, y))  # known edges first among copies of a neighbour
                y, s, old = y[order], s[order], old[order]
                first = np.concatenate(([True], y[1:] != y[:-1])) & (y != node)
                y, s, old = y[first], s[first], old[first]
                best = np.lexsort((y, -s))[:k]
                rows.append((node, y[best], s[best], ~old[best]))
            yield pd.DataFrame(rows, columns=["node", "nbrs", "sims", "new"])

    lists = offers.groupBy("node").agg(*[F.collect_list(c).alias(c) for c in ("nbrs", "sims", "kept")])
    return lists.mapInPandas(run, "node long, nbrs array<long>, sims array<float>, new array<boolean>")


def introduce(graph: DataFrame, nodes: DataFrame, k: int, offers: int, width: int, turn: int = 0) -> DataFrame:
    """One round of neighbours of neighbours: what the members of each list offer each other."""
    edge = graph.select("node", F.explode(F.arrays_zip("nbrs", "new")).alias("e")).select(
        "node", F.col("e.nbrs").alias("nbr"), F.col("e.new").alias("new"))
    both = edge.select(F.col("node").alias("pivot"), F.col("nbr").alias("member"), "new").unionByName(
        edge.select(F.col("nbr").alias("pivot"), F.col("node").alias("member"), "new"))
    both = both.groupBy("pivot", "member").agg(F.max("new").alias("new"))
    # lists without a new member have been introduced before
    size = (both.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("any")).filter("any")
            .select(F.col("pivot").alias("p"), F.ceil(F.col("n") / width).alias("parts")))
    half = nodes.join(graph.select(F.col("node").alias("g"), F.when(F.size("sims") < k, F.lit(-2.0)).otherwise(
        F.array_min("sims")).cast("float").alias("worst")), F.col("node") == F.col("g")).select(
        F.col("node").alias("u"), _halved("unit").alias("half"), "worst")
    lists = (both.join(size, F.col("pivot") == F.col("p")).join(half, F.col("member") == F.col("u"))
             .groupBy("pivot", F.pmod(F.xxhash64(F.lit(turn), "member"), F.col("parts")).alias("part"))
             .agg(*[F.collect_list(c).alias(c) for c in ("member", "new", "half", "worst")]))

    def run(batches):
        for b in batches:
            rows = []
            for member, new, half, worst in zip(b["member"], b["new"], b["half"], b["worst"], strict=True):
                if len(member) < 2:
                    continue
                x, new, worst, member = _matrix(list(half), np.float16), np.asarray(new), np.asarray(worst), \
                    np.asarray(member)
                s = x @ x.T
                s[~(new[:, None] | new[None, :])] = -3
                np.fill_diagonal(s, -3)
                m = min(offers, len(member) - 1)
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                got = np.take_along_axis(s, best, 1)
                good = got > worst[:, None]
                for i in np.flatnonzero(good.any(axis=1)):
                    rows.append((member[i], member[best[i, good[i]]], got[i, good[i]]))
            yield pd.DataFrame(rows, columns=["node", "nbrs", "sims"])

    return lists.select("member", "new", "half", "worst").mapInPandas(
        run, "node long, nbrs array<long>, sims array<float>")


@F.pandas_udf(BinaryType())
def _halved(unit: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.float32).astype(np.float16).tobytes() for x in unit], dtype=object)


def build_graph(nodes: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS,
                settled: float = SETTLED) -> DataFrame:
    """``node, nbrs, sims, new`` of every node, best neighbour first."""
    n = nodes.count()
    if not n:
        return nodes.select("node", F.array().cast("array<long>").alias("nbrs"),
                            F.array().cast("array<float>").alias("sims"), F.array().cast("array<boolean>").alias("new"))
    dim = len(nodes.first()["unit"]) // 4
    start = leaf_neighbours(nodes, n, dim, k, trees, leaf).withColumn("kept", F.lit(False))
    graph = stage(merged(start, k), "graph")
    for turn in range(rounds):
        offered = introduce(graph, nodes, k, OFFERS, LIST, turn).withColumn("kept", F.lit(False))
        known = graph.select("node", "nbrs", "sims", F.lit(True).alias("kept"))
        better = stage(merged(known.unionByName(offered), k), "graph")
        unstage(graph)
        graph = better
        changed = graph.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0
        if changed <= settled * n * k:
            break
    return graph


def adjacency(graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``node, adj``: a node's neighbours, the nearest ``k`` of the nodes it is a neighbour of, and of the others those
    that it is nearest to and that fewer than ``KNOWN`` lists hold."""
    e = graph.select("node", F.posexplode(F.arrays_zip("nbrs", "sims")).alias("place", "e")).select(
        F.col("e.nbrs").alias("at"), F.col("node").alias("from"), F.col("e.sims").alias("sim"), "place")
    near = Window.partitionBy("at").orderBy(F.desc("sim"), "from")
    close = e.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k).select("at", "from")
    known = e.groupBy(F.col("at").alias("held")).count().filter(F.col("count") >= KNOWN)
    hidden = (e.filter("place = 0").join(known, F.col("from") == F.col("held"), "left_anti").select("at", "from"))
    back = close.unionByName(hidden).groupBy("at").agg(F.collect_set("from").alias("back"))
    return graph.join(back, F.col("node") == F.col("at"), "left").select(
        "node", F.array_distinct(F.concat("nbrs", F.coalesce("back", F.array().cast("array<long>")))).alias("adj"))


def greedy_search(queries: DataFrame, nodes: DataFrame, adj: DataFrame, pool: int = POOL) -> DataFrame:
    """``query, pool`` (nodes, best first) from ``query, unit, start array<long>``."""
    state = stage(queries.select("query", "unit", F.array_distinct("start").alias("todo"), F.array().cast("array<long>")
                                 .alias("pool"), F.array().cast("array<float>").alias("sims"),
                                 F.array().cast("array<long>").alias("seen")), "search")
    kind = "query long, unit binary, pool array<long>, sims array<float>, seen array<long>, todo array<long>"

    def run(batches):
        for b in batches:
            rows = []
            for q, unit, old, sims, seen, ids, vecs in zip(*(b[c] for c in (
                    "query", "unit", "pool", "sims", "seen", "ids", "vecs")), strict=True):
                old, sims, seen = np.asarray(old, np.int64), np.asarray(sims, np.float32), np.asarray(seen, np.int64)
                ids = np.asarray([] if ids is None else ids, np.int64)
                fresh = ~np.isin(ids, seen)
                ids = ids[fresh]
                if len(ids):
                    got = _matrix([v for v, f in zip(vecs, fresh, strict=True) if f]) @ np.frombuffer(unit, np.float32)
                else:
                    got = np.zeros(0, np.float32)
                y, s = np.concatenate([old, ids]), np.concatenate([sims, got])
                best = np.lexsort((y, -s))[:pool]
                y, s = y[best], s[best]
                rows.append((q, unit, y, s, np.concatenate([seen, ids]), y[~np.isin(y, old)]))
            yield pd.DataFrame(rows, columns=["query", "unit", "pool", "sims", "seen", "todo"])

    ask = state.select("query", F.explode("todo").alias("y")).distinct()
    while True:  # a node is asked for once, so this ends
        found = (ask.join(nodes, F.col("y") == F.col("node")).groupBy(F.col("query").alias("q"))
                 .agg(F.collect_list("y").alias("ids"), F.collect_list(nodes["unit"]).alias("vecs")))
        nxt = stage(state.drop("todo").join(found, F.col("query") == F.col("q"), "left").drop("q")
                    .mapInPandas(run, kind), "search")
        unstage(state)
        state = nxt
        open_ = state.select("query", F.explode("todo").alias("x"))
        if open_.isEmpty():
            break
        ask = open_.join(adj, F.col("x") == F.col("node")).select("query", F.explode("adj").alias("y")).distinct()
    return state.select("query", "pool")


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, column: str = "embedding", pool: int = POOL) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``top`` nearest vectors of every row whose id is divisible by ``every``.

    Null, zero and broken vectors take no part (see :func:`usable`), neither do null ids; rows that repeat an id with
    the same vector are one vector. Equal vectors are one node of the graph, and a node gives way to its vectors with
    the smallest ids, so ties are exact. With fewer candidates than ``top`` all found are returned; an empty table
    gives an empty result. Other columns are not read.
    """
    v = stage(usable(vectors, column), "vectors")
    nodes, member = nodes_of(v)
    graph = build_graph(nodes)
    adj = stage(adjacency(graph), "adjacency")
    ask = member.filter(F.col("vec_id") % every == 0)
    start = (ask.select(F.col("node").alias("a")).distinct().join(nodes, F.col("a") == F.col("node"))
             .select(F.col("node").alias("query"), "unit", F.array("node").alias("start")))
    found = stage(greedy_search(start, nodes, adj, pool).select("query", F.explode("pool").alias("near")), "found")
    # the members of a node that can be among the nearest: one more than asked for, in case the query is one
    rank = Window.partitionBy("node").orderBy("vec_id")
    few = member.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= top + 1).select(
        F.col("node").alias("near"), F.col("vec_id"))
    pairs = ask.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(found, "query")
    one = v.dropDuplicates(["vec_id"])
    rep = one.select(F.col("vec_id").alias("i"), "v")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        x, y = (np.stack(z.to_list()).astype(np.float64) for z in (a, b))
        x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
        return pd.Series((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))))

    # the score of a pair of nodes is that of all their members, whose vectors are equal
    scored = (found.join(rep.withColumnRenamed("v", "a"), F.col("query") == F.col("i")).drop("i")
              .join(rep.withColumnRenamed("v", "b"), F.col("near") == F.col("i"))
              .select("query", "near", cosine("a", "b").alias("score")))
    full = (pairs.join(scored, ["query", "near"]).join(few, "near").filter("vec_id <> query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (full.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
