"""Element-wise aggregation of vector columns.

Vectors are exploded to ``(key, dim, value)`` and summed by ``(key, dim)``: the
partial aggregate collapses each partition to at most ``keys × d`` rows before
the shuffle, so a hot key (a label holding a third of all rows) costs ``d`` rows
per partition, and the result is re-assembled per key from ``d`` small rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checked_broadcast, cut_lineage

#: Word vectors up to this many bytes are shipped to the tasks; beyond, rows and vectors meet in a shuffle join.
#: The driver holds them about three times besides its heap.
SHIPPED_BYTES = 128 << 20
_ROWS = 1 << 15  # vectors gathered at once for one document
#: Queries' words up to this many rows are shipped to the tasks, which then keep the best documents of each query.
ASKED_ROWS = 2_000_000
_PAIRS = 1 << 20  # scores of a query and a document held at once, but for one document's


def explode_vector(df: DataFrame, vec_col: str, keep=()) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(vec_col).alias("dim", "value")).filter(F.col("dim").isNotNull())


def assemble(long_df: DataFrame, keys, value_col: str = "value", out: str = "vector") -> DataFrame:
    """``(keys..., dim, value)`` → ``(keys..., vector)`` ordered by dim."""
    keys = list(keys)
    return long_df.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", value_col))), lambda s: s[value_col]).alias(out))


def vector_sum_long(df: DataFrame, keys, vec_col: str, weight=None, mean: bool = False,
                    out: str = "vector") -> DataFrame:
    """Weighted element-wise sum (or mean) by exploding to ``(key, dim)`` rows."""
    keys = list(keys)
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    x = (df.select(*keys, w.cast("double").alias("_w"), F.posexplode_outer(vec_col).alias("dim", "value"))
         .filter(F.col("dim").isNotNull()))
    agg = F.sum(F.col("value").cast("double") * F.col("_w"))
    if mean:
        agg = agg / F.sum("_w")
    return assemble(x.groupBy(*keys, "dim").agg(agg.alias("value")), keys, "value", out)


def vector_sum(df: DataFrame, keys, vec_col: str, weight=None, mean: bool = False,
               out: str = "vector") -> DataFrame:
    """Weighted element-wise sum (or weighted mean) of ``vec_col`` per key.

    Uses MLlib's ``Summarizer`` (a JVM aggregate with a partial step of width
    ``d`` per key and partition), so a hot key never gathers its rows in one
    task. Returns ``array<double>``.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    keys = list(keys)
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    v = array_to_vector(F.transform(F.col(vec_col), lambda x: x.cast("double")))
    metric = Summarizer.mean(v, w.cast("double")) if mean else Summarizer.sum(v, w.cast("double"))
    return df.groupBy(*keys).agg(vector_to_array(metric).alias(out))


class ShippedWords:
    """Word vectors in every task, so that a document's terms meet them where the document lies.

    ``ids`` is ``(term, wid)``, one row per word vector that is not null; ``matrix`` holds the vectors, row ``wid``. A
    term row thus carries a number in place of a vector, and no vector is shuffled but a document's sum.
    """

    def __init__(self, ids: DataFrame, matrix):
        self.ids, self.matrix = ids, matrix

    @classmethod
    def of(cls, word_vectors: DataFrame, max_bytes: int | None = None) -> "ShippedWords | None":
        """``word_vectors(word, vector)``; None if the vectors take more than ``max_bytes``."""
        words = word_vectors.select(F.col("word").alias("term"), "vector").filter(F.col("vector").isNotNull())
        single = F.transform("vector", lambda x: x.cast("float"))
        n, dim, narrow = words.agg(
            F.count(F.lit(1)), F.max(F.size("vector")),
            F.bool_and(F.transform(single, lambda x: x.cast("double")) == F.transform("vector", lambda x: x.cast("double")))).first()
        if n * (dim or 0) * (4 if narrow else 8) > (SHIPPED_BYTES if max_bytes is None else max_bytes):
            return None
        kind = "float" if narrow else "double"  # vectors stored in single precision are shipped so, losing nothing
        words = cut_lineage(words.withColumn("_id", F.monotonically_increasing_id()))
        got = words.select("_id", F.transform("vector", lambda x: x.cast(kind)).alias("v")).toArrow()
        row, matrix, at = got.column("_id").to_numpy(), np.empty((n, dim or 0), np.float32 if narrow else np.float64), 0
        for v in got.column("v").chunks:  # no second copy of all
            matrix[at:at + len(v)] = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim or 0)
            at += len(v)
        del got
        if (np.diff(row) < 0).any():
            order = np.argsort(row)
            row, matrix = row[order], matrix[order]
        shared = words.sparkSession.sparkContext.broadcast((row, matrix))
        return cls(checked_broadcast(words.select("term", F.col("_id").alias("wid"))), shared)

    def documents(self, rows: DataFrame, keys, weight=None, distinct: bool = False, asked: DataFrame | None = None) -> DataFrame:
        """``(keys..., wids, weights[, asked])``: a row for each document with a known term.

        ``rows`` is ``(keys..., term)``. ``distinct`` counts a term once. ``asked`` lists the numbers of the document's
        terms that are in ``asked(term)``. Rows that lie together by the keys are not shuffled.
        """
        ids = self.ids
        if asked is not None:
            known = asked.select("term").distinct().withColumn("_q", F.lit(True))
            ids = checked_broadcast(ids.join(known, "term", "left"))
        j = rows.join(ids, "term")
        g = j.groupBy(*keys)
        if distinct:
            return g.agg(F.collect_set("wid").alias("wids")).withColumn(
                "weights", F.array_repeat(F.lit(1.0), F.size("wids")))
        w = F.lit(1.0) if weight is None else weight
        more = [] if asked is None else [F.collect_list(F.when(F.col("_q"), F.col("wid"))).alias("asked")]
        return g.agg(F.collect_list("wid").alias("wids"), F.collect_list(w.cast("double")).alias("weights"), *more)

    def total(self, wids="wids", weights="weights"):
        """The weighted sum of a document's word vectors, ``array<double>``."""
        shared = self.matrix

        @F.arrow_udf("array<double>")
        def run(wids: pa.Array, weights: pa.Array) -> pa.Array:
            sums = _sums(shared.value, wids, weights)
            return pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1], pa.array(sums.ravel()))
        return run(wids, weights)

    def cosines(self, wids="wids", weights="weights", asked="asked"):
        """Per asked word the cosine of its vector and the document's weighted sum; null where one of them is zero."""
        shared = self.matrix

        @F.arrow_udf("array<double>")
        def run(wids: pa.Array, weights: pa.Array, asked: pa.Array) -> pa.Array:
            names, matrix = shared.value
            return _compare(names, matrix, _sums(shared.value, wids, weights), asked)
        return run(wids, weights, asked)

    def near(self, vector, asked="asked"):
        """Per asked vector of the table its cosine with ``vector``; null where one of them is zero."""
        shared = self.matrix

        @F.arrow_udf("array<double>")
        def run(vector: pa.Array, asked: pa.Array) -> pa.Array:
            names, matrix = shared.value
            return _compare(names, matrix, (v.values.to_numpy() for v in vector), asked)
        return run(vector, asked)


def _compare(names: np.ndarray, matrix: np.ndarray, vectors, asked: pa.Array) -> pa.Array:
    at, ends = np.searchsorted(names, _flat(asked)), _ends(asked)
    out = np.zeros(len(at))
    for i, v in enumerate(vectors):
        d = np.linalg.norm(v)
        for s in range(ends[i], ends[i + 1], _ROWS):
            e = min(s + _ROWS, ends[i + 1])
            q = matrix[at[s:e]].astype(np.float64)
            n = np.sqrt((q * q).sum(axis=1)) * d
            out[s:e] = np.divide(q @ v, n, out=np.full(e - s, np.nan), where=n > 0)
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(out, mask=np.isnan(out)))


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _ends(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def _sums(words, wids: pa.Array, weights: pa.Array) -> np.ndarray:
    names, matrix = words
    at, w, ends = np.searchsorted(names, _flat(wids)), _flat(weights), _ends(wids)
    sums = np.zeros((len(wids), matrix.shape[1]))
    for i in range(len(wids)):
        for s in range(ends[i], ends[i + 1], _ROWS):
            e = min(s + _ROWS, ends[i + 1])
            sums[i] += w[s:e] @ matrix[at[s:e]].astype(np.float64)
    return sums


def word_vector_sum(rows: DataFrame, word_vectors: DataFrame, keys, weight=None, distinct: bool = False,
                    mean: bool = False, out: str = "vector") -> DataFrame:
    """Weighted sum (or mean) of the word vectors of ``rows(keys..., term)`` per key; keys without known terms are absent.

    ``distinct`` counts a key's term once, with weight 1. Nothing but term numbers and weights moves, and these only if
    the rows do not lie together by the keys; word vectors beyond ``SHIPPED_BYTES`` are joined and shuffled instead.
    """
    keys = list(keys)
    shipped = ShippedWords.of(word_vectors)
    if shipped is None:
        t = rows.select(*keys, "term", (F.lit(1.0) if weight is None else weight).alias("_w"))
        if distinct:
            t = t.select(*keys, "term", F.lit(1.0).alias("_w")).distinct()
        j = t.join(word_vectors.select(F.col("word").alias("term"), "vector").filter(F.col("vector").isNotNull()), "term")
        return vector_sum(j, keys, "vector", weight="_w", mean=mean, out=out)
    d = shipped.documents(rows, keys, weight, distinct)
    v = d.select(*keys, "weights", shipped.total().alias(out))
    if mean:
        n = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
        v = v.select(*keys, n.alias("_n"), out).select(*keys, F.transform(out, lambda x: x / F.col("_n")).alias(out))
    return v.select(*keys, out)


def _best_documents(matrix, asks, keep: int, id_type):
    """Cosine sums of the rows of :meth:`ShippedWords.documents`, of which a task keeps the best ``keep`` of each query.

    They are ranked by rounded score and then by id, nulls as Spark ranks them.
    """
    def cut(t: pa.Table) -> pa.Table:
        score = t["score"].to_numpy()
        by = t.append_column("by", pa.array(np.where(np.isnan(score), np.inf, -np.round(score, 9))))
        t = t.take(pc.sort_indices(by, [("q", "ascending"), ("by", "ascending"), ("id", "ascending")], null_placement="at_start"))
        q = t["q"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return t.filter(pa.array(rank < keep))

    def scores(b: pa.RecordBatch, wid: np.ndarray, first: np.ndarray, last: np.ndarray, query: np.ndarray):
        names, vectors = matrix.value
        asked = b.column("asked")
        cosine = _flat(_compare(names, vectors, _sums(matrix.value, b.column("wids"), b.column("weights")), asked))
        at, doc = np.searchsorted(wid, _flat(asked)), np.repeat(np.arange(len(b)), np.diff(_ends(asked)))
        n = last[at] - first[at]
        ends, pairs = np.searchsorted(doc, np.arange(len(b)), side="right"), np.append(0, np.cumsum(n))
        low = 0
        while low < len(b):  # documents whose pairs fit together, one at least
            s = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(pairs[ends], pairs[s] + _PAIRS, side="right")))
            e = ends[high - 1]
            each = np.arange(pairs[e] - pairs[s]) - np.repeat(pairs[s:e] - pairs[s], n[s:e])
            q = query[np.repeat(first[at[s:e]], n[s:e]) + each]
            d, c = np.repeat(doc[s:e], n[s:e]), np.repeat(cosine[s:e], n[s:e])
            known = ~np.isnan(c)
            key, place = np.unique(d * (query.max() + 1) + q, return_inverse=True)
            total = np.bincount(place[known], c[known], len(key))
            total[np.bincount(place[known], minlength=len(key)) == 0] = np.nan  # no cosine at all
            yield key // (query.max() + 1), key % (query.max() + 1), total
            low = high

    def run(batches):
        ids, wid, first, last, query = asks.value
        held = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], id_type), "score": pa.array([], pa.float64())})
        for b in batches:
            for d, q, score in scores(b, wid, first, last, query):
                held = pa.concat_tables([held, pa.table([pa.array(q, pa.int64()), b.column("doc_id").take(pa.array(d)).cast(id_type), pa.array(score)], names=["q", "id", "score"])])
                if len(held) > _PAIRS:
                    held = cut(held)
        if len(held):
            t = cut(held)
            score = t["score"].to_numpy()
            out = pa.table([ids.take(t["q"].combine_chunks()), t["id"], pa.array(score, mask=np.isnan(score))], names=["query_id", "doc_id", "score"])
            yield from out.combine_chunks().to_batches()

    return run


def word_cosine_sum(rows: DataFrame, qterms: DataFrame, word_vectors: DataFrame, keys, weight, best: int | None = None) -> DataFrame:
    """``(query_id, keys..., score)``: Σ over the query's terms in the document of cos(word vector, document vector).

    The document vector is the weighted sum over ``rows(keys..., term)``; ``qterms`` is ``(query_id, term)``, distinct.
    A cosine does not depend on the query, so it is computed once per document and asked term. Rows that lie together by
    the keys are not shuffled; what moves is one partial sum per query and document. With ``best`` and the single key
    ``doc_id``, rows that cannot be among the ``best`` of their query by score and id may be left out: each task then
    drops them, and nothing moves.
    """
    from quarry.functions import vectors as VX

    keys = list(keys)
    shipped = ShippedWords.of(word_vectors)
    qt = checked_broadcast(qterms)
    if shipped is None:
        wv = word_vectors.select(F.col("word").alias("term"), "vector").filter(F.col("vector").isNotNull())
        dv = vector_sum(rows.withColumn("_w", weight).join(wv, "term"), keys, "vector", weight="_w", out="dvec")
        hit = rows.select(*keys, "term").join(checked_broadcast(qterms.select("term").distinct()), "term", "left_semi")
        c = hit.join(dv, keys).join(wv, "term").select(*keys, "term", VX.cosine("vector", "dvec").alias("c"))
        return c.join(qt, "term").groupBy("query_id", *keys).agg(F.sum("c").alias("score"))
    d = shipped.documents(rows, keys, weight, asked=qterms.select("term")).filter(F.size("asked") > 0)
    if best is not None and keys == ["doc_id"]:
        pairs = qterms.select("query_id", "term").join(shipped.ids, "term").select("query_id", "wid")
        if pairs.count() <= ASKED_ROWS:
            return _scores_kept(d, pairs, shipped.matrix, best)
    c = d.select(*keys, F.explode(F.arrays_zip("asked", shipped.cosines().alias("c"))).alias("x")).select(
        *keys, F.col("x.asked").alias("wid"), F.col("x.c").alias("c"))
    asks = checked_broadcast(qterms.select("query_id", "term").join(shipped.ids, "term").select("query_id", "wid"))
    return c.join(asks, "wid").groupBy("query_id", *keys).agg(F.sum("c").alias("score"))


def _scores_kept(documents: DataFrame, pairs: DataFrame, matrix, best: int) -> DataFrame:
    """``(query_id, doc_id, score)`` of the best documents of each query in each task; ``pairs`` is ``(query_id, wid)``."""
    from pyspark.sql.pandas.types import to_arrow_type

    got = pairs.toArrow()
    number = got.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    query, wid = number.indices.to_numpy().astype(np.int64), got.column("wid").to_numpy()
    order = np.argsort(wid, kind="stable")
    names, first, n = np.unique(wid[order], return_index=True, return_counts=True)
    shared = documents.sparkSession.sparkContext.broadcast((number.dictionary, names, first, first + n, query[order]))
    kind = documents.schema["doc_id"].dataType
    return documents.mapInArrow(_best_documents(matrix, shared, best, to_arrow_type(kind)),
                                f"query_id {pairs.schema['query_id'].dataType.simpleString()}, doc_id {kind.simpleString()}, score double")
