"""Inverted index tables and their statistics.

An index over one text field is four DataFrames:

    postings(doc_id, term, tf, dl[, positions])  one row per (document, term)
    doc_lengths(doc_id, dl)                      documents with >= 1 token
    term_stats(term, df, cf)                     collection statistics per term
    field_stats(n_docs, sum_ttf, avgdl)          one row

The index is *document-partitioned*: a document's terms are counted where it is read, the counted documents, one row
each, are shuffled once by ``doc_id`` and exploded on the far side; where ids repeat, their postings are summed inside
those partitions with no second exchange (hash partitioning on ``doc_id`` satisfies the clustering on
``(doc_id, term)``). Every posting of a document therefore lives in one
partition, and a ranked query joined to the postings through a broadcast query
side sums its scores by ``(query_id, doc_id)`` without any shuffle: each
partition scores its own documents completely, a partial ``WindowGroupLimit``
keeps its local best k per query, and only those rows are shuffled by
``query_id``. Hot terms do not skew the build because the key is the
document; one document is bounded by its own length. A written index keeps
this layout as buckets of ``doc_id``. ``term_stats`` is a second aggregation
keyed by term whose partial step emits at most one row per term per partition,
so a term in a third of all documents costs one row per partition to shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import analyzer as get_analyzer


def tokenize(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             analyzer="standard", keep_dl: bool = False) -> DataFrame:
    """Token table ``(doc_id, pos, term[, dl])``; pos is 0-based."""
    fn = get_analyzer(analyzer) if isinstance(analyzer, str) else analyzer
    toks = docs.select(F.col(id_col).alias("doc_id"), fn(F.col(text_col)).alias("_toks"))
    cols = [F.col("doc_id")]
    if keep_dl:
        cols.append(F.size("_toks").alias("dl"))
    # explode_outer + null filter: a plain explode makes the optimizer infer a
    # size(...) > 0 filter that re-runs the analyser below the projection.
    return (toks.select(*cols, F.posexplode_outer("_toks").alias("pos", "term"))
            .filter(F.col("pos").isNotNull()))


def build_postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   analyzer="standard", with_positions: bool = False, keep=()) -> DataFrame:
    """Postings ``(doc_id[, keep...], term, tf, dl, first_pos[, positions])``.

    ``keep`` names further columns that tell documents of one id apart; rows lie together by ``doc_id`` all the same.

    ``first_pos`` is the term's first position; exactly one posting per
    document has ``first_pos = 0``, which yields document lengths without a
    second pass over the text or another shuffle.

    Terms are counted where a document is read, so a posting is a row from the start. Only if ids repeat, which one
    aggregate over the ids tells, are the postings of equal id and length summed up on the far side of the shuffle.
    """
    fn = get_analyzer(analyzer) if isinstance(analyzer, str) else analyzer
    analysed = docs.select(F.col(id_col).alias("doc_id"), *keep, fn(F.col(text_col)).alias("_toks"))
    fields = ["term", "tf", "first_pos", *(["positions"] if with_positions else [])]
    # the counted documents are shuffled, one row each; postings are exploded on the far side
    counted = analysed.select("doc_id", *keep, F.size("_toks").alias("dl"), _counted(with_positions)("_toks").alias("_p")).repartition("doc_id")
    posts = (counted.select("doc_id", *keep, "dl", F.explode_outer("_p").alias("_p")).filter(F.col("_p").isNotNull())
             .select("doc_id", *keep, "dl", *[F.col(f"_p.{f}").alias(f) for f in fields]))
    if _repeated(docs, [id_col, *keep]):
        aggs = [F.sum("tf").alias("tf"), F.min("first_pos").alias("first_pos")]
        if with_positions:
            aggs.append(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        posts = posts.groupBy("doc_id", *keep, "term", "dl").agg(*aggs)
    return posts.select("doc_id", *keep, "term", "tf", "dl", *fields[2:])


def _repeated(docs: DataFrame, keys) -> bool:
    """Whether two rows have equal keys, nulls being equal; reads the keys only."""
    n = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (n.agg(F.max("_n")).first()[0] or 0) > 1


_TOKENS = 1 << 19  # tokens counted at once, but for one document's


def _counted(with_positions: bool):
    """A column function: a document's tokens to its different terms with tf, first position and, if asked, positions."""
    more = ",positions:array<int>" if with_positions else ""

    @F.arrow_udf(f"array<struct<term:string,tf:bigint,first_pos:int{more}>>")
    def run(toks: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        parts, low = [], 0
        while low < len(toks) or not parts:  # documents whose tokens fit together, one at least
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + _TOKENS, side="right")) - 1)
            parts.append(_count(toks[low:high], ends[low:high + 1] - ends[low], with_positions))
            low = high
        return pa.concat_arrays(parts)
    return run


def _count(toks: pa.Array, ends: np.ndarray, with_positions: bool) -> pa.Array:
    """Per list of tokens its different terms; list ``i`` is ``ends[i]:ends[i + 1]`` of all tokens."""
    terms = toks.flatten().dictionary_encode(null_encoding="encode")
    code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    key = doc * max(1, len(terms.dictionary)) + code
    order = np.argsort(key, kind="stable")  # a term's tokens stay in the order of their positions
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at = order[first]
    values = [terms.dictionary.take(pa.array(code[at])), pa.array(np.diff(np.append(first, len(order))), pa.int64()),
              pa.array((at - ends[doc[at]]).astype(np.int32))]
    if with_positions:
        values.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)),
                                               pa.array((order - ends[doc[order]]).astype(np.int32))))
    rows = pa.StructArray.from_arrays(values, names=["term", "tf", "first_pos", "positions"][:len(values)])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], np.arange(len(ends))).astype(np.int32)), rows)


def lengths_from_postings(postings: DataFrame) -> DataFrame:
    """I4 from an existing index: one row per document, no shuffle."""
    return postings.filter(F.col("first_pos") == 0).select("doc_id", "dl")


def doc_lengths(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                analyzer="standard") -> DataFrame:
    """I4: tokens per document; documents without tokens are left out."""
    fn = get_analyzer(analyzer) if isinstance(analyzer, str) else analyzer
    return (docs.select(F.col(id_col).alias("doc_id"), F.size(fn(F.col(text_col))).alias("dl"))
            .filter(F.col("dl") > 0))


def term_stats(postings: DataFrame) -> DataFrame:
    """``(term, df, cf)``."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """One row ``(n_docs, sum_ttf, avgdl)`` from document lengths."""
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("sum_ttf")).select(
        "n_docs", "sum_ttf", (F.col("sum_ttf") / F.col("n_docs")).alias("avgdl"))


POSTINGS_PER_BUCKET = 20_000_000


@dataclass
class Index:
    """The tables of one analysed text field."""

    postings: DataFrame
    doc_lengths: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    analyzer: object = "standard"

    @classmethod
    def build(cls, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              analyzer="standard", with_positions: bool = False, persist: bool = True) -> "Index":
        postings = build_postings(docs, text_col, id_col, analyzer, with_positions)
        if persist:
            postings = postings.persist(StorageLevel.MEMORY_AND_DISK)
        lengths = lengths_from_postings(postings)
        ts = term_stats(postings)
        fs = field_stats(lengths)
        if persist:
            lengths = lengths.persist(StorageLevel.MEMORY_AND_DISK)
            ts = ts.persist(StorageLevel.MEMORY_AND_DISK)
            fs = fs.persist(StorageLevel.MEMORY_AND_DISK)
        return cls(postings, lengths, ts, fs, analyzer)

    def write(self, path: str, buckets: int | None = None) -> None:
        """Persist as parquet, postings bucketed by ``doc_id`` (one file a bucket, sorted by term inside), so that a
        loaded index is as document-partitioned as a built one. Buckets follow the data unless given."""
        spark = self.postings.sparkSession
        if buckets is None:
            buckets = max(1, -(-self.postings.count() // POSTINGS_PER_BUCKET))
        name = f"quarry_write_{uuid.uuid4().hex}"
        (self.postings.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("term")
         .mode("overwrite").option("path", f"{path}/postings").saveAsTable(name))
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        self.doc_lengths.write.mode("overwrite").parquet(f"{path}/doc_lengths")
        self.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
        self.field_stats.write.mode("overwrite").parquet(f"{path}/field_stats")

    @classmethod
    def load(cls, spark, path: str, analyzer="standard") -> "Index":
        r = spark.read.parquet
        buckets = r(f"{path}/layout").first()["buckets"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r(f"{path}/postings").schema)
        name = f"quarry_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY (term) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}/postings'")
        return cls(spark.table(name), r(f"{path}/doc_lengths"), r(f"{path}/term_stats"),
                   r(f"{path}/field_stats"), analyzer)

    def stats(self) -> dict:
        """The one-row field statistics as driver scalars (n_docs, sum_ttf, avgdl)."""
        if getattr(self, "_stats", None) is None:
            r = self.field_stats.first()
            self._stats = {"n_docs": float(r["n_docs"] or 0), "sum_ttf": float(r["sum_ttf"] or 0),
                           "avgdl": float(r["avgdl"] or 0.0)}
        return self._stats

    def with_stats(self, df: DataFrame, names=("n_docs", "sum_ttf", "avgdl")) -> DataFrame:
        """Attach field statistics as literal columns (no join)."""
        st = self.stats()
        return df.select("*", *[F.lit(st[n]).alias(n) for n in names])

    def unpersist(self) -> None:
        for d in (self.postings, self.doc_lengths, self.term_stats, self.field_stats):
            d.unpersist()


def query_terms(queries: DataFrame, text_col: str = "text", id_col: str = "query_id",
                analyzer="standard") -> DataFrame:
    """Analyse a query table into ``(query_id, term, qtf)``."""
    return (tokenize(queries, text_col, id_col, analyzer)
            .withColumnRenamed("doc_id", "query_id")
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def random_queries(vocab: DataFrame, n_queries: int = 100, max_words: int = 4, seed: int = 42,
                   word_col: str = "word", rank_col: str = "r") -> DataFrame:
    """``n_queries`` queries of 1..``max_words`` vocabulary words drawn
    with seeded hashes (deterministic under retries). ``vocab`` carries a
    dense 1-based ``rank_col``; draws are joined to it by rank.
    Output ``(query_id, text)``."""
    spark = vocab.sparkSession
    v = vocab.select(F.max(rank_col)).first()[0] or 0
    if v == 0:
        return spark.createDataFrame([], "query_id long, text string")
    q = spark.range(n_queries).withColumnRenamed("id", "query_id")
    n = (F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(max_words)) + 1).cast("int")
    draws = q.select("query_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("j")).withColumn(
        "rk", F.pmod(F.xxhash64(F.lit(seed), "query_id", "j"), F.lit(v)) + 1)
    words = draws.join(vocab.select(F.col(rank_col).alias("rk"), F.col(word_col).alias("w")), "rk")
    return words.groupBy("query_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("j", "w"))), lambda s: s["w"]), " ").alias("text"))
