"""Vocabularies, id encoding and training-example tables.

Global ordinals (vocabulary ids, line numbers) are assigned without a
single-partition window: rows are range-partitioned and sorted by the order
key, each partition is counted, the few partition offsets come back to the
driver, and every row gets ``offset(partition) + position in partition``.
The sorted frame is checkpointed first so both passes see identical partitions
(and so lost executors recompute nothing upstream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.index import _repeated
from quarry.session import checked_broadcast, cut_lineage

UNK, EOS, GO = "<unk>", "<eos>", "<go>"


def global_ordinal(df: DataFrame, order_cols, out: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """1-based dense row number over the whole frame by ``order_cols`` (which must
    give a total order), computed with range partitions, not one task."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("m")).collect()
    counts = sorted((r["_pid"], r["n"], r["m"]) for r in counts)  # at most `n` rows
    off, start = {}, 0
    for pid, cnt, m in counts:
        off[pid] = (start, m)
        start += cnt
    base = F.create_map(*[x for pid, (s, m) in off.items() for x in (F.lit(pid), F.lit(s - m))]) \
        if off else F.create_map().cast("map<int,bigint>")
    return ranged.withColumn(out, F.col("_mid") + F.element_at(base, F.col("_pid")) + 1).drop("_pid", "_mid")


def build_vocab(term_counts: DataFrame, max_size: int, reserved=(UNK, EOS, GO)) -> DataFrame:
    """Keep the top ``max_size`` words by frequency (ties
    alphabetical), then number them alphabetically after the reserved
    symbols. ``term_counts(word, freq)``; output ``(word, id, freq)``.

    Both the frequency cut and the alphabetical ids use :func:`global_ordinal`
    (range partitions), so no step gathers the vocabulary in one task.
    """
    spark = term_counts.sparkSession
    res = list(reserved)
    kept = term_counts.filter(~F.col("word").isin(res)) if res else term_counts
    kept = global_ordinal(kept, [F.col("freq").desc(), F.col("word").asc()], out="_f")
    kept = kept.filter(F.col("_f") <= max_size).drop("_f")
    ids = global_ordinal(kept, [F.col("word").asc()], out="ordinal")
    ids = ids.select("word", (F.col("ordinal") + len(reserved) - 1).cast("int").alias("id"), "freq")
    head = spark.createDataFrame([(w, i, None) for i, w in enumerate(reserved)], "word string, id int, freq bigint")
    return head.unionByName(ids.select("word", "id", F.col("freq").cast("long")))


def encode(tokens: DataFrame, vocab: DataFrame, row_size: int = 40, key="line_id") -> DataFrame:
    """Ids of the first ``row_size - 1`` tokens, unknown → 0.

    ``tokens(*key, pos, word)``; output ``(*key, ids array<int>)``. The
    vocabulary is joined by word (broadcast only behind its size check).
    """
    keys = [key] if isinstance(key, str) else list(key)
    t = tokens.filter(F.col("pos") < row_size - 1)
    j = t.join(checked_broadcast(vocab.select("word", "id")), "word", "left").withColumn(
        "id", F.coalesce("id", F.lit(0)))
    return j.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))),
                                            lambda s: s["id"]).alias("ids"))


def encode_lines(lines: DataFrame, tokens_col, vocab: DataFrame, key, row_size: int = 40) -> DataFrame:
    """T2 over a line table: ``(*key, ids)`` for every line, empty lines → ``[]``."""
    keys = [key] if isinstance(key, str) else list(key)
    toks = lines.select(*keys, F.posexplode(tokens_col).alias("pos", "word"))
    enc = encode(toks, vocab, row_size, keys)
    return lines.select(*keys).join(enc, keys, "left").select(
        *keys, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(ids: DataFrame, vocab: DataFrame, key="line_id") -> DataFrame:
    """``(*key, ids)`` back to words joined by blanks."""
    keys = [key] if isinstance(key, str) else list(key)
    e = ids.select(*keys, F.posexplode("ids").alias("pos", "id"))
    j = e.join(checked_broadcast(vocab.select("word", "id")), "id", "left")
    d = j.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))),
                                                      lambda s: s["word"]), " ").alias("text"))
    return ids.select(*keys).join(d, keys, "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"))


def seq2seq_rows(src_ids, tgt_ids, eos: int = 1, go: int = 2):
    """T4 columns: reversed input, target + <eos>, <go> + target, lengths."""
    return [F.reverse(src_ids).alias("input"), F.concat(tgt_ids, F.array(F.lit(eos))).alias("target"),
            F.concat(F.array(F.lit(go)), tgt_ids).alias("decoder_input"),
            F.size(src_ids).alias("input_len"), (F.size(tgt_ids) + 1).alias("target_len")]


def global_prefix_sum(df: DataFrame, key: str, value_col: str, out: str = "start",
                      partitions: int | None = None) -> tuple[DataFrame, int]:
    """Exclusive running sum of ``value_col`` in ``key`` order over the whole
    frame, plus the grand total. Works on the narrow ``(key, value)`` frame:
    range partitions by key, per-partition totals (one row per partition) to
    the driver, a within-partition running sum, then ``offset(partition)``."""
    from pyspark.sql import Window

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.select(key, value_col).repartitionByRange(n, F.col(key))
                         .withColumn("_pid", F.spark_partition_id()))
    sums = sorted((r["_pid"], r["s"] or 0) for r in ranged.groupBy("_pid").agg(F.sum(value_col).alias("s")).collect())
    off, acc = [], 0
    for pid, s in sums:
        off += [F.lit(pid), F.lit(acc)]
        acc += s
    base = F.create_map(*off) if off else F.create_map().cast("map<int,bigint>")
    w = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    r = ranged.withColumn(out, F.coalesce(F.sum(value_col).over(w), F.lit(0)) + F.element_at(base, F.col("_pid")))
    return r.select(key, out), acc


def char_windows(docs: DataFrame, length: int, key: str = "doc_id", text_col: str = "text",
                 seed: int = 12345) -> DataFrame:
    """The texts, each followed by a newline, in ``key`` order form one
    character stream; window ``i`` covers offsets ``[i·L, (i+1)·L)`` for
    ``i < (N − 1) / L − 2`` and yields ``input`` = its first L−1 characters,
    ``target`` = the L−1 characters after the first one. ``shuffle`` is a
    seeded hash giving the example order.

    A document is cut at the bounds of the windows by one pass of a regular expression, linear in the text. A window that
    lies inside one document is a row at once; only the pieces at the ends of documents are grouped by window. Texts move
    as strings, and only if the starts are too many to be broadcast. Where keys repeat, all pieces are grouped.
    """
    L = F.lit(length).cast("long")
    texts = docs.select(F.col(key).alias("_k"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("_t"))
    starts, total = global_prefix_sum(texts.select("_k", F.char_length("_t").cast("long").alias("_n")), "_k", "_n", "_s")
    n_windows = max((total - 1) // length - 2, 0)
    at = F.col("_s") % L
    head = F.when(at > 0, L - at).otherwise(0).cast("int")  # characters before the first bound
    # cut by the expression and not by places: a substring is found by counting from the start of its text
    cut = F.regexp_extract_all(F.substr("_t", head + 1), F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
    first = F.floor((F.col("_s") + L - 1) / L)
    piece = lambda w, a, x: F.struct(w.cast("long").alias("window_id"), a.cast("long").alias("at"), x.alias("piece"))
    pieces = F.concat(F.when(at > 0, F.array(piece(first - 1, at, F.substr("_t", F.lit(1), head)))).otherwise(
        F.array().cast("array<struct<window_id:bigint,at:bigint,piece:string>>")),
        F.transform(cut, lambda x, i: piece(first + i, F.lit(0), x)))
    c = texts.join(checked_broadcast(starts), "_k")
    p = c.select(F.explode(pieces).alias("p")).select("p.*").filter(F.col("window_id") < n_windows)
    whole = F.lit(False) if _repeated(docs, [key]) else F.char_length("piece") == length
    joined = p.filter(~whole).groupBy("window_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"]), "").alias("w"))
    wins = p.filter(whole).select("window_id", F.col("piece").alias("w")).unionByName(joined)
    return wins.select("window_id", F.substring("w", 1, length - 1).alias("input"),
                       F.substring("w", 2, length - 1).alias("target"),
                       F.xxhash64(F.lit(seed), "window_id").alias("shuffle"))
