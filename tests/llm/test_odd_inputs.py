"""Every operator over ids beyond 2^53 beside nulls, repeated ids, and input columns named like its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import (ann, bytebpe, chat, fixity, ftrl, neardup, packing, quality, repair, spans, spelling, urls,
                        wrappers)

BIG = 9007199254740993  # 2^53 + 1 is not a double
CLASH = ["_rid", "_rkey", "_cid", "_ckey", "_k1", "_k2", "_cut", "node", "key", "n", "host", "spec", "word", "comp",
         "held_out", "sequence_id", "batch", "turns", "rule", "status", "at", "_w"]
VOCAB, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def clashing(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def docs(spark):
    text = "Some words here that go on for a while, long enough to be kept by rules. " * 8
    rows = [(BIG, text + "One."), (None, text), (BIG + 2, ""), (BIG + 2, None), (7, "short"), (BIG + 4, text + "One.")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return clashing(spark.createDataFrame([(BIG, 1, 0), (7, 0, 0), (BIG, 1, 0)], "doc_id long, quality int, toxic int"))


WANT = sorted([BIG, None, BIG + 2, BIG + 2, 7, BIG + 4], key=str)


@pytest.mark.parametrize("run", [
    lambda d, lab: neardup.near_duplicates(d, k=2), lambda d, lab: spans.dedup_spans(d),
    lambda d, lab: packing.pack(d, VOCAB), lambda d, lab: quality.judge(d, lab),
    lambda d, lab: bytebpe.round_trip(d, RANKS, public_tokenizers.PATTERN), lambda d, lab: ftrl.classify(d, lab),
], ids=["op3", "op5", "op7", "op8", "op9", "op11"])
def test_documents(docs, labels, run):
    assert sorted((r.doc_id for r in run(docs, labels).select("doc_id").collect()), key=str) == WANT


@pytest.mark.parametrize("run", [lambda d, lab: neardup.keep_one(d), lambda d, lab: quality.keep(d, lab),
                                 lambda d, lab: spans.dedup_spans(d, report=False)], ids=["op3", "op8", "op5"])
def test_stages_keep_their_columns(docs, labels, run):
    out = run(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= set(WANT) and all(r.node == "x7" for r in out.collect())


def test_own_columns_win_over_clashing_ones(docs):
    d = docs.withColumn("n_units", F.lit("x")).withColumn("removed", F.lit("x"))
    got = spans.dedup_spans(d).filter("doc_id = 7").first()
    assert got.n_units == 1 and got.removed == []


def test_words(docs):
    got = {r.word: r.n for r in spelling.variants(docs).collect()}
    assert got["words"] == 24


def test_pages(spark):
    rows = [(BIG, "http://a.b/c", "<article><p>Some text of this page.</p></article>"), (None, None, None),
            (BIG + 2, "x", ""), (BIG, "http://a.b/c", "<p>y</p>")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    want = sorted([BIG, None, BIG + 2, BIG], key=str)
    listed = spark.createDataFrame([("b",)], "domain string")
    archive = fixity.archive(pages)
    for out in (wrappers.main_text(pages), urls.judge(pages, [("allow", "org/")], listed), archive):
        assert sorted((r.page_id for r in out.select("page_id").collect()), key=str) == want


def test_vectors(spark):
    rows = [(BIG + i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(None, [1.0, 2.0, 3.0]), (5, None)]
    v = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = ann.nearest(v).collect()
    assert {r.query_id for r in got} == {BIG + i for i in range(60) if (BIG + i) % 50 == 0}
    assert all(BIG <= r.vec_id < BIG + 60 for r in got)


def test_conversations(spark):
    rows = [(BIG, 0, "user", "Hi."), (BIG, 1, "assistant", "Yes."), (None, 0, "user", None), (BIG + 2, None, None, "x.")]
    c = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for out in (chat.read_back(chat.format_chats(c)), repair.audit_damaged(c)):
        assert sorted((r.conv_id for r in out.select("conv_id").collect()), key=str) == sorted([BIG, None, BIG + 2], key=str)
