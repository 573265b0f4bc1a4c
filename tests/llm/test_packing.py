"""Packing: ids, pieces, gapless sequences, and the local search against an exact bound."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import packing

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_library(tokenizer):
    rnd = random.Random(6)
    texts = ["", "Hello  world\n\n x", "<|endoftext|>", "ÉÄ ñ 漢字 🙂", "a" * 5000]
    texts += ["".join(rnd.choice("ab C\n\t'sé漢1 .") for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert packing.token_ids(t, VOCAB).tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [0]


def test_added_tokens_get_the_ids_of_the_library_by_default(spark):
    from tokenizers import Tokenizer

    default, rnd = Tokenizer.from_file(VOCAB), random.Random(10)
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|>x", "<|endoftext|", "<|EndOfText|>"]
    texts += ["".join(rnd.choice(["a", " ", "é", "\n", "<|", "<|endoftext|>"]) for _ in range(rnd.randint(1, 30)))
              for _ in range(300)]
    want = [default.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [64, 50256, 65, 0]
    for t, ids in zip(texts, want, strict=True):
        assert packing.token_ids(t, VOCAB, added=True).tolist() == ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(df, VOCAB).collect()}
    assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in enumerate(want)}


def test_only_long_documents_are_cut():
    assert packing.cuts(2048, 2048) == [(0, 2048)]
    assert packing.cuts(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.cuts(4096, 2048) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("seed", range(6))
def test_search_never_needs_more_bins_and_keeps_all_items(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 99), rnd.randint(30, 70)]) for _ in range(400)]
    bins = packing.Bins(sizes, 100)
    bins.best_fit()
    before, squares = sum(f > 0 for f in bins.fill), sum(f * f for f in bins.fill)
    bins.search()
    assert sum(f > 0 for f in bins.fill) <= before and sum(f * f for f in bins.fill) >= squares
    assert sorted(i for b in bins.items for i in b) == list(range(400))
    assert all(f == sum(sizes[i] for i in b) <= 100 for f, b in zip(bins.fill, bins.items, strict=True))


def test_search_empties_a_bin_that_best_fit_leaves():
    # best fit decreasing makes four bins of these; three suffice
    sizes = [18, 16, 33, 20, 15, 47, 55, 26, 30, 32]
    bins = packing.Bins(sizes, 100)
    bins.best_fit()
    start = sum(f > 0 for f in bins.fill)
    bins.search()
    assert start == 4 and sum(f > 0 for f in bins.fill) == math.ceil(sum(sizes) / 100) == 3


def test_pack_places_every_piece_without_gaps(spark, tokenizer):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["to", "pack", "Zebra", "ññ"]) for _ in range(rnd.choice([3, 50, 400, 3000]))))
            for i in range(300)]
    rows += [(1000, None), (1001, ""), (5, rows[5][1]), (None, "no id")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, length string, piece int")
    got = packing.pack(df, VOCAB, block=64).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for i, (s, n) in enumerate(packing.cuts(len(ids), 2048)):
            want[d, i, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    short = [r.length for r in got if r.length < 2048]
    at_once = len(set(packing.pack_block(short)[0])) + sum(r.length == 2048 for r in got)
    assert len(by) <= at_once + 3  # small blocks lose next to nothing against one block of everything


def test_items_that_cannot_share_a_bin_end(spark):
    df = spark.createDataFrame([(i, "a " * 1200) for i in range(40)], "doc_id long, text string")
    got = packing.pack(df, VOCAB, block=4).collect()
    assert len({r.sequence_id for r in got}) == 40


def test_sequences_hold_the_ids(spark, tokenizer):
    df = spark.createDataFrame([(1, "one two"), (2, "three " * 3000), (3, "")], "doc_id long, text string")
    placed = packing.pack(df, VOCAB)
    got = [list(r.ids) for r in packing.sequences(df, placed, VOCAB).collect()]
    want = sorted(x for t in ("one two", "three " * 3000, "")
                  for x in tokenizer.encode(t, add_special_tokens=False).ids + [0])
    assert sorted(x for s in got for x in s) == want and max(map(len, got)) <= 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCAB).count() == 0
