"""Byte-level BPE through sentencepiece: equal to the tiktoken library, and an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bytebpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    table = {t: i for i, t in enumerate(bytebpe.ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_round_trip_of_any_text(text):
    c = bytebpe.codec(PATH, PATTERN)
    assert c.decode(c.encode(text).tolist()) == text.encode()


def test_ids_equal_the_library(library):
    c, rnd = bytebpe.codec(PATH, PATTERN), random.Random(3)
    texts = ["", "<unk>", "▁a ▁▁", "   \n\n x", "a" * 20_000, "don't I'LL 12345", "\x00\x7f"]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 127), rnd.randint(160, 0x2FFF), 0x1F600, 32, 10]))
                      for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    for t in texts:
        assert c.encode(t).tolist() == library.encode_ordinary(t), repr(t)


def test_forgetting_pre_tokens_changes_nothing(monkeypatch):
    c = bytebpe.Codec(PATH, PATTERN)
    want = c.encode("some words and some more words").tolist()
    monkeypatch.setattr(bytebpe, "REMEMBERED", 1)
    assert all(c.encode("some words and some more words").tolist() == want for _ in range(3))


def test_operators(spark, library):
    rows = [(1, "one two"), (2, None), (3, ""), (None, "É"), (1, "one two")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bytebpe.round_trip(df, PATH, PATTERN).collect()), key=str)
    want = []
    for d, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bytebpe.decode(bytebpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t in rows]
    assert bytebpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_rank_files_must_be_whole(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="consecutive"):
        bytebpe.ranks(str(tmp_path / "r"))
