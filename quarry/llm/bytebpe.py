"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised field by field from the vocabulary: piece ``i`` is the byte-mapped token of rank ``i``, scored
``-i``, so that the piece merged first is the one of lowest rank; the normaliser is the identity with no dummy prefix
and no white space handling; an unknown piece follows the last rank and is never produced, since all 256 bytes are
pieces. A text is cut by the split pattern, each match is mapped to the byte alphabet and encoded on its own, and ids
are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import one_by_one
from quarry.llm.packing import byte_alphabet

#: Pre-tokens remembered per Python worker before the memory of them is dropped and built anew.
REMEMBERED = 400_000


def ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in order of rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        table = {int(r): base64.b64decode(t) for t, r in (line.split() for line in f if line.strip())}
    if sorted(table) != list(range(len(table))):
        raise ValueError("ranks must be consecutive from 0")
    if not {bytes([b]) for b in range(256)} <= set(table.values()):
        raise ValueError("every byte must be a token")
    return [table[i] for i in range(len(table))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: bytes, float or int (negative ints take ten bytes)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model with the tokens as pieces, ids equal to ranks.

    Fixed values of the public model format: ModelProto 1 pieces, 2 trainer_spec, 3 normalizer_spec; SentencePiece
    1 piece, 2 score, 3 type (1 normal, 2 unknown); TrainerSpec 3 model_type (2 BPE), 40 to 43 unk, bos, eos and pad
    id, 45 unk_piece; NormalizerSpec 1 name, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces.
    """
    sign = byte_alphabet()
    pieces = [_field(1, "".join(sign[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, 1)
              for i, t in enumerate(tokens)]
    unknown = "<unk>"
    pieces.append(_field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = (_field(3, 2) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
               + _field(45, unknown.encode()))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary; pre-tokens seen before are looked up."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        self.sign = {b: c for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, bytes] = {}

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null encodes like the empty text."""
        parts = self.split(text) if text else []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list(set(parts).difference(self.known))
        if fresh:
            mapped = [p.encode().decode("latin-1").translate(self.sign) for p in fresh]
            self.known.update((p, struct.pack(f"<{len(x)}I", *x))
                              for p, x in zip(fresh, self.model.encode(mapped, num_threads=1), strict=True))
        return b"".join(map(self.known.__getitem__, parts))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>`` of the column; a clashing ``ids`` is replaced. Null encodes like empty."""
    @F.pandas_udf("array<int>")
    def run(text: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.encode(t).astype(np.int32) for t in text])

    return docs.withColumn("ids", run(column))


def decode(docs: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """``docs`` with ``decoded binary`` of an array of ids; null decodes to no bytes."""
    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.decode(x) if x is not None else b"" for x in ids])

    return docs.withColumn("decoded", run(column))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: encoded, then decoded from the ids alone.

    Digests are taken where the ids are made, so ids are never moved. Null and empty texts give no tokens and the
    digests of nothing; repeated rows and null ``doc_id`` are treated like any row; other columns are not read.
    """
    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            rows = []
            for t in one_by_one(b.column("text")):
                ids = c.packed(t)
                back = c.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            if not rows:
                continue
            found = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()),
                                                    strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *found],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
