"""Operator 1: byte-level BPE encoding and decoding.

A rank file (base64 token, rank) becomes a sentencepiece BPE model without any
training: each token's bytes are mapped one to one to printable characters, its
piece scores the negative rank, and normalisation is the identity.  A text is
cut into pre-tokens by the tokenizer's pattern; each is byte-mapped and merged
by sentencepiece, whose best-score-first, leftmost merging is the rank order.
Decoding looks the bytes of every id up.

Defined results: a null or empty text has no ids (empty array), null ids decode
to null, repeated rows give the same ids each.  A pre-token that is a token
itself is that token, also where merging alone would not reach it.  An id that
the vocabulary lacks raises an error when decoded.  Texts of any length are
processed whole, document by document; the memo of pre-tokens is bounded by
``MEMO_ENTRIES`` and changes no result.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO_ENTRIES = 200_000  # pre-tokens remembered per Python worker
MEMO_LENGTH = 48  # longer pre-tokens are not remembered
RUN_CHARS = 1_000_000  # characters of consecutive texts encoded together


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a rank file; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if any(not t for t in tokens) or len({t for t in tokens if len(t) == 1}) != 256:
        raise ValueError("ranks must run from 0 without gaps and hold all 256 bytes")
    return tokens


def byte_characters() -> list[str]:
    """A distinct character for every byte, none of them white space: bytes that
    are visible in Latin-1 stand for themselves, the rest follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & 0xFFFFFFFFFFFFFFFF)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks.

    Fixed values of the published message format: pieces are field 1 (piece 1,
    score 2, type 3 with NORMAL 1 and UNKNOWN 2); the trainer's settings field 2
    (model_type 3 with BPE 2, vocab_size 4, unk/bos/eos/pad ids 40 to 43); the
    normaliser's field 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces
    4, escape_whitespaces 5).
    """
    chars = byte_characters()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    out = [piece("".join(chars[b] for b in t), -float(rank), 1) for rank, t in enumerate(tokens)]
    n = len(tokens)
    out.append(piece("<unk>", 0.0, 2))
    out.append(_bytes(2, _number(3, 2) + _number(4, n + 1) + _number(40, n) + b"".join(_number(k, -1) for k in (41, 42, 43))))
    out.append(_bytes(3, _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Codec:
    """Encoder and decoder of one vocabulary, built once per Python worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        chars = byte_characters()
        self.mapped = {b: c for b, c in enumerate(chars)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.memo: dict[str, tuple[int, ...]] = {}

    def encode_all(self, texts: Iterator[str | None]) -> Iterator[list[int]]:
        """Ids of every text, in order.  The pre-tokens that a run of texts adds
        go to the merger in one call."""
        run, size = [], 0
        for text in texts:
            run.append(self.split(text) if text else [])
            size += len(text or "")
            if size >= RUN_CHARS:
                yield from self._encode_run(run)
                run, size = [], 0
        yield from self._encode_run(run)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all(iter([text])))

    def _encode_run(self, run: list[list[str]]) -> Iterator[list[int]]:
        known = self.memo
        if len(known) > MEMO_ENTRIES:
            known.clear()
        merge = []
        for p in set(chain.from_iterable(run)).difference(known):
            rank = self.whole.get(p.encode())
            if rank is None:
                merge.append(p)
            else:
                known[p] = (rank,)
        if merge:
            mapped = [p.encode().decode("latin-1").translate(self.mapped) for p in merge]
            known.update(zip(merge, map(tuple, self.model.encode(mapped, num_threads=1))))
        for pieces in run:
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))
        for p in merge:
            if len(p) > MEMO_LENGTH:
                del known[p]

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise IndexError("negative token id")
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict = {}


def codec(tokens, pattern: str, key: str) -> Codec:
    """The worker's codec for the broadcast vocabulary ``tokens``."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens.value, pattern)
    return _CODECS[key]


class ByteBpe:
    """Columns that encode and decode with the vocabulary in ``path`` (read on
    the driver and broadcast: its size is the file's, whatever the corpus)."""

    MOST_BYTES = 64_000_000

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        if sum(map(len, tokens)) > self.MOST_BYTES:
            raise ValueError(f"{path} is no vocabulary: over {self.MOST_BYTES} bytes")
        shared = spark.sparkContext.broadcast(tokens)
        key = f"{path}|{len(tokens)}|{pattern}"

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(shared, pattern, key)
            for texts in batches:
                offsets, ids = [0], array("i")
                for own_ids in own.encode_all(t.as_py() for t in texts):
                    ids.extend(own_ids)
                    offsets.append(len(ids))
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))

        @F.arrow_udf("binary")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = codec(shared, pattern, key)
            for lists in batches:
                # as_py() would make a scalar of every id
                yield pa.array((own.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists), pa.binary())

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Text to array<int>."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """array<int> to the binary it stands for."""
        return self._decode(ids)


def token_digests(encoded: DataFrame, ids: str, decoded: str) -> tuple[Column, Column, Column]:
    """n_tokens, the hash of the decimal ids, and the hash of the decoded bytes."""
    return (
        F.size(ids).cast("long"),
        F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")).cast("binary"), 256),
        F.sha2(F.col(decoded), 256),
    )
