"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Each byte b of a token is mapped to the character U+0100 + b; a token's piece is its mapped bytes and its score the
negative rank, under identity normalisation. The BPE of sentencepiece then merges the best-scored neighbours first,
which is the order of the ranks. Texts are split by a pattern, each match is encoded separately, and ids are decoded by
the inverse mapping from id to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from pathlib import Path

from pyspark.sql import DataFrame

from .common import map_rows, per_worker

#: Pre-tokens that a worker keeps encoded; the store is emptied beyond it. Longer pre-tokens are not kept.
KEPT, KEPT_CHARS = 200_000, 128
BYTE_CHARS = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    ranks = [(int(r), base64.b64decode(t)) for t, r in (x.split() for x in Path(path).read_bytes().splitlines() if x)]
    ranks.sort()
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks are not contiguous")
    return [t for _, t in ranks]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(BYTE_CHARS)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto of type BPE: piece i is token i with score -i; one more piece is the unknown one."""
    score = _varint(2 << 3 | 5)
    pieces = [_bytes(1, _bytes(1, mapped(t).encode()) + score + struct.pack("<f", -float(i))) for i, t in enumerate(tokens)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + score + struct.pack("<f", 0.0) + _int(3, 2)))
    trainer = _int(3, 2) + _int(4, len(pieces)) + _int(40, len(tokens)) + b"".join(_int(f, -1) for f in (41, 42, 43))
    normal = _bytes(1, b"identity") + b"".join(_int(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normal)


class Codec:
    """Encodes pre-tokens and keeps what it has encoded: pre-token -> (number of ids, ids as text, decoded bytes)."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.tokens, self.split = tokens, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.kept: dict[str, tuple[int, str, bytes]] = {}

    def ids(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.model.encode(mapped(p.encode()))]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def _piece(self, pre: str) -> tuple[int, str, bytes]:
        ids = self.model.encode(mapped(pre.encode()))
        value = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(pre) <= KEPT_CHARS:
            self.kept[pre] = value
        return value

    def row(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the bytes decoded from them."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        get, make = self.kept.get, self._piece
        parts = [get(p) or make(p) for p in self.split(text)]
        if not parts:
            return 0, "", b""
        n, ids, raw = zip(*parts, strict=True)
        return sum(n), ",".join(ids), b"".join(raw)


def encode_decode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids.

    A null or empty text has no ids; equal rows give equal rows; a null id stays null; other columns are not read. Very
    long texts and pre-tokens are encoded whole. No rows give no rows.
    """
    spark = docs.sparkSession
    tokens = read_ranks(path)
    sent = spark.sparkContext.broadcast((tokens, serialise(tokens)))  # fixed size: the vocabulary
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    own = uuid.uuid4().hex

    def make():
        codec = per_worker(own, lambda: Codec(*sent.value, pattern))
        sha = lambda raw: hashlib.sha256(raw).hexdigest()

        def rows(ids, texts):
            out = [codec.row(t or "") for t in texts]
            columns = [ids, [n for n, _, _ in out], [sha(s.encode()) for _, s, _ in out], [sha(raw) for _, _, raw in out]]
            if keep_ids:
                columns.append([[*map(int, s.split(","))] if s else [] for _, s, _ in out])
            return columns

        return rows

    return map_rows(docs.select(doc_id, text), make, schema, text)
