"""Byte-level BPE by a sentencepiece model that is written from a rank file.

The rank file alone fixes the merges: of all neighbouring symbols whose union is in
the vocabulary the union of lowest rank is joined first, the leftmost on a tie. A
sentencepiece BPE model does the same when a piece's score is its negative rank, so
the model is serialised from the vocabulary, without training: bytes are mapped to
printable characters, normalisation is the identity, and piece ids are the ranks.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillstack.llm.common import rows, shared_bytes

CACHE_LIMIT = 250_000
#: Longer pre-tokens are not remembered.
CACHE_LENGTH = 64
ENCODED = "n_tokens long, ids binary"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself, or the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shift = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(shift)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    parts = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in parts}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a rank vocabulary.

    Piece ids are ranks, which must be 0 to n-1; id n is the unknown piece, which the
    256 byte pieces keep from ever being used.
    """
    n = len(ranks)
    if sorted(ranks.values()) != list(range(n)) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n-1 and hold every single byte")
    shown = byte_characters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(shown[b] for b in token).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out += _field(1, _field(1, piece) + score + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n)
    trainer += b"".join(_field(k, absent) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Encoder:
    """Ids of texts, each match of the pattern by itself."""

    def __init__(self, rank_file: bytes, pattern: str):
        import sentencepiece

        ranks = read_ranks(rank_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        tokens = sorted(ranks, key=ranks.__getitem__)
        # A match that is itself in the vocabulary is that token, also where merges
        # would not lead to it.
        found = self.model.encode([self.map(t) for t in tokens], num_threads=1)
        self.direct = {
            self.map(t): struct.pack("<I", r)
            for r, (t, ids) in enumerate(zip(tokens, found)) if ids != [r]
        }
        self.cache: dict[str, bytes] = {}

    def map(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.shown)

    def merge(self, matches: list[str]) -> dict[str, bytes]:
        mapped = [self.map(m.encode("utf-8", "surrogatepass")) for m in matches]
        found = self.model.encode(mapped, num_threads=1)
        return {
            m: self.direct.get(x) or np.array(ids, "<u4").tobytes()
            for m, x, ids in zip(matches, mapped, found)
        }

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null or empty."""
        matches = [self.split(t) if t else [] for t in texts]
        wanted = set().union(*matches)
        new = wanted.difference(self.cache)
        long = {m for m in new if len(m) > CACHE_LENGTH}
        if len(self.cache) + len(new) > CACHE_LIMIT:
            self.cache.clear()
            new = wanted - long
        self.cache.update(self.merge(sorted(new - long)))
        known = self.cache
        if long:
            known = known | self.merge(sorted(long))
        return [b"".join(map(known.__getitem__, m)) for m in matches]


@functools.lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


@functools.lru_cache(maxsize=2)
def _token_bytes(rank_file: bytes) -> list[bytes]:
    ranks = read_ranks(rank_file)
    return sorted(ranks, key=ranks.__getitem__)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(id, n_tokens, ids)`` of every whole text, ``ids`` as little-endian unsigned
    32-bit integers, with ``decoded`` also their bytes as by ``decode``, found in the
    same pass. Null and empty texts have no ids. Repeated rows stay repeated,
    an empty table gives an empty result, other columns are not looked at."""
    shared = shared_bytes(docs.sparkSession, rank_path)

    def run(batches):
        encoder = _encoder(shared.value, pattern)
        table = _token_bytes(shared.value) if decoded else None
        try:
            for part in rows(batches, "t"):
                ids = encoder.encode(part.column("t").to_pylist())
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                found = [part.column("i"), counts, pa.array(ids, pa.binary())]
                if decoded:
                    found.append(pa.array([joined(x, table) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(found, [id_col, "n_tokens", "ids", "decoded"][:len(found)])
        finally:
            encoder.cache.clear()  # the worker outlives the task

    picked = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    kind = picked.schema["i"].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, {ENCODED}" + (", decoded binary" if decoded else ""))


def joined(ids: bytes | None, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids, by inverse mapping. No ids, or a null,
    give no bytes; an id outside the vocabulary is an error."""
    shared = shared_bytes(encoded.sparkSession, rank_path)

    def run(batches):
        table = _token_bytes(shared.value)
        for part in rows(batches, ids_col):
            texts = [joined(x, table) for x in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"]
            )

    fields = ", ".join(f"`{n}` {k}" for n, k in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
