"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SLICE_BYTES = 2 << 20


def rows(batches: Iterable[pa.RecordBatch], text: str = "text",
         limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``limit`` bytes of text, one row at least,
    so that what a function holds at once does not follow the batch size. At the end
    memory that is free goes back to the machine, as Python workers outlive their tasks."""
    try:
        for batch in batches:
            lengths = pc.binary_length(batch.column(text)).fill_null(0)
            ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
            start = 0
            while start < len(ends):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call
        ctypes.CDLL(None).malloc_trim(0)


def shared_bytes(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file (a few MB), so that only the driver opens it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def hold_out(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def join_split(big: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = 64,
               share: int = 4096) -> DataFrame:
    """``big`` joined to the stored ``small`` on ``key``, keys of very many rows split.

    ``small`` holds a key once, with ``n``, the number of its rows in ``big`` (not
    returned). Keys of more than one in ``share`` of all those rows, fewer than ``share``
    keys by nature, are dealt by ``spread`` over ``salts`` partitions."""
    from pyspark.sql import functions as F

    least = (small.agg(F.sum("n")).first()[0] or 0) / share
    hot = F.broadcast(small.filter(F.col("n") > least).select(F.col(key).alias("_hot")))
    marked = big.join(hot, F.col(key) == F.col("_hot"), "left")
    dealt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0)
    left = marked.withColumn("_salt", dealt.cast("int")).drop("_hot")
    copies = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.join(small.withColumn("_salt", F.explode(copies)).drop("n"), [key, "_salt"]).drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """64-bit hash of a word (as bytes), remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        super().__init__()
        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        value = self._hash(word)
        if len(word) <= 64:
            if len(self) >= self._limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sequence_hashes(values: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` consecutive values, by doubling."""
    count = len(values) - length + 1
    if count < 1:
        return np.empty(0, np.uint64)
    seed64 = np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    with np.errstate(over="ignore"):
        power, block = 1, mix(values + seed64)
        whole, covered = None, 0
        while True:
            if length & power:
                part = block[covered: covered + count]
                whole = part if whole is None else mix(whole * np.uint64(0x9E3779B97F4A7C15) + part)
                covered += power
            power *= 2
            if power > length:
                return np.ascontiguousarray(whole[:count])
            half = power // 2
            block = mix(block[:-half] * np.uint64(0xD6E8FEB86659FD93) + block[half:])


def byte_words(batch: pa.RecordBatch, text: str = "text", lower: bool = False) -> list[list[bytes]]:
    """The words of every text as UTF-8; splitting bytes cuts at the same six ASCII
    characters as WORD. ``lower`` changes A-Z only."""
    texts = batch.column(text).cast(pa.binary()).to_pylist()
    if lower:
        return [t.lower().split() if t else [] for t in texts]
    return [t.split() if t else [] for t in texts]


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the frames they belong to; between
    large stages that is asked for, as a driver with free memory would not do it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
