"""Shared helpers of the pipeline operators: tables, the shared folder, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.session import shared_folder as shared_root

#: A word is a longest run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    return f"{shared_root(spark).rstrip('/')}/docfields-{uuid4().hex}"


def kept(df: DataFrame, *partitions: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so lost executors cost no rerun."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows in this session: with whole texts as rows, the default of 10,000 takes
    hundreds of megabytes in the executor and again in its Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def bucket_of_text(column: Column, buckets: int) -> Column:
    """crc32 of the value as text, modulo buckets; NULL counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def ascii_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased: on bytes both lower() and split() know ASCII only."""
    return text.lower().split()


class Hashes(dict):
    """word -> unsigned 64-bit hash, remembered; forgets everything when it holds too many words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ordered pair (a, b)."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane, compressed: high planes that are empty or nearly so cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def key_ranges(keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, keys, values) of the non-empty ranges when sorted 64-bit keys are cut by their first ``bits`` bits (1 or more)."""
    at = np.searchsorted(keys, np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits))
    for part, (k, v) in enumerate(zip(np.split(keys, at), np.split(values, at))):
        if len(k):
            yield part, k, v
