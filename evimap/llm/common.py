"""What the corpus operators share: tables, scratch tables, word fingerprints and digests.

A word is a run of characters other than space and U+0009..U+000D. Fingerprints are computed with
numpy over whole Arrow batches inside tasks; a batch is cut into slices of a few MB, so memory stays
bounded whatever the partition size. They are for sketches and candidates; what decides that words are equal is
a digest of their bytes (`Words.digests`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evimap.functions.tables import shared_folder

#: White space as a regular-expression class, for Java and Python alike.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes of text that a slice of a batch aims at.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about so many bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for s, e in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(s), int(e - s))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n + 1 offsets; null is empty."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return bytes_, at - at[0]


_M = [0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijective scrambling of 128 bits: different pairs stay different."""
    for k in (0, 1, 0, 1):
        high = high ^ mix(low + np.uint64(_M[k]))
        low, high = high, low
    return low, high


class Words:
    """Words of a slice: byte spans in data, the first word of each text, fingerprints and digests."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first))
        self.end = np.flatnonzero(before & (~inside | first))
        self.first = np.searchsorted(self.start, self.offsets)
        self._prints: tuple[np.ndarray, np.ndarray] | None = None
        self._joined: tuple[bytes, np.ndarray, np.ndarray] | None = None

    def fingerprints(self, k: int = 0) -> np.ndarray:
        """Half k of each word's 128 bits.

        A word of up to 15 bytes is its own name, scrambled, so such words never share both halves; a longer one has its BLAKE2 digest."""
        if self._prints is None:
            size = self.end - self.start
            padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
            loads = np.ndarray(len(padded) - 7, "<u8", buffer=padded, strides=(1,))
            low, high = loads[self.start], loads[self.start + 8]
            bits = (np.clip(size, 0, 8) * 8).astype(np.uint64)
            low = np.where(size < 8, low & ((np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1)), low)
            bits = (np.clip(size - 8, 0, 7) * 8).astype(np.uint64)
            high = (high & ((np.uint64(1) << bits) - np.uint64(1))) | (size.astype(np.uint64) << np.uint64(56))
            for i in np.flatnonzero(size > 15).tolist():
                digest = blake2b(self.data[self.start[i] : self.end[i]], digest_size=16).digest()
                low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
            self._prints = _rounds(low, high)
        return self._prints[k]

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts with one space for each run of white space behind a word, and where words begin and end there."""
        if self._joined is None:
            n = len(self.data)
            inside = np.zeros(n + 1, np.int8)
            np.add.at(inside, self.start, 1)
            np.subtract.at(inside, self.end, 1)
            inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
            keep = inside.copy()
            keep[self.end[self.end < n]] = True
            place = np.r_[0, np.cumsum(keep)]
            self._joined = np.where(inside, self.data, 32)[keep].astype(np.uint8).tobytes(), place[self.start], place[self.end]
        return self._joined

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """BLAKE2 digests of the words from first to before last, joined by one space, of each such run: two numbers each."""
        data, start, end = self.joined()
        view, some = memoryview(data), last > first
        begin, stop = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        begin[some], stop[some] = start[first[some]], end[last[some] - 1]
        out = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
        return np.frombuffer(out, np.int64).reshape(-1, 2)


def windows(words: np.ndarray, first: np.ndarray, size: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every window of size words within one text, and the index of its first word."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(_M[1 - k]) + words[j : n - size + 1 + j]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    return mix(h[at]), at


def quoted(column: str) -> str:
    """A column's name as one part of a name expression."""
    return "`" + column.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for the row: what stands inside a lambda itself is computed for each element."""
    return F.transform(F.array(value), body)[0]
