"""What the operators share: intermediate tables, a bounded membership filter, word hashes in numpy."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one call, as Parquet in the cluster's shared folder.

    A written table cuts lineage, survives lost executors and gives Catalyst its true size, so that
    a join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/casewise/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        saved.scratch_path = path
        return saved

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


BITMAP_BITS = 1 << 26
_CHUNK_BITS = 1 << 16


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**26 bits with a bit for each 64-bit key: 8 MB for any number of keys.

    A key that is in the table always finds its bit; others may find one too, so an exact join must
    follow. Each group holds at most 2**16 places.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - 26)
    chunks = (
        keys.select((place / _CHUNK_BITS).cast("int").alias("chunk"), (place % _CHUNK_BITS).cast("int").alias("bit"))
        .where(F.col("bit").isNotNull())
        .groupBy("chunk")
        .agg(F.collect_set("bit").alias("bits"))
    )
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in chunks.toLocalIterator():
        at = np.asarray(row["bits"], np.int64) + row["chunk"] * _CHUNK_BITS
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys.view(np.uint64) >> np.uint64(64 - 26)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def may_be_in(bits: np.ndarray, key: Column, spark: SparkSession) -> Column:
    """Whether a 64-bit key has its bit in a bitmap; only the key goes to Python."""
    carried = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def has_bit(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(carried.value, keys.to_numpy(np.int64)))

    return has_bit(key)


def digest(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


# ---- words in numpy -------------------------------------------------------------------------

#: Bytes of words, A-Z lowered; 0 for the rest. Every byte of a character above 7F belongs to a word.
_WORD_BYTES = np.zeros(256, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD_BYTES[_low : _high + 1] = np.arange(_low, _high + 1)
_WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
SLICE_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            both.append(np.cumprod(powers, dtype=np.uint64))
        if size > 8 * SLICE_BYTES:  # a very long text: not kept
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of some texts: ``hash`` per word, its byte ``start`` and ``end``, and ``first`` per text.

    Words of text i are ``first[i]:first[i + 1]``. Bytes count from the first text's first byte.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        low = _WORD_BYTES[data]
        word = low != 0
        n = len(low)
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        before[bounds[:-1][bounds[:-1] < n]] = False  # a text starts a word of its own
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = bounds[1:] - 1
        after[ends[ends >= 0]] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(low * power[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each run of ``k`` words that starts at a word, and whether the run stays in its text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        h = self.hash[: n - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + self.hash[j : n - k + 1 + j]
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix(h + np.uint64(k))
        last = np.repeat(self.first[1:], np.diff(self.first))
        return out, np.arange(n) + k <= last


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Cut a column of texts, null as empty, into runs of texts of about ``most`` bytes; a longer text is alone.

    Yields (number of the first text, one past the last, their bytes, bounds of the texts in the bytes).
    """
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from values in a row and their count per list."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
