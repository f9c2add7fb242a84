"""Helpers shared by the training-data operators.

Arrow batches are cut into slices of bounded bytes, so that a worker's memory follows the slice
(or a single very long text) and never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.shipping import ship
from ..plans.staging import cut  # noqa: F401

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 1 << 20
#: Words a worker keeps in a cache before it starts a new one, and characters (or bytes) of a word that it keeps at all:
#: together a bound on the cache's bytes, whatever the texts are like.
CACHE_WORDS, CACHE_LENGTH = 150_000, 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def groups(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[list[pa.RecordBatch]]:
    """The parts of each run of equal values of the columns that the batches are sorted by."""
    last, parts = None, []
    for batch in batches:
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        changed = np.zeros(max(batch.num_rows - 1, 0), bool)
        for v in values:
            changed |= v[1:] != v[:-1]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if parts and (own := [v[a] for v in values]) != last:
                    yield parts
                    parts = []
                last = [v[a] for v in values]
                parts.append(batch.slice(a, b - a))
    if parts:
        yield parts


#: Rows of one key that a join leaves together, and keys that are spread at most: the hottest, so any other has
#: fewer than a ten-thousandth of the rows.
TOGETHER_ROWS, HOT_KEYS = 20_000, 10_000


def hot_keys(df: DataFrame, key: str, count: Column | None = None) -> list[tuple]:
    """(key, parts) of the keys with many rows; ``count`` is given where ``df`` has them counted."""
    counts = df.groupBy(key).agg((F.count("*") if count is None else count).alias("n")).where(F.col("n") > TOGETHER_ROWS)
    rows = counts.orderBy(F.col("n").desc(), key).limit(HOT_KEYS).select(key, F.ceil(F.col("n") / TOGETHER_ROWS).cast("int")).collect()
    return [tuple(r) for r in rows]


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, *, how: str = "inner", hot: list[tuple] | None = None) -> DataFrame:
    """``left`` joined with ``right``, in which a key is unique; hot keys of ``left`` are spread by a hash of ``by``.

    The rows of ``right`` under hot keys are repeated, once for each part. ``left`` is read twice unless its hot
    keys are given. Null keys match nothing and are spread alike.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("_parts", IntegerType())])
    parts = F.broadcast(left.sparkSession.createDataFrame([h for h in hot if h[0] is not None], schema))  # HOT_KEYS rows at most
    lone = max((n for k, n in hot if k is None), default=1)
    salt = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.when(F.col(key).isNull(), F.lit(lone)), F.lit(1)))
    salted = left.join(parts, key, "left").withColumn("_salt", salt).drop("_parts")
    copies = right.join(parts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def map_slices(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, column: str = "text") -> DataFrame:
    """Runs ``work()`` once per task and what it returns on every slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in slices(batch, column):
                if (out := each(part)) is not None:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Lookup:
    """Places of numbers from 0 on in an array of distinct ones, by open addressing in a table of eight times their size."""

    def __init__(self, keys: np.ndarray):
        bits = max(3, (8 * max(len(keys), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while left.size:
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.keys[taken], self.at[taken] = keys[left[free[first]]], left[free[first]]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, -1 where it isn't there."""
        slot = self._slots(keys)
        there = self.keys[slot]
        at = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while left.size:
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            same = there == keys[left]
            at[left[same]] = self.at[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return at


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words (UTF-8), and each word's number of them."""
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if len(words) and data else np.zeros(0, np.uint8)
    begun = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))[edges - edges[0]] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4"), np.diff(begun)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the sizes, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64, on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes; a shorter sequence is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[i : n - k + 1 + i]
    return mix(h + np.uint64(k))
