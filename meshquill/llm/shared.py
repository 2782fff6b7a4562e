"""Helpers that several operators share: scratch tables, size-checked broadcasts, word hashing."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast once they have been counted (two longs each: 16 MB at most).
BROADCAST_ROWS = 1_000_000
#: Numbers in the arrays of rows that may be broadcast (32 MB).
BROADCAST_NUMBERS = 4_000_000
#: Bytes that a cache of a Python worker may hold, and characters of the longest key that it keeps.
CACHE_BYTES, CACHE_KEY = 64 << 20, 64


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where none is set and all runs on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, among those of this application."""
    return f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/meshquill/{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: for when its results have been saved, as they may read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS, numbers: Column | None = None, most_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """Hint a broadcast only if the counted rows, and the numbers that they hold in arrays, stay below the bounds; else Spark joins by shuffle."""
    held = F.lit(0) if numbers is None else F.coalesce(F.sum(numbers), F.lit(0))
    rows, inside = df.agg(F.count(F.lit(1)), held).first()
    return F.broadcast(df) if rows <= most and inside <= most_numbers else df


def bounded_sample(rows: DataFrame, texts: DataFrame, order: list[str], most_rows: int, most_bytes: int) -> DataFrame:
    """The rows (order columns, doc_id, tie, n_bytes and others) that come first, with their texts, in one sorted partition.

    At most so many rows, and of these the ones before which texts hold fewer than so many bytes. They are
    chosen by their lengths alone: texts (doc_id, tie: xxhash64 of the text, text) are fetched for the chosen
    rows only, so no task holds more of them than the bounds.
    """
    first = rows.orderBy(*order).limit(most_rows)
    before = F.sum("n_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    chosen = first.withColumn("__before", before).where(F.coalesce("__before", F.lit(0)) < most_bytes).drop("__before", "n_bytes").distinct()
    chosen = materialise(chosen, "sample")
    found = texts.join(F.broadcast(chosen.withColumnsRenamed({"doc_id": "__id", "tie": "__tie"})), texts["doc_id"].eqNullSafe(F.col("__id")) & (texts["tie"] == F.col("__tie")))
    return found.drop("__id", "__tie").repartition(1).sortWithinPartitions(*order)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


class Memo(dict):
    """A cache of bounded bytes: long keys are never kept, and it forgets everything when it is full.

    Memory stays flat on endless vocabularies and on words of any length.
    """

    def __init__(self, make: Callable, most_bytes: int = CACHE_BYTES):
        super().__init__()
        self.make, self.most_bytes, self.held = make, most_bytes, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) > CACHE_KEY:
            return value
        if self.held > self.most_bytes:
            self.clear()
            self.held = 0
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + 100  # and an entry of the table
        self[key] = value
        return value


def word_hashes(cache: Memo, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def hash_cache() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text has none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    prime = np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, width):
        out *= prime
        out += h[k : k + n]
    return mix64(out)
