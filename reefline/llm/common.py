"""Helpers the operators share: written tables, columns with names of their own, words, prefix sums."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from reefline.session import work_folder

# Words are the maximal runs of bytes other than blank and the five ASCII line and tab characters;
# bytes.split() without an argument splits at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Bytes of text that a Python worker turns into arrays at once.
CHUNK_BYTES = 1_000_000
# Entries of a worker's word cache, and the longest word it holds.
CACHE_WORDS, CACHE_WORD_BYTES = 120_000, 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet under the shared checkpoint folder and read back.

    Fixes the rows for all later passes, cuts the lineage, and outlives executors.
    """
    path = work_folder(df.sparkSession, name)
    # small row groups keep little in the writers' memory
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Arrow batches of fewer rows for the session: whole texts are long, and both sides hold a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def lean(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task that gives its memory back at its end; Python workers stay for later tasks."""
    @wraps(task)
    def run(*args, **named) -> Iterator:
        try:
            yield from task(*args, **named)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library can
                ctypes.CDLL(None).malloc_trim(0)
    return run


def bounded(df: DataFrame, rows: int, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """Broadcast only where the counted rows fit the limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def running_totals(totals: DataFrame, key: str, value: str, before: str, block: int = 1024) -> DataFrame:
    """Exclusive prefix sums over one row per integer key, by blocks of keys and then inside each.

    No window sees more than `block` rows or the count of blocks.
    """
    rows = totals.withColumn("_block", F.floor(F.col(key) / block))
    blocks = rows.groupBy("_block").agg(F.sum(value).alias("_sum")).withColumn(
        "_high", F.floor(F.col("_block") / block))
    tops = blocks.groupBy("_high").agg(F.sum("_sum").alias("_top_sum")).withColumn("_one", F.lit(0))
    up_to = lambda part, order: W.partitionBy(part).orderBy(order).rowsBetween(
        W.unboundedPreceding, -1)
    sum_over = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    tops = tops.select("_high", sum_over("_top_sum", up_to("_one", "_high")).alias("_b2"))
    blocks = blocks.join(tops, "_high").select(
        "_block", (F.col("_b2") + sum_over("_sum", up_to("_high", "_block"))).alias("_b1"))
    return rows.join(blocks, "_block").select(
        key, (F.col("_b1") + sum_over(value, up_to("_block", key))).cast("long").alias(before))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def hash(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        value = self.hash(word)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0]:offsets[-1]]


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to the limit at most; a larger row comes alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions starts[i] .. starts[i] + lengths[i] - 1, in order."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
