"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So that memory that a Python worker frees goes back to the machine, not to the worker's own store.
LEAN = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """Python workers that start from now on hand freed memory back: jobs of many steps share executors with the JVM's heap."""
    spark.sparkContext.environment.update(LEAN)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) in ranges of ascending doc_id, sorted within: nulls first, rows that repeat an id by the hash of their text, then the text.

    The row's place is the last key of the ranges alone, so that many equal rows do not fall into one range.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = src.withColumns({"__hash": F.xxhash64("text"), "__place": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "__hash", "__place")
    return dealt.sortWithinPartitions("doc_id", "__hash", "text").select("doc_id", "text")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of ``column``, one row at least: bounds the memory of a step."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
    # Workers are used again: what this task took goes back.
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))
