"""Arrow helpers shared by the batch operators of this package."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one step of a batch operator holds at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and its offsets; a null has length 0."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with at most `most` bytes in that column, or one row."""
    _, offsets = utf8_buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end


@cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Memory that nothing uses goes back to the system; a worker lives on behind its task and would keep it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: int = 1, most: int = STEP_BYTES) -> DataFrame:
    """`df` with each slice of its Arrow batches put through `make`; a slice has `most` text bytes, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, most):
                yield make(part)
        give_back()

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only these two columns, as `k` and `t`, whatever else the input has."""
    return df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset, a local one if the master is local, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="shared-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sampled(key: str, wanted: int, rows: int) -> Column:
    """Whether a row is of a sample of about `wanted` of `rows`, by a 63-bit hash of its key, so that any share can be drawn."""
    return F.xxhash64(key).bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(min((1 << 63) - 1, (wanted << 63) // max(1, rows)))
