"""What several operators need: shared tables, tables of a folder and text columns as bytes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.session import shared_path

#: Text bytes that one task is meant to hold at once, and bytes of a batch that goes to a Python worker.
TASK_BYTES, BATCH_BYTES = 32 << 20, 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: evaluated once, safe when an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(docs: DataFrame, column: str = "text", task_bytes: int = TASK_BYTES) -> int:
    """How many partitions hold the column's bytes in tasks of ``task_bytes``; one column scan."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)) + 64).alias("b")).first()["b"] or 0
    return max(1, -(-int(total) // task_bytes))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' limits in them; a null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):  # no chunk, or too large for one
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_binary())
    array = array.cast(pa.large_binary()).fill_null(b"")
    limits = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2] if len(array) else None
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[limits[0]:limits[-1]], limits - limits[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only


def give_back() -> None:
    """Returns freed memory to the system: workers live on, take turns, and each would keep the room of its largest piece of work."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def one_by_one(batches):
    """The batches, each given back to the system before the next one comes: workers live on and would keep the room of the largest."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``; a smaller limit stays.

    By rows alone a batch of whole texts has tens of MB, held by the executor and by each worker, and both keep that room.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(name).rstrip("bB")
    if not (limit.isdigit() and 0 < int(limit) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers in which every bit of the result depends on every bit of the input."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x
