"""Bounded Arrow batches for the operators that run in Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: Bytes and rows of an Arrow batch between Spark and Python; both sides hold some batches for every task, outside the heap.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def trim() -> None:
    """Gives memory that a task freed back to the system: Python workers live on, and Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with a trim after a partition's last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of ``column`` (one row at least), whole rows only."""
    total = np.cumsum(lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of BATCH_BYTES and BATCH_ROWS at most (session settings, for plans are run later) and a trim after each partition."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(trimmed(run), schema)


def with_columns(df: DataFrame, source: str, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list], keep: list[str] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``fields``, which ``make`` computes from a slice bounded by the bytes of ``source``.

    ``also``: further columns that ``make`` reads. A column of ``df`` named like a new field is replaced.
    """
    names = [f.name for f in fields]
    stay = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    wanted = list(dict.fromkeys([f.name for f in stay] + [source, *also]))
    schema = T.StructType([*stay, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                new = make(part)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in stay), *new], names=schema.names)

    return mapped(df.select(*[f"`{c}`" for c in wanted]), run, schema)
