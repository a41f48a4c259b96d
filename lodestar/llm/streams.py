"""Packing arrays into binary shuffle rows, and reading sorted Arrow streams by key."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def with_row(rows: DataFrame, fields: str, row: str = "row") -> StructType:
    """The schema of ``row`` as it is in ``rows``, whatever its columns are called and
    hold, and of further fields."""
    return StructType([StructField(row, rows.schema[row].dataType), *StructType.fromDDL(fields)])


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """``run``, giving the worker's free memory back at the end of a task: workers
    outlive tasks, and what one task needed the next may need elsewhere."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Gives this process's free memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def parts(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes, each as planes of its bytes, which the
    shuffle's compression shortens where high bytes are alike."""
    return np.uint32(len(columns[0])).tobytes() + b"".join(
        np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns
    )


def unpack(data: bytes, widths: Iterable[int], at: int = 0) -> tuple[list[np.ndarray], int]:
    """The columns of ``pack`` as uint64, given their bytes per value; and where they end."""
    n = int(np.frombuffer(data, np.uint32, 1, at)[0])
    at += 4
    out = []
    for width in widths:
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        full = np.zeros((n, 8), dtype=np.uint8)
        full[:, :width] = planes.T
        out.append(full.view(np.uint64).reshape(n))
        at += n * width
    return out, at


def narrow(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each value, as a column for ``pack``."""
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width]


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """The rows of each value of ``key``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    at: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        values = column.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if held and values[low] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = values[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield at, pa.Table.from_batches(held)
