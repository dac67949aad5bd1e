"""Arrow batches as NumPy arrays, and texts in blocks of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20


def release() -> None:
    """Hand freed memory back to the system; a worker lives on beside others when its task is done."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_blocks(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in blocks of about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(batch.schema.get_field_index(column))
        _, bounds = flat_bytes(lengths)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
        del batch, lengths, bounds
    release()


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of flat ``values`` cut at ``offsets``."""
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(values, type=kind)
    )


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary column whose values are the bytes of ``values`` cut at ``bounds``."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls and the offsets of its rows."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]
