"""Arrow batches in small parts: what Python makes of rows at a time is bounded, however many rows of
whatever size Spark puts into a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts and contents that are held as Python objects at a time (a larger row is a part of its
#: own), and rows.
PART_BYTES, PART_ROWS = 1 << 20, 512


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the texts and contents of each row."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return sizes


def parts(batches) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into slices of at most ``PART_BYTES`` and ``PART_ROWS``; nothing comes of empty ones."""
    for batch in batches:
        ends, low = np.cumsum(row_bytes(batch)), 0
        while low < batch.num_rows:
            high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PART_BYTES, side="right"))
            high = min(max(high, low + 1), low + PART_ROWS)
            yield batch.slice(low, high - low)
            low = high


def rows_of(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """The rows of a part, as tuples of the columns ``names``."""
    return zip(*(batch.column(n).to_pylist() for n in names))


def in_batches(rows, types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (tuples, of any iterator) as Arrow batches of about ``PART_BYTES``, made while they come."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size >= PART_BYTES or len(held) >= 8 * PART_ROWS:
            yield whole(held, types, names)
            held, size = [], 0
    if held:
        yield whole(held, types, names)


def whole(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
