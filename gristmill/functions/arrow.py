"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def hash_bytes(rows: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def binary_rows(values: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Binary values of one length as rows of a 2-d array."""
    return np.frombuffer(b"".join(values.to_pylist()), dtype=dtype).reshape(len(values), width)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about so many rows that hold whole groups, from batches sorted by key.

    A group goes on as long as its key repeats, so only one group and one slice are held at once.
    """
    kept: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        kept.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(kept)
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        kept, count = rest.to_batches(), rest.num_rows
    if kept and count:
        yield pa.Table.from_batches(kept)
