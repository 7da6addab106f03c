"""Arrow batches of a sorted partition, cut at group boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def list_array(parts: list[np.ndarray], dtype: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=dtype))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose text column holds about ``limit`` bytes, to bound the worker's memory."""
    for batch in batches:
        col = batch.column(column)
        n = batch.num_rows
        step = max(1, n if col.nbytes <= limit else n * limit // col.nbytes)
        for i in range(0, n, step):
            yield batch.slice(i, step)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, enough: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts): whole groups of equal ``key`` in a stream sorted by it.

    starts holds the first row of each group and the number of rows; a group may span batches. Of a group of more
    than ``enough`` rows, whole further batches are left out, for readers who only need to see that it is large.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if enough is not None and held and last == keys[0] == keys[-1] and sum(b.num_rows for b in held) > enough:
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if cut == 0 and held and keys[0] != last:
            yield _grouped(held, key)
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield _grouped(held, key)
            held = []
        held.append(batch.slice(cut))
        last = keys[-1]
    if held:
        yield _grouped(held, key)


def _grouped(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held)
    keys = table.column(key).to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return table, np.append(starts, len(keys))
