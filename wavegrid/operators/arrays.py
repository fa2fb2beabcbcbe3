"""Array columns as numpy matrices inside tasks, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_of(signal: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows padded to the longest, not-a-number where a value is null or missing; where there are values; lengths."""
    length = np.array(signal.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = signal.flatten()
    there = np.arange(length.max(initial=0)) < length[:, None]
    a, valid = np.full(there.shape, np.nan), np.zeros(there.shape, bool)
    valid[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    a[valid] = flat.drop_null().to_numpy(zero_copy_only=False)
    return a, valid, length


def lists_of(rows: list[np.ndarray], nulls: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Lists of the rows' values; null where told."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    mask = np.concatenate([*nulls, np.zeros(0, bool)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0)]), kind.value_type, mask=mask))
