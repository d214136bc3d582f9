"""Vector columns as numpy matrices, and streams of grouped rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width(vectors: DataFrame, vec_col: str) -> int:
    """Components of the longest vector; shorter ones count as followed by zeros."""
    return max(0, vectors.agg(F.max(F.size(vec_col))).first()[0] or 0)


def usable(vec: Column) -> Column:
    """Neither null nor empty, and no component is null, NaN or infinite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A usable vector column as doubles [rows, dim]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def stacked(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers kept as bytes, as doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64, copy=False) if values else np.zeros((0, 0))


def bytes_of(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of sorted batches, one group of the first ``keys`` columns at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        cuts = [0, *(i for i in range(1, n) if values[i] != values[i - 1]), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)
