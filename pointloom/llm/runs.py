"""Helpers for sorted Arrow streams, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pointloom.operators.proximity import changes, chunks, expand, slabs

__all__ = ["changes", "chunks", "column", "expand", "run_ids", "slabs"]


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def run_ids(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the number of the run it lies in, of runs that begin at ``starts``."""
    ids = np.zeros(n, np.int64)
    ids[starts[1:]] = 1
    return np.cumsum(ids)


def sized(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches joined into tables of at least ``least`` rows."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()
