"""k-means on dense vectors, with seeding by farthest draws and repair of empty clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors of a batch, and their rows: of ``dims`` finite entries."""
    rows, v = [], []
    for i, x in enumerate(b.column("vec").to_pylist()):
        if x is not None and len(x) == dims and all(e is not None for e in x) and np.isfinite(x).all():
            rows.append(i)
            v.append(x)
    return np.array(v, float).reshape(-1, dims), np.array(rows, np.int64)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def _step(data: DataFrame, centres: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, float, list]:
    """Sums, sizes, total squared distance, and the ``keep`` rows farthest from their centres; added up within tasks first."""
    k, dims = centres.shape

    def part(batches):
        sums, n, cost, far = np.zeros((k, dims)), np.zeros(k), 0.0, []
        for b in batches:
            x, _ = _matrix(b, dims)
            if not len(x):
                continue
            d = _distances(x, centres)
            own = d.argmin(1)
            least = d[np.arange(len(x)), own]
            np.add.at(sums, own, x)
            n += np.bincount(own, minlength=k)
            cost += least.sum()
            far += [(float(least[i]), x[i].tolist()) for i in np.argsort(-least, kind="stable")[:keep]]
            far = sorted(far, key=lambda r: (-r[0], r[1]))[:keep]
        yield pa.RecordBatch.from_pylist([{"sums": sums.ravel().tolist(), "n": n.tolist(), "cost": float(cost), "far": [r[0] for r in far], "at": [e for r in far for e in r[1]]}], schema=pa.schema([("sums", pa.list_(pa.float64())), ("n", pa.list_(pa.float64())), ("cost", pa.float64()), ("far", pa.list_(pa.float64())), ("at", pa.list_(pa.float64()))]))

    parts = data.select("vec").mapInArrow(part, "sums array<double>, n array<double>, cost double, far array<double>, at array<double>").collect()  # one row a task, of k vectors
    far = sorted(((d, r["at"][i * dims : (i + 1) * dims]) for r in parts for i, d in enumerate(r["far"])), key=lambda r: (-r[0], r[1]))[:keep]
    order = sorted(parts, key=lambda r: (r["cost"], r["n"]))  # sums don't depend on the order of tasks
    return sum((np.array(r["sums"]).reshape(k, dims) for r in order), np.zeros((k, dims))), sum((np.array(r["n"]) for r in order), np.zeros(k)), float(sum(r["cost"] for r in order)), far


def fit(data: DataFrame, k: int, dims: int, iterations: int = 20, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, sizes and inertia of k-means over ``vec`` of ``data``; at most ``k`` centres, fewer if different rows are.

    The first centre is the mean of all rows, each further one the row farthest
    from those chosen (the first is then dropped), so the result never depends on
    a draw.  A cluster that runs empty is given the row farthest from its centre.
    Null vectors, and ones of another length or with null, NaN or infinite
    entries, take no part.  What reaches the driver is k vectors a task.
    """
    sums, n, _, _ = _step(data, np.zeros((1, dims)), 0)
    if not n.sum():
        return np.zeros((0, dims)), np.zeros(0), 0.0
    centres = sums / n.sum()
    while len(centres) < k + 1:
        far = _step(data, centres, 1)[3]
        if not far or far[0][0] <= 0:
            break
        centres = np.vstack([centres, far[0][1]])
    centres = centres[1 : k + 1] if len(centres) > 1 else centres
    for _ in range(iterations):
        sums, n, _, far = _step(data, centres, k)
        moved = np.where((n > 0)[:, None], sums / np.maximum(n, 1)[:, None], centres)
        spare = [r for r in far if r[0] > 0]
        for c in np.flatnonzero(n == 0):
            if spare:
                moved[c] = spare.pop(0)[1]
        if np.abs(moved - centres).max() <= tolerance:
            break
        centres = moved
    sums, n, cost, _ = _step(data, centres, 0)
    return centres, n, cost


def assign(data: DataFrame, centres: np.ndarray, key: str) -> DataFrame:
    """``key, cluster, distance``: each usable row's nearest centre (the first of equals) and squared distance."""
    k, dims = centres.shape
    kind = dict(data.dtypes)[key]

    def run(batches):
        for b in batches:
            x, rows = _matrix(b, dims)
            if len(x) and k:
                d = _distances(x, centres)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows)), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(x)), own])], [key, "cluster", "distance"])

    return data.select(key, F.col("vec")).mapInArrow(run, f"`{key}` {kind}, cluster int, distance double")
