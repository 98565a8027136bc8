"""Count data of models: vocabularies, sparse documents in Arrow batches, statistics added up in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import small


class Docs(NamedTuple):
    """Documents of a batch: ids, and per count its document, word and amount."""

    ids: pa.Array
    doc: np.ndarray
    word: np.ndarray
    n: np.ndarray

    def totals(self) -> np.ndarray:
        return np.bincount(self.doc, self.n, len(self.ids))


def vocabulary(units: DataFrame, feature: str = "feature", count: str = "ct", least: int = 1) -> list[str]:
    """Features with a total of at least ``least`` in order of name: the model's columns, small by nature."""
    t = units.groupBy(feature).agg(F.sum(count).alias("t")).where(F.col("t") >= least)
    return sorted(r[0] for r in t.select(feature).collect())


def documents(units: DataFrame, words: list[str], unit: str = "unit_id", feature: str = "feature", count: str = "ct") -> DataFrame:
    """``id, words array<int>, counts array<double>``, one row for each unit with a known feature."""
    v = units.sparkSession.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int")
    t = units.join(small(v), units[feature] == v["w"]).groupBy(F.col(unit).alias("id")).agg(F.sort_array(F.collect_list(F.struct("i", F.col(count).cast("double").alias("n")))).alias("l"))
    return t.select("id", F.col("l.i").alias("words"), F.col("l.n").alias("counts"))


def read(batch: pa.RecordBatch) -> Docs:
    lists = batch.column("words")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return Docs(batch.column("id"), np.repeat(np.arange(len(sizes)), sizes), flat, batch.column("counts").flatten().to_numpy(zero_copy_only=False))


def added(docs: DataFrame, stats: Callable[..., np.ndarray], shape: tuple[int, ...], reader: Callable = read) -> np.ndarray:
    """Sum over all batches of an array of fixed ``shape``: added up within tasks, then by rows in Spark."""
    width = int(np.prod(shape[1:], dtype=int))

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += stats(reader(b))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1, dtype=np.int32) * width), pa.array(total.ravel()))], ["r", "v"])

    parts = docs.mapInArrow(run, "r long, v array<double>")
    cells = parts.select("r", F.posexplode("v").alias("c", "x")).where("x != 0").groupBy("r", "c").agg(F.sum("x").alias("x"))
    out = np.zeros((shape[0], width))
    pdf = cells.toPandas()  # the model's own size
    out[pdf.r.to_numpy(int), pdf.c.to_numpy(int)] = pdf.x.to_numpy()
    return out.reshape(shape)


def segments(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by document (documents are in order)."""
    out = np.zeros((n, values.shape[1]))
    if len(doc):
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[at]] = np.add.reduceat(values, at)
    return out
