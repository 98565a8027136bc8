"""The N best items of every group, by a bounded heap that is merged.

Each task keeps, for every group it meets, a heap of the N best different items
seen so far.  A row that scores less than the worst item of its group's full heap
is dropped at once; the others wait in a buffer and are sifted into the heaps
when there are as many of them as rows in heaps, so that each row is sorted a
fixed number of times however many groups there are.  Only heaps are shuffled,
and merged the same way: a group with a third of all rows sends N rows for each
task, never its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.runs import changes, sized

#: Rows of heaps above which a task passes them on and begins anew.
HELD = 400_000
#: Rows sifted into heaps at once, at least; the column for the hash of a group while heaps are made.
LEAST, HASH = 20_000, "__hash"


def top_items(rows: DataFrame, groups: list[str], scores: list[str], item: str, n: int) -> DataFrame:
    """The columns given, and ``rank`` 1 to ``n`` within each group.

    Items rank by ``scores`` in turn, each descending with null last, then by the
    item ascending by code point; so the order is total and never depends on the
    run.  An item with several rows counts by its best one.  NaN scores are null
    (drop rows first if such scores should take no part); infinity ranks first.
    A null group is a group; rows with a null item are left out.
    """
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in scores]
    t = rows.where(F.col(item).isNotNull()).select(*groups, *clean, item)
    out = T.StructType([f for f in t.schema.fields])
    part = t.withColumn(HASH, F.xxhash64(*groups) if groups else F.lit(0).cast("long")).mapInArrow(lambda b: _heaps(b, groups, scores, item, n), out)
    part = part.repartition(*groups).sortWithinPartitions(*groups)
    ranked = T.StructType([*out.fields, T.StructField("rank", T.IntegerType())])
    return part.mapInArrow(lambda b: _merge(b, groups, scores, item, n), ranked)


def best(t: pa.Table, groups: list[str], scores: list[str], item: str, n: int) -> pa.Table:
    """The ``n`` best different items of each group of ``t``, in order."""
    up, down = [(g, "ascending") for g in groups], [(s, "descending") for s in scores]
    t = t.take(pc.sort_indices(t, sort_keys=[*up, (item, "ascending"), *down], null_placement="at_end"))
    t = t.take(pa.array(changes([t.column(c) for c in [*groups, item]])))
    t = t.take(pc.sort_indices(t, sort_keys=[*up, *down, (item, "ascending")], null_placement="at_end"))
    return t.filter(pa.array(places(t, groups) < n))


def places(t: pa.Table, groups: list[str]) -> np.ndarray:
    """Each row's place within its run of ``groups``, from 0."""
    first = changes([t.column(g) for g in groups]) if groups else np.zeros(min(1, t.num_rows), np.int64)
    at = np.arange(t.num_rows)
    return at - np.repeat(first, np.diff(np.r_[first, t.num_rows]))


def _heaps(batches, groups, scores, item, n):
    """``best`` of each group over all batches; the last column of a batch is the hash of its group, and is dropped."""
    held, worst, waiting, rows = None, None, [], 0
    for t in sized(batches, LEAST):
        t = above(t, worst, scores[0])
        waiting.append(t)
        rows += t.num_rows
        if rows >= max(LEAST, held.num_rows if held is not None else 0):
            held = best(pa.concat_tables([*([held] if held is not None else []), *waiting]).combine_chunks(), groups, scores, item, n)
            worst, waiting, rows = floors(held, groups, scores[0], n), [], 0
            if held.num_rows > HELD:
                yield from held.drop_columns([HASH]).to_batches()
                held = worst = None
    if rows or held is not None:
        t = pa.concat_tables([*([held] if held is not None else []), *waiting]).combine_chunks()
        yield from (best(t, groups, scores, item, n) if rows else t).drop_columns([HASH]).combine_chunks().to_batches()


def floors(held: pa.Table, groups: list[str], score: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the groups whose heaps are full, and the score of the worst item in each; of groups with one hash the lower one."""
    at = places(held, groups) == n - 1
    h, v = held.column(HASH).to_numpy()[at], pc.fill_null(held.column(score), -np.inf).to_numpy()[at]
    every, count = np.unique(held.column(HASH).to_numpy()[places(held, groups) == 0], return_counts=True)
    order = np.lexsort((v, h))
    h, v = h[order], v[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    h, v = h[first], v[first]
    alone = count[np.searchsorted(every, h)] == 1  # a group that shares its hash may have a heap that isn't full
    return h[alone], v[alone]


def above(t: pa.Table, worst: tuple[np.ndarray, np.ndarray] | None, score: str) -> pa.Table:
    """Rows that may still enter the heap of their group."""
    if worst is None or not len(worst[0]):
        return t
    h = t.column(HASH).to_numpy()
    at = np.minimum(np.searchsorted(worst[0], h), len(worst[0]) - 1)
    v = pc.fill_null(t.column(score), -np.inf).to_numpy()
    return t.filter(pa.array((worst[0][at] != h) | (v >= worst[1][at])))


def _merge(batches, groups, scores, item, n):
    held = None
    for t in sized(batches, LEAST):
        held = best(t if held is None else pa.concat_tables([held, t]).combine_chunks(), groups, scores, item, n)
        # sorted input: only the last group met can go on, which sorts last here only if the orders agree
        tail = t.slice(t.num_rows - 1)
        mine = np.ones(held.num_rows, bool)
        for g in groups:
            v = tail.column(g)[0]
            col = held.column(g)
            same = pc.is_null(col) if not v.is_valid else pc.fill_null(pc.equal(col, v), False)
            mine &= np.asarray(same)
        yield from _ranked(held.filter(pa.array(~mine)), groups)
        held = held.filter(pa.array(mine))
    if held is not None:
        yield from _ranked(held, groups)


def _ranked(t: pa.Table, groups: list[str]):
    t = t.combine_chunks()
    yield from t.append_column("rank", pa.array((places(t, groups) + 1).astype(np.int32))).to_batches()
