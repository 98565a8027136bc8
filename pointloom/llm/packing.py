"""Best-fit decreasing of texts into containers of a fixed number of tokens.

Items of one size are alike, so the packing needs only how many items there are
of each size: at most ``capacity`` counters, added up in Spark.  Sizes are then
taken in decreasing order; a segment tree over the remaining capacities finds
the tightest open containers that still hold the size, and as many equal items
as these take are placed in one step.  This is the placement that best-fit
decreasing makes one item at a time, for any number of items.  Each item finds
its container from its rank among the items of its size, which is computed in
Spark from hashed buckets, so that no size, however frequent, is one task.
"""

from __future__ import annotations

import base64
import importlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.runs import column, sized
from pointloom.session import materialize, small

#: Public vocabulary the sizes are measured with: a file of ranks and the module that tells its place and pattern.
VOCABULARY, TOKENIZERS = "byte_bpe_multi_50k.tiktoken", "public_tokenizers"
#: Items for which ranks get one more bucket.
BUCKET = 500_000
_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str = VOCABULARY, module: str = TOKENIZERS):
    """The tokenizer, loaded once in a process."""
    if (vocabulary, module) not in _ENCODERS:
        import tiktoken

        m = importlib.import_module(module)
        with open(m.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary, module] = tiktoken.Encoding(vocabulary, pat_str=m.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary, module]


def token_counts(docs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, module: str = TOKENIZERS) -> DataFrame:
    """``doc, n_tokens`` of each document; a null text has null tokens, an empty one none."""
    kind = dict(docs.dtypes)[doc]

    def count(batches):
        e = encoder(vocabulary, module)
        for t in sized(batches, 1):
            n = [None if x is None else len(e.encode_ordinary(x)) for x in column(t, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(t, doc), pa.array(n, pa.int32())], [doc, "n_tokens"])

    return docs.select(doc, text).mapInArrow(count, f"`{doc}` {kind}, n_tokens int")


class Tightest:
    """Segment tree over remaining capacities: the smallest open one that is at least a size."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.width, bool)

    def set(self, r: int, is_open: bool) -> None:
        i = self.width + r
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, size: int) -> int | None:
        i = self.width + size
        if self.open[i]:
            return size
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, first container, items a container): where items of a size go, by their rank from 0."""
    tree, spaces, containers, out = Tightest(capacity), {}, 0, []

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            spaces.setdefault(room, deque()).append((first, n))
            tree.set(room, True)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.find(size)
            if room is None:
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    out.append((size, rank, containers, per))
                    leave(capacity - per * size, containers, full)
                if rest:
                    out.append((size, rank + full * per, containers + full, rest))
                    leave(capacity - rest * size, containers + full, 1)
                containers += full + bool(rest)
                break
            first, n = spaces[room].popleft()
            per = room // size
            full = min(n, left // per)
            rest = left - full * per if full < n else 0
            rest = min(rest, per - 1)
            if full:
                out.append((size, rank, first, per))
                leave(room - per * size, first, full)
            if rest:
                out.append((size, rank + full * per, first + full, rest))
                leave(room - rest * size, first + full, 1)
            used = full + bool(rest)
            if used < n:
                spaces[room].appendleft((first + used, n - used))
            if not spaces[room]:
                tree.set(room, False)
            rank += full * per + rest
            left -= full * per + rest
    return np.array(out, np.int64).reshape(-1, 4)


def pack(sizes: DataFrame, key: str, size: str = "n_tokens", capacity: int = 4096) -> DataFrame:
    """``key, piece, n_tokens, container``: every item in a container, none above ``capacity``.

    An item larger than a container is divided into pieces of exactly the
    capacity and a last one of what is left, numbered from 0; no other item is
    divided.  Items of size 0, and of null size, take no room and have a null
    container, with piece 0.  Containers are numbered from 0; which of equal items
    goes where depends on their keys only.  Keys should be unique: repeated ones
    are items of their own.
    """
    s = F.col(size).cast("long")
    c = F.lit(capacity).cast("long")
    rows = sizes.select(F.col(key), s.alias("n"))
    whole = F.floor((F.col("n") - 1) / c)
    items = rows.where("n > 0").select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("piece"))
    items = items.select(key, F.col("piece").cast("int").alias("piece"), F.least(c, F.col("n") - F.col("piece") * c).cast("int").alias("n_tokens"))
    counts = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # capacity rows at most
    n = sum(counts.values())
    steps = plan(counts, capacity)
    buckets = max(8, n // BUCKET)
    order = [key, "piece"]
    items = items.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = Window.partitionBy("n_tokens", "bucket").orderBy(*order)
    fill = items.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fill = fill.select("n_tokens", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    ranked = items.withColumn("rank", F.row_number().over(by).cast("long") - 1).join(small(fill), ["n_tokens", "bucket"])
    ranked = ranked.select(key, "piece", "n_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    code = (steps[:, 0] << 44) | steps[:, 1]
    o = np.argsort(code)
    code, first, base, per = code[o], steps[o, 1], steps[o, 2], steps[o, 3]

    def place(batches):
        for b in batches:
            size, rank = (b.column(x).to_numpy().astype(np.int64) for x in ("n_tokens", "rank"))
            at = np.searchsorted(code, (size << 44) | rank, "right") - 1
            where = base[at] + (rank - first[at]) // per[at] if len(code) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("piece"), b.column("n_tokens"), pa.array(where)], [key, "piece", "n_tokens", "container"])

    kind = dict(sizes.dtypes)[key]
    placed = ranked.mapInArrow(place, f"`{key}` {kind}, piece int, n_tokens int, container long")
    none = rows.where("n is null or n <= 0").select(key, F.lit(0).alias("piece"), F.col("n").cast("int").alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none)


def containers(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = 4096, vocabulary: str = VOCABULARY, module: str = TOKENIZERS) -> DataFrame:
    """``pack`` of the documents by their tokens; texts are read once, sizes are kept."""
    return pack(materialize(token_counts(docs, doc, text, vocabulary, module)), doc, "n_tokens", capacity)
