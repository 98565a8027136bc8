"""How often two items occur in the same basket, and how far beyond chance.

A pair is one 64-bit code, the smaller item in the high half.  Each task makes
the codes of its baskets, sorts them run by run and counts equal neighbours
(run-length counting); these counted runs go through Spark's external sort by
code - spilled runs, merged many ways - and equal codes of the merged stream are
added up in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.runs import changes, column, expand, sized, slabs
from pointloom.session import BROADCAST_ROWS, materialize, small

#: Codes sorted in memory at once: a run.
RUN = 4_000_000
#: Items of a basket above which its pairs are made by several tasks, from two pieces of that many items each.
PIECE = 2_000


def pair_counts(rows: DataFrame, basket: list[str], item: str, min_count: int = 1, one_in: int = 0) -> DataFrame:
    """``a, b, n_ab, n_a, n_b, n, lift, log_odds`` for a < b (integer items) that share a basket.

    ``n`` counts the baskets that hold a known item, ``n_a`` and ``n_b`` those
    that hold the item.  An item counts once in a basket, so repeated rows add
    nothing.  Null items are left out; a null in the basket's columns is a value.
    Pairs in fewer than ``min_count`` baskets, or fewer than one in ``one_in`` of
    all (0: no such bound), are left out: their items are dropped from baskets
    first if already too rare by themselves, which loses no other pair and leaves
    at most ``one_in`` times the mean basket size different items, however many
    there are.  Items are integers from 0 to 2^31 - 1, others raise an error.  A
    basket of more than ``PIECE`` different items is cut into pieces, and each two
    of them are a unit of work of their own.  ``log_odds`` is the log odds ratio with half a basket added to
    each cell.
    """
    fits = F.col(item).cast("long").between(0, (1 << 31) - 1)
    number = F.when(fits, F.col(item)).otherwise(F.raise_error(F.lit("items are integers from 0 to 2^31 - 1"))).cast("int")
    sets = rows.where(F.col(item).isNotNull()).groupBy(*basket).agg(F.sort_array(F.collect_set(number)).alias("items"))
    sets = materialize(sets.select("items"))
    n = sets.count()
    least = max(min_count, -(-n // one_in) if one_in else 1)
    singles = materialize(sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item")))
    kept = singles.where(F.col("n_item") >= least)

    keep = None
    if least > 1:
        few = kept.select("item").limit(BROADCAST_ROWS + 1).collect()
        if len(few) <= BROADCAST_ROWS:
            keep = np.sort(np.array([r[0] for r in few], np.int64))
        else:  # too many for the driver: a join leaves them in the baskets
            each = sets.withColumn("b", F.monotonically_increasing_id()).select("b", F.explode("items").alias("item"))
            sets = materialize(each.join(kept.select("item"), "item").groupBy("b").agg(F.sort_array(F.collect_list("item")).alias("items")).select("items"))

    def runs(batches):
        held, many = [], 0
        for t in sized(batches, 50_000):
            if "others" in t.column_names:  # two pieces of one basket: every item of the first with every item of the second
                for x, y in zip(t.column("items").to_pylist(), t.column("others").to_pylist()):
                    x, y = (np.array(v, np.int64) if keep is None else np.intersect1d(v, keep).astype(np.int64) for v in (x, y))
                    held.append(((x[:, None] << 32) | y[None, :]).ravel())
                    many += len(held[-1])
                    if many >= RUN:
                        yield counted(np.concatenate(held))
                        held, many = [], 0
                continue
            lists = column(t, "items")
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if keep is not None:
                at = np.searchsorted(keep, values)
                ok = (at < len(keep)) & (keep[np.minimum(at, max(0, len(keep) - 1))] == values) if len(keep) else np.zeros(len(values), bool)
                values, owner = values[ok], owner[ok]
            ends = np.searchsorted(owner, owner, "right")
            after = np.arange(len(values)) + 1
            for s in slabs(ends - after, RUN):
                a, b = expand(after[s], ends[s])
                held.append((values[s][a] << 32) | values[b])
                many += len(b)
                if many >= RUN:
                    yield counted(np.concatenate(held))
                    held, many = [], 0
        if many:
            yield counted(np.concatenate(held))

    def merged(batches):
        code = total = None
        for b in batches:
            if not b.num_rows:
                continue
            c, k = b.column("code").to_numpy(), b.column("k").to_numpy()
            at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            c, k = c[at], np.add.reduceat(k, at)
            if code is not None and c[0] == code:
                k[0] += total
            elif code is not None:
                yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], ["code", "k"])
            code, total = int(c[-1]), int(k[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]), pa.array(k[:-1])], ["code", "k"])
        if code is not None:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], ["code", "k"])

    schema = "code long, k long"
    large = F.size("items") > PIECE
    made = sets.where(~large).mapInArrow(runs, schema)
    if sets.where(large).limit(1).count():
        pieces = sets.where(large).withColumn("n", F.ceil(F.size("items") / PIECE).cast("int"))
        cut = lambda i: F.slice("items", F.col(i) * PIECE + 1, F.lit(PIECE))
        pieces = pieces.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("n") - 1)))
        pieces = pieces.select(cut("i").alias("items"), cut("j").alias("others"), (F.col("i") == F.col("j")).alias("same")).repartition(F.xxhash64("items", "others"))
        made = made.unionByName(pieces.where("not same").select("items", "others").mapInArrow(runs, schema)).unionByName(pieces.where("same").select("items").mapInArrow(runs, schema))
    pairs = made.repartition("code").sortWithinPartitions("code").mapInArrow(merged, schema).where(F.col("k") >= least)
    pairs = pairs.select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), F.col("k").alias("n_ab"))
    known = small(kept)
    pairs = pairs.join(known.select(F.col("item").alias("a"), F.col("n_item").alias("n_a")), "a").join(known.select(F.col("item").alias("b"), F.col("n_item").alias("n_b")), "b")
    pairs = pairs.select("a", "b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"))
    half = F.lit(0.5)
    rest = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    odds = (F.col("n_ab") + half) * (rest + half) / ((F.col("n_a") - F.col("n_ab") + half) * (F.col("n_b") - F.col("n_ab") + half))
    return pairs.withColumns({"lift": F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")), "log_odds": F.log(odds)})


def counted(codes: np.ndarray) -> pa.RecordBatch:
    """One sorted run: each code of it with its count."""
    codes.sort()
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(codes[at]), pa.array(np.diff(np.r_[at, len(codes)]))], ["code", "k"])
