"""Rankings: mutual ranks, neighbours of factors, pyramid thinning, balanced bins."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.session import small


def top_rows(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``; Spark cuts groups down before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def mutual_neighbours(matrix: DataFrame, max_rank: int, m: int, one: str = "f1", two: str = "f2", value: str = "weight") -> DataFrame:
    """Pairs of features by the worse of their two ranks: ``f1, f2, score, rank``.

    Each feature ranks its partners by value (ties by name); pairs whose worse
    rank exceeds ``max_rank`` or whose value is 0 are dropped, the best ``m``
    partners kept.
    """
    t = matrix.where((F.col(value) > 0) & (F.col(one) != F.col(two))).select(F.col(one).alias("f1"), F.col(two).alias("f2"), F.col(value).alias("v"))
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("f1").orderBy(F.desc("v"), "f2"))).where(F.col("r") <= max_rank)
    both = r.join(r.select(F.col("f1").alias("f2"), F.col("f2").alias("f1"), F.col("r").alias("r2")), ["f1", "f2"])
    both = both.withColumn("score", F.greatest("r", "r2"))
    return top_rows(both.select("f1", "f2", "v", "score"), ["f1"], ["score", F.desc("v"), "f2"], m)


def similar_factors(bulk: DataFrame, k: int, factor: str = "factor", feature: str = "feature", value: str = "n") -> DataFrame:
    """Each factor's ``k`` most similar factors by the cosine of their feature columns: ``factor, other, cosine, rank``."""
    norm = bulk.groupBy(factor).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))
    b = bulk.join(small(norm), factor).select(F.col(factor).alias("factor"), F.col(feature).alias("f"), (F.col(value) / F.col("norm")).alias("v"))
    dot = b.join(b.select(F.col("factor").alias("other"), "f", F.col("v").alias("w")), "f").where("factor != other").groupBy("factor", "other").agg(F.sum(F.col("v") * F.col("w")).alias("cosine"))
    return top_rows(dot, ["factor"], [F.desc("cosine"), "other"], k)


def pyramid(points: DataFrame, zoom: int, lowest: int, most: int, priority, by: list[str] = ()) -> DataFrame:
    """Rows shown at each zoom: a tile keeps its ``most`` rows of least priority among those its children keep.

    ``points`` carry the tile ``tx, ty`` of the highest zoom and everything else
    to show.  Priorities are a column that doesn't depend on the zoom, such as a
    hash of the id, so a row's place is the same in all tiles and rows kept in a
    parent were kept in the child.
    """
    out = None
    level = points.withColumns({"priority": priority, "zoom": F.lit(zoom)})
    for z in range(zoom, lowest - 1, -1):
        if z < zoom:
            level = level.withColumns({"tx": F.shiftright("tx", 1), "ty": F.shiftright("ty", 1), "zoom": F.lit(z)})
        level = top_rows(level, [*by, "tx", "ty"], ["priority"], most).drop("rank")
        out = level if out is None else out.unionByName(level)
    return out


def random_order(units: DataFrame, seed: int, *key: str) -> DataFrame:
    """Units in an order given by a seeded hash of their key; Spark sorts externally."""
    return units.withColumn("random_key", F.xxhash64(F.lit(seed), *key)).orderBy("random_key", *key)


def fixed_bins(counts: list[tuple[str, int]], bins: int) -> list[tuple[str, int, int]]:
    """Features by descending count in ``bins`` runs; one closes once it holds its share of what is left."""
    rest, out, held, b = sum(c for _, c in counts), [], 0, 1
    for f, c in sorted(counts, key=lambda x: (-x[1], x[0])):
        out.append((f, c, b))
        held += c
        if b < bins and held * (bins - b + 1) >= rest:
            rest, held, b = rest - held, 0, b + 1
    return out


def adaptive_bins(counts: list[tuple[str, int]], target: int, ratio: float = 0.5) -> list[tuple[str, int, int]]:
    """Features of at least ``ratio`` of ``target`` alone, others to the least filled of as many bins as they need."""
    ordered = sorted(counts, key=lambda x: (-x[1], x[0]))
    alone = [(f, c) for f, c in ordered if c >= ratio * target]
    rest = ordered[len(alone) :]
    out = [(f, c, i + 1) for i, (f, c) in enumerate(alone)]
    n = max(1, -(-sum(c for _, c in rest) // target)) if rest else 0
    heap = [(0, 0, len(alone) + 1 + i) for i in range(n)]
    for f, c in rest:
        held, k, b = heapq.heappop(heap)
        out.append((f, c, b))
        heapq.heappush(heap, (held + c, k + 1, b))
    return out


def profile_similarity(bulk: DataFrame) -> DataFrame:
    """``a, b, coefficient`` for factors a < b of ``factor, feature, n``: Bhattacharyya coefficient of their shares of features.

    Factors are as many as a model has; rows join by feature, with all factors of one feature together.
    """
    cols = bulk.groupBy("factor").agg(F.sum("n").alias("col"))
    p = bulk.where("n > 0").join(small(cols), "factor").select("factor", "feature", F.sqrt(F.col("n") / F.col("col")).alias("r"))
    each = p.groupBy("feature").agg(F.collect_list(F.struct("factor", "r")).alias("v"))  # at most as many as factors
    both = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y["factor"] > x["factor"]), lambda y: F.struct(x["factor"].alias("a"), y["factor"].alias("b"), (x["r"] * y["r"]).alias("r")))))
    out = each.select(F.explode(both).alias("e")).groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.sum("e.r").alias("coefficient"))
    return out.withColumn("coefficient", F.least("coefficient", F.lit(1.0)))
