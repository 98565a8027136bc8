"""Aggregations over grids, cells and factor probabilities, and co-occurrence within a radius."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import grid, pairs
from pointloom.functions.stats import chisq_2x2
from pointloom.operators.proximity import KEYS, chunks, close, filed
from pointloom.session import small


def hex_units(points: DataFrame, size: float, by: list[str] = (), feature: str = "feature", counts: list[str] = ("ct",), least: dict[str, int] | None = None) -> DataFrame:
    """Counts by hexagon and feature; hexagons stay if any count column sums to its threshold in ``least``."""
    return _units(points.withColumns(grid.hexagon("x", "y", size)), [*by, "hx", "hy"], feature, counts, least)


def bcc_units(points: DataFrame, size: float, by: list[str] = (), feature: str = "feature", counts: list[str] = ("ct",), least: dict[str, int] | None = None) -> DataFrame:
    """Counts by cell of the body-centred cubic lattice and feature."""
    return _units(points.withColumns(grid.bcc("x", "y", "z", size)), [*by, "bx", "by", "bz"], feature, counts, least)


def square_units(points: DataFrame, size: float, by: list[str] = (), feature: str = "feature", counts: list[str] = ("ct",), least: dict[str, int] | None = None) -> DataFrame:
    return _units(points.withColumns({"ux": grid.pixel("x", size), "uy": grid.pixel("y", size)}), [*by, "ux", "uy"], feature, counts, least)


def layered_units(layered: DataFrame, size: float, by: list[str] = (), feature: str = "feature", counts: list[str] = ("ct",)) -> DataFrame:
    """Counts by layer (of ``anchor_layers``), hexagon and feature."""
    return _units(layered.withColumns(grid.hexagon("x", "y", size)), [*by, "layer", "hx", "hy"], feature, counts, None)


def _units(points: DataFrame, unit: list[str], feature: str, counts, least) -> DataFrame:
    out = points.groupBy(*unit, feature).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in counts])
    if not least:
        return out
    sums = out.groupBy(*unit).agg(*[F.sum(c).alias(f"__{c}") for c in least])
    ok = reduce(lambda a, b: a | b, [F.col(f"__{c}") >= n for c, n in least.items()])
    return out.join(sums.where(ok).select(*unit), unit, "left_semi")


def sparse_rows(units: DataFrame, unit: list[str], feature: str = "feature", count: str = "ct", seed: int = 0) -> DataFrame:
    """One row a unit: random key, number of features, total, and its (feature, count) pairs in order of the feature."""
    pairs_ = F.sort_array(F.collect_list(F.struct(F.col(feature).alias("feature"), F.col(count).alias("ct"))))
    out = units.where(F.col(count) > 0).groupBy(*unit).agg(F.count(F.lit(1)).alias("n_features"), F.sum(count).alias("total"), pairs_.alias("pairs"))
    return out.withColumn("random_key", grid.unit_key(seed, *unit))


def total_histogram(units: DataFrame, unit: list[str], count: str = "ct", width: int = 5) -> DataFrame:
    """Units by total count in bins of ``width``."""
    t = units.groupBy(*unit).agg(F.sum(count).alias("t"))
    return t.groupBy((F.floor(F.col("t") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n_units"))


def occurrence(units: DataFrame, unit: list[str], n_units: int, feature: str = "feature", count: str = "ct") -> DataFrame:
    """Statistics of each feature over units (``units``: one row for each unit and feature).

    ``n_gt_mean`` counts units with a count above the mean over all units, tested
    in integers.
    """
    c = F.col(count).cast("long")
    t = units.groupBy(feature).agg(F.sum(c).alias("total_count"), F.sum((c > 0).cast("long")).alias("n_units_present"), F.sum((c > 1).cast("long")).alias("n_units_count_gt1"), F.sum((c > 2).cast("long")).alias("n_units_count_gt2"))
    above = units.join(small(t.select(feature, "total_count")), feature).where(c * n_units > F.col("total_count")).groupBy(feature).agg(F.count(F.lit(1)).alias("n_units_count_gt_mean"))
    return t.join(above, feature, "left").fillna(0, ["n_units_count_gt_mean"])


def feature_weights(stats: DataFrame, n_units: int, q: float = 0.95, power: float = 0.3, low: float = 0.1, high: float = 1.0, cap: float = 5.0) -> DataFrame:
    """``stats`` with ``idf`` and ``info_weight``.

    idf: ``ln(N / (1 + df))``, at least 0, over its q-th percentile, at most 1, to
    ``power``, moved into [low, high].  info: ``log2(T / t)`` over its mean
    weighted by counts, at most ``cap``, which absent features get too.
    """
    s = stats.withColumn("r", F.greatest(F.lit(0.0), F.log(F.lit(float(n_units)) / (1 + F.col("n_units_present")))))
    t = F.col("total_count").cast("double")
    whole = s.agg(F.sum(t).alias("T"), F.percentile("r", F.lit(q)).alias("q")).first()
    total, scale = whole["T"] or 0.0, whole["q"] or 0.0
    share = F.least(F.lit(1.0), F.pow(F.col("r") / F.lit(scale if scale > 0 else 1.0), F.lit(power)))
    bits = F.when(t > 0, F.log2(F.lit(total) / t))
    mean = s.agg(F.sum(t * bits) / F.lit(total or 1.0)).first()[0] or 1.0
    return s.withColumns({"idf": F.lit(low) + F.lit(high - low) * share, "info_weight": F.coalesce(F.least(F.lit(cap), bits / F.lit(mean)), F.lit(cap))}).drop("r")


def cell_factors(annotated: DataFrame, cell: list[str], k_out: int, compartment: str | None = None) -> DataFrame:
    """Sum of probabilities by cell and factor, the ``k_out`` greatest, and the records that had an annotation.

    With ``compartment`` there is a row set for each compartment besides 'ALL'.
    """
    a = annotated.where("kp is not null")
    if compartment:
        a = a.withColumn("comp", F.explode(F.array(F.lit("ALL"), F.col(compartment).cast("string")))).where("comp is not null")
        cell = [*cell, "comp"]
    n = a.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_query"))
    s = a.select(*cell, F.explode("kp").alias("e")).groupBy(*cell, F.col("e.k").alias("k")).agg(F.sum("e.p").alias("mass"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("mass"), "k"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k_out).join(n, cell)


def compartment_bulk(annotated: DataFrame, compartment: str) -> DataFrame:
    """Mass of each factor in each compartment, rows without any left out."""
    t = annotated.where(F.col(compartment).isNotNull()).select(compartment, F.explode("kp").alias("e"))
    return t.groupBy(compartment, F.col("e.k").alias("k")).agg(F.sum("e.p").alias("mass")).where("mass > 0")


def marginal(anno: DataFrame, kp: str = "kp") -> DataFrame:
    """Sum of each factor's probabilities."""
    return anno.select(F.explode(kp).alias("e")).groupBy(F.col("e.k").alias("k")).agg(F.sum("e.p").alias("mass"))


def joint(anno: DataFrame, kp: str = "kp") -> DataFrame:
    """Sum over pixels of p_i p_j for each unordered pair of pairs, a pair with itself included."""
    i = F.posexplode(kp).alias("i", "a")
    t = anno.select(F.col(kp).alias("kp"), i).select("a", F.explode(F.expr("slice(kp, i + 1, size(kp))")).alias("b"))
    return t.groupBy(F.least("a.k", "b.k").alias("k1"), F.greatest("a.k", "b.k").alias("k2")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("mass"))


def cross(merged: DataFrame, one: str, two: str) -> DataFrame:
    """Factors of one source against those of another: sum of p1 p2 with odds ratio and chi-square against independence.

    The table of a pair is its sum, the rest of its row, of its column, and of all;
    half the lesser of 0.5 and the least positive sum is added to each cell.
    """
    t = merged.where(F.col(one).isNotNull() & F.col(two).isNotNull()).select(F.explode(one).alias("a"), F.col(two).alias("t")).select("a", F.explode("t").alias("b"))
    s = t.groupBy(F.col("a.k").alias("k1"), F.col("b.k").alias("k2")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("mass"))
    rows, cols = s.groupBy("k1").agg(F.sum("mass").alias("r")), s.groupBy("k2").agg(F.sum("mass").alias("c"))
    whole = s.agg(F.sum("mass").alias("n"), F.min(F.when(F.col("mass") > 0, F.col("mass"))).alias("least")).first()
    n, pseudo = whole["n"] or 0.0, 0.5 * min(0.5, whole["least"] or 0.5)
    s = s.join(small(rows), "k1").join(small(cols), "k2")
    a, b, c = F.col("mass"), F.col("r") - F.col("mass"), F.col("c") - F.col("mass")
    d = F.lit(n) - F.col("r") - F.col("c") + F.col("mass")
    zero = lambda v: F.greatest(F.lit(0.0), v)
    p = F.lit(pseudo)
    odds = F.log2((a + p) * (zero(d) + p) / ((zero(b) + p) * (zero(c) + p)))
    return s.select("k1", "k2", "mass", odds.alias("log2_or"), chisq_2x2(a, zero(b), zero(c), zero(d), pseudo).alias("chisq"))


def confusion(anno: DataFrame, side: int | None = None, by: list[str] = ()) -> DataFrame:
    """Factor by factor confusion: ``k1, k2, mass``.

    Without ``side`` the sum of p_i p_j over ordered pairs of a pixel.  With it,
    pixels are pooled in squares of ``side`` pixels: a square of mass w and shares m
    adds ``w m_i m_j``.
    """
    if side is None:
        t = anno.select(F.explode("kp").alias("a"), "kp").select("a", F.explode("kp").alias("b"))
        return t.groupBy(F.col("a.k").alias("k1"), F.col("b.k").alias("k2")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("mass"))
    sq = [*by, "sx", "sy"]
    s = anno.select(*by, F.floor(F.col("px") / side).alias("sx"), F.floor(F.col("py") / side).alias("sy"), F.explode("kp").alias("e"))
    s = s.groupBy(*sq, F.col("e.k").alias("k")).agg(F.sum("e.p").alias("m")).where("m > 0")
    # a square has at most as many factors as there are; its pairs are made within its row
    g = s.groupBy(*sq).agg(F.sum("m").alias("w"), F.collect_list(F.struct("k", "m")).alias("l"))
    t = g.select("w", F.explode("l").alias("a"), "l").select("w", "a", F.explode("l").alias("b"))
    return t.groupBy(F.col("a.k").alias("k1"), F.col("b.k").alias("k2")).agg(F.sum(F.col("a.m") * F.col("b.m") / F.col("w")).alias("mass"))


def soft_units(annotated: DataFrame, size: float, least: float, by: list[str] = (), feature: str = "feature", count: str = "ct") -> DataFrame:
    """Counts shared out to factors: sum of ct p by factor, square of ``size`` and feature, over pairs with p >= ``least``."""
    a = annotated.where("kp is not null").withColumns({"ux": grid.pixel("x", size), "uy": grid.pixel("y", size)})
    a = a.select(*by, "ux", "uy", feature, F.col(count).alias("c"), F.explode(pairs.at_least("kp", least)).alias("e"))
    return a.groupBy(*by, F.col("e.k").alias("k"), "ux", "uy", feature).agg(F.sum(F.col("c") * F.col("e.p")).alias("mass"))


def resampled(anno: DataFrame, ratio: int, k: int, by: list[str] = ()) -> DataFrame:
    """Pixels pooled ``ratio`` by ``ratio``: probabilities summed by factor and the top ``k`` kept, as ``kp``."""
    key = [*by, "px", "py"]
    t = anno.select(*by, F.floor(F.col("px") / ratio).alias("px"), F.floor(F.col("py") / ratio).alias("py"), F.explode("kp").alias("e"))
    s = t.groupBy(*key, F.col("e.k").alias("k")).agg(F.sum("e.p").alias("p"))
    return s.groupBy(*key).agg(pairs.top(F.collect_list(F.struct("k", "p")), k).alias("kp"))


def cooccurrence(points: DataFrame, radius: float, by: list[str] = (), half: float | None = None, tile: float | None = None, least_neighbours: int = 1, by_count: bool = False, key: str = "point_id", feature: str = "feature", local_least: float = 0.0) -> DataFrame:
    """``f1, f2, weight`` over ordered pairs of records less than ``radius`` apart, a record with itself included.

    ``tile`` keeps pairs within square tiles of that size; without it space has no
    seams.  Records with fewer than ``least_neighbours`` neighbours (themselves
    counted) take no part as the first.  A pair weighs 1, or the product of counts
    (each at most 255) with ``by_count``, times ``exp(-ln 2 d^2 / half^2)`` if
    ``half`` is given; repeated rows of a record count once.  Cells of the result below ``local_least`` are dropped.
    """
    t = points.select(*by, F.xxhash64(key).alias("i"), F.col(feature).cast("string").alias("f"), "x", "y", F.least(F.lit(255), F.col("ct")).cast("double").alias("c"))
    extra = []
    if tile:
        t = t.withColumns(grid.tile("x", "y", tile))
        extra = ["tile_row", "tile_col"]
    for c in by:
        t = t.where(F.col(c).isNotNull())
    t = t.withColumn("g", F.concat_ws("\x1f", F.lit(""), *by, *extra))
    r2 = radius * radius

    def count(batches):
        for rows in chunks(batches, KEYS):
            coded = rows.column("f").combine_chunks().dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            f = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            c = rows.column("c").combine_chunks().to_numpy(zero_copy_only=False)
            enough = None
            if least_neighbours > 1:
                enough = sum((np.bincount(a, minlength=len(f)) for a, _, _ in close(rows, r2)), np.zeros(len(f), np.int64)) >= least_neighbours
            held: dict[int, float] = {}
            for a, b, d2 in close(rows, r2):
                if enough is not None:
                    a, b, d2 = a[enough[a]], b[enough[a]], d2[enough[a]]
                w = c[a] * c[b] if by_count else np.ones(len(a))
                if half:
                    w = w * np.exp(-0.6931471805599453 / (half * half) * d2)
                code, at = np.unique(f[a] * len(names) + f[b], return_inverse=True)
                for k, v in zip(code.tolist(), np.bincount(at, w, len(code)).tolist()):
                    held[k] = held.get(k, 0.0) + v
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([names[k // len(names)] for k in held], pa.string()), pa.array([names[k % len(names)] for k in held], pa.string()), pa.array(list(held.values()))], ["f1", "f2", "w"])

    # pairs are counted where they are found; what is shuffled after that are counters
    parts = filed(t, radius, "i", "x", "y", "g", ["f", "c"]).mapInArrow(count, "f1 string, f2 string, w double")
    out = parts.groupBy("f1", "f2").agg(F.sum("w").alias("weight"))
    return out.where(F.col("weight") >= local_least) if local_least else out
