"""Joins of points with pixel annotations, of several annotations, and with anchors.

An annotation is a table of pixels ``px, py[, pz][, feature]`` with ``kp``, its
(factor, probability) pairs.  Keys are integers of a grid, so every join here is
an equi-join that Spark plans as a hash or merge join; sources of coarser grids
join by the coarse index of the fine pixel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import grid, pairs
from pointloom.operators.proximity import points_in_rings
from pointloom.session import feature_name, small


def annotate(points: DataFrame, anno: DataFrame, res: float, by: list[str] = (), z_res: float | None = None, feature: bool = False, keep_all: bool = False) -> DataFrame:
    """Points with the ``kp`` of their pixel; inner, or with ``keep_all`` every point and null ``kp`` where there is none.

    ``z_res`` adds z to the key and ``feature`` the feature, for annotations of
    single molecules; features the annotation doesn't know are unmatched.
    """
    key = [*by, "px", "py", *(["pz"] if z_res else []), *(["feature"] if feature else [])]
    p = points.withColumns({"px": grid.pixel("x", res), "py": grid.pixel("y", res), **({"pz": grid.pixel("z", z_res)} if z_res else {})})
    return p.join(anno.select(*key, "kp"), key, "left" if keep_all else "inner")


def merge(main: DataFrame, others: list[tuple[DataFrame, int]], by: list[str] = (), keep: str = "inner", keep_pairs: list[int] | None = None, names: list[str] | None = None, feature: bool = False) -> DataFrame:
    """Several annotations on the pixels of ``main``, one column ``kp_<name>`` each.

    Each other source comes with its ratio: how many pixels of ``main`` lie along
    one of its own (1 or more; it then joins all pixels it covers).  ``keep``:
    'inner' wants all sources, 'main' every pixel of main, 'all' also pixels that
    only others have, a coarse one at its first fine pixel.  ``keep_pairs`` cuts
    each source's pairs to the first so many.  2-D sources join all z of a 3-D main.
    ``feature``: annotations of single molecules, whose ``feature`` belongs to the
    key.  Each source has its own dictionary, so features compare by name, trimmed
    and in lower case; null names match nothing, and the result has that form.
    """
    if feature:
        main, others = _named(main), [(_named(d), ratio) for d, ratio in others]
        by = [*by, "feature"]
    names = names or [str(i) for i in range(len(others) + 1)]
    cut = lambda i: pairs.first("kp", keep_pairs[i]) if keep_pairs else F.col("kp")
    deep = "pz" in main.columns
    key = [*by, "px", "py", *(["pz"] if deep else [])]
    base = main.select(*key, cut(0).alias(f"kp_{names[0]}"))
    if keep == "all":
        if deep and any("pz" not in d.columns for d, _ in others):
            raise ValueError("2-D sources can't add pixels to a 3-D one")
        lattice = main.select(*key)
        for d, ratio in others:
            at = [F.col("px") * ratio, F.col("py") * ratio]
            lattice = lattice.union(d.select(*by, at[0].alias("px"), at[1].alias("py"), *(["pz"] if deep else [])))
        base = lattice.distinct().join(base, key, "left")
    for i, (d, ratio) in enumerate(others, 1):
        if ratio < 1 or ratio != int(ratio):
            raise ValueError("a source's pixels must be a whole multiple of the main source's")
        own = [*by, "qx", "qy", *(["pz"] if deep and "pz" in d.columns else [])]
        d = d.withColumnsRenamed({"px": "qx", "py": "qy"}).select(*own, cut(i).alias(f"kp_{names[i]}"))
        base = base.withColumns({"qx": F.floor(F.col("px") / ratio), "qy": F.floor(F.col("py") / ratio)})
        base = base.join(d, own, "inner" if keep == "inner" else "left").drop("qx", "qy")
    return base


def _named(anno: DataFrame) -> DataFrame:
    return anno.where("feature is not null").withColumn("feature", feature_name("feature"))


def region_soft(anno: DataFrame, rings: DataFrame, res: float, group: str = "sample_id") -> DataFrame:
    """``region, k, pixels, mass`` of an annotation's factors in each region; a pixel belongs to the regions that hold its middle.

    Only pixels of cells that a region's edge crosses are tested, by the cover of
    ``points_in_rings``; a pixel in two regions counts in both.
    """
    p = anno.select(group, "px", "py", "kp").withColumn("pixel", F.xxhash64(group, "px", "py"))
    middle = p.select("pixel", group, ((F.col("px") + 0.5) * res).alias("x"), ((F.col("py") + 0.5) * res).alias("y"))
    held = points_in_rings(middle, rings, key="pixel", group=group)
    e = p.join(held, F.col("pixel") == F.col("id")).select("region", F.explode("kp").alias("e"))
    return e.groupBy("region", F.col("e.k").alias("k")).agg(F.count(F.lit(1)).alias("pixels"), F.sum("e.p").alias("mass"))


def annotate_merged(points: DataFrame, main: DataFrame, others: list[tuple[DataFrame, int]], res: float, by: list[str] = (), keep: str = "inner", keep_all: bool = False) -> DataFrame:
    """Points with the pairs of all merged sources of their pixel, planned as one query."""
    m = merge(main, others, by, keep)
    p = points.withColumns({"px": grid.pixel("x", res), "py": grid.pixel("y", res)})
    return p.join(m, [*by, "px", "py"], "left" if keep_all else "inner")


def roi_counts(points: DataFrame, held: DataFrame, key: str = "point_id", feature: str = "feature", count: str = "ct", least: int = 1) -> DataFrame:
    """``region, feature, ct`` of the points in each region (``held``: id, region); points in several count in each.

    Counts of 0 and below are dropped; a region stays if any of its features reaches ``least``.
    """
    j = held.join(points.select(F.col(key).alias("id"), feature, F.col(count).cast("long").alias("ct")), "id")
    c = j.groupBy("region", feature).agg(F.sum("ct").alias("ct")).where("ct > 0")
    kept = c.groupBy("region").agg(F.max("ct").alias("m")).where(F.col("m") >= least)
    return c.join(kept.select("region"), "region", "left_semi")


def near_anchors(points: DataFrame, anchors: DataFrame, radius: float, by: list[str] = (), key: str = "point_id") -> DataFrame:
    """All (point, anchor) closer than ``radius``: the point's key and group, ``anchor_id, layer, d``.

    Anchors are copied to the 3x3 cells of the radius around them and joined by
    cell; anchors are the smaller side, so points are not copied.
    """
    p = points.withColumns({"cx": grid.pixel("x", radius), "cy": grid.pixel("y", radius)}).select(key, *by, "x", "y", "cx", "cy")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = anchors.withColumn("s", F.explode(around))
    a = a.select(*by, "anchor_id", "layer", F.col("x").alias("ax"), F.col("y").alias("ay"), (grid.pixel("x", radius) + F.col("s.i")).alias("cx"), (grid.pixel("y", radius) + F.col("s.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    out = p.join(a, [*by, "cx", "cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < radius * radius)
    return out.select(key, *by, "anchor_id", "layer", F.sqrt("d2").alias("d"))


def anchor_layers(points: DataFrame, anchors: DataFrame, radius: float, background: int, by: list[str] = (), key: str = "point_id") -> DataFrame:
    """Points once for each layer that has an anchor within ``radius``, others in layer ``background``."""
    hit = near_anchors(points, anchors, radius, by, key).select(key, "layer").distinct()
    return points.join(hit, key, "left").withColumn("layer", F.coalesce("layer", F.lit(background)))


def nearest_anchor(points: DataFrame, anchors: DataFrame, radius: float, by: list[str] = (), key: str = "point_id") -> DataFrame:
    """The nearest anchor within ``radius`` of each point that has one, the smaller id among equally near ones."""
    n = near_anchors(points, anchors, radius, by, key)
    return n.groupBy(key).agg(F.min(F.struct("d", "anchor_id", "layer")).alias("m")).select(key, "m.anchor_id", "m.layer", "m.d")


def matrix_points(matrix: DataFrame, barcodes: DataFrame, positions: DataFrame, genes: DataFrame, microns: float = 1.0, in_tissue: bool = True, exclude: str | None = None) -> DataFrame:
    """Counts of a barcode matrix at their positions: ``x, y, feature, ct``.

    ``matrix``: gene and barcode index (from 1) and count; ``exclude`` drops genes whose name matches anywhere.
    """
    pos = positions.where("in_tissue = 1") if in_tissue else positions
    g = genes.where(~F.col("feature").rlike(exclude)) if exclude else genes
    out = matrix.join(barcodes, "barcode_idx").join(pos, "barcode").join(small(g), "gene_idx")
    return out.select((F.col("x") * microns).alias("x"), (F.col("y") * microns).alias("y"), "feature", "ct")


def pseudobulk(units: DataFrame, labels: DataFrame, unit: str = "unit_id", feature: str = "feature", count: str = "ct") -> DataFrame:
    """Counts of each feature summed by the label of its unit; units without label are left out."""
    return units.join(labels.select(unit, "label"), unit).groupBy("label", feature).agg(F.sum(F.col(count).cast("long")).alias("ct"))


def shared_features(rows: DataFrame, sample: str = "sample_id", feature: str = "feature", count: str = "ct", least: int = 1) -> DataFrame:
    """Features by their least total in any sample (0 where absent): ``feature, least_total, total``, at least ``least``."""
    per = rows.groupBy(feature, sample).agg(F.sum(F.col(count).cast("long")).alias("n"))
    samples = rows.select(sample).distinct().count()
    out = per.groupBy(feature).agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    out = out.select(feature, F.when(F.col("k") < samples, 0).otherwise(F.col("m")).cast("long").alias("least_total"), "total")
    return out.where(F.col("least_total") >= least)


def union_samples(parts: dict[str, DataFrame], sample: str = "sample_id") -> DataFrame:
    """All samples' rows with the sample they come from."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(sample, F.lit(s)) for s, d in parts.items()])


def add_matrices(parts: list[DataFrame], row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Cell-wise sum of sparse matrices in long form."""
    return reduce(DataFrame.unionByName, parts).groupBy(row, col).agg(F.sum(value).alias(value))
