"""Tiling, tile summaries and the side tables of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions import grid
from pointloom.session import small


def assign(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with the tile (``tile_row``, ``tile_col``) each lies in."""
    return points.withColumns(grid.tile(x, y, size))


def summary(points: DataFrame, size: float, by: list[str] | None = None) -> DataFrame:
    """The tile index: records and bounding box of each tile that holds any."""
    t = assign(points, size)
    return t.groupBy(*(by or []), "tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def feature_totals(points: DataFrame, feature: str = "feature", counts: list[str] | None = None) -> DataFrame:
    """Sum of each count column over all records of a feature."""
    return points.groupBy(feature).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in counts or ["ct"]])


def z_histogram(points: DataFrame, z: str = "z", by: list[str] | None = None) -> DataFrame:
    """Records by unit-wide bin of z, empty bins between the lowest and the highest included."""
    by = by or []
    full = points.where(F.col(z).isNotNull() & ~F.isnan(z)).groupBy(*by, F.floor(z).alias("z_bin")).agg(F.count(F.lit(1)).alias("n"))
    range_ = full.groupBy(*by).agg(F.sequence(F.min("z_bin"), F.max("z_bin")).alias("s")) if by else full.agg(F.sequence(F.min("z_bin"), F.max("z_bin")).alias("s")).where("s is not null")
    bins = range_.select(*by, F.explode("s").alias("z_bin"))
    return bins.join(full, [*by, "z_bin"], "left").select(*by, "z_bin", F.coalesce("n", F.lit(0)).alias("n"))


def extent(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least and greatest coordinates, of all points or by group."""
    g = points.groupBy(*by) if by else points
    return g.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def mono_raster(points: DataFrame, zoom: int, lowest: int, count: str = "ct", by: list[str] | None = None, quantile: float = 0.99) -> DataFrame:
    """Counts by screen pixel for zooms ``zoom`` down to ``lowest``, a parent the sum of its four children.

    ``shade`` is the count over the zoom's ``quantile`` of positive counts, at most 1.
    Each zoom is made from the one above it, so records are read once.
    """
    by = by or []
    level = points.withColumns({f"g{a}": F.col(f"t{a}") * 256 + F.col(f"p{a}") for a in "xy"} if "tx" in points.columns else {})
    level = level.groupBy(*by, "gx", "gy").agg(F.sum(F.round(F.col(count)).cast("long")).alias("n")).withColumn("zoom", F.lit(zoom))
    rolled = F.explode(F.sequence(F.lit(0), F.lit(zoom - lowest)))
    up = level.withColumn("up", rolled)
    p2 = F.pow(F.lit(2), F.col("up"))
    out = up.groupBy(*by, (F.col("zoom") - F.col("up")).alias("zoom"), F.floor(F.col("gx") / p2).alias("gx"), F.floor(F.col("gy") / p2).alias("gy")).agg(F.sum("n").alias("n"))
    top = out.where("n > 0").groupBy(*by, "zoom").agg(F.percentile("n", F.lit(quantile)).alias("q"))
    return out.join(small(top), [*by, "zoom"], "left").withColumn("shade", F.least(F.lit(1.0), F.try_divide(F.col("n").cast("double"), F.col("q"))))


def reorganize(tiled: DataFrame, size: float) -> DataFrame:
    """The records cut into regular tiles of another size, sorted by tile and placed by range of tiles."""
    return assign(tiled.drop("tile_row", "tile_col"), size).repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col")
