"""Queries of map tiles, checked by what their tiles hold when read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.functions.grid import EARTH
from pointloom.plans.reference import _ANCHORS, _anchors, points, query
from pointloom.session import table
from pointloom.sources import maptiles, tiled


def _metres(p):
    """A micron of the data as a kilometre of the map, so that a few zooms are enough."""
    return p.withColumns({"x": F.col("x") * 1000, "y": F.col("y") * 1000})


@query(f"""SELECT CAST(floor((x * 1000 + {EARTH!r}) / {2 * EARTH!r} * 1048576) AS BIGINT) AS u, CAST(floor(({EARTH!r} - y * 1000) / {2 * EARTH!r} * 1048576) AS BIGINT) AS v, feature, ct FROM p""")
def point_tiles(spark, sf):
    enc = tiled.point_tiles(_metres(points(spark, sf)), 8, "points", ["feature", "ct"])
    back = maptiles.export_tiles(enc, {"feature": "string", "ct": "bigint"})
    side = F.lit(float(4096 << 8))
    u = F.floor((F.col("x") + F.lit(EARTH)) / F.lit(2 * EARTH) * side)
    v = F.floor((F.lit(EARTH) - F.col("y")) / F.lit(2 * EARTH) * side)
    return back.select(u.alias("u"), v.alias("v"), "feature", "ct")


@query()
def polygon_tiles(spark, sf):
    r = table(spark, sf, "rings").where("polygon_id is not null and size(ring) >= 3").dropDuplicates(["feature_id"])
    r = r.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] * 1000).alias("x"), (p["y"] * 1000).alias("y"))))
    return maptiles.polygon_tiles(r, 7, "outlines", ["polygon_id"]).select("z", "x", "y", F.length("data").alias("bytes"))


@query()
def sized_pyramid(spark, sf):
    return maptiles.sized_pyramid(_metres(points(spark, sf)), 8, 5, "points", ["feature", "ct"], 500, 20_000).select("z", "x", "y", F.length("data").alias("bytes"))


@query(_ANCHORS + """, n AS (SELECT point_id, arg_min(layer, (d2, anchor_id)) AS factor FROM hit GROUP BY point_id),
s AS (SELECT CAST(floor(x / 5.0) AS BIGINT) AS u, CAST(floor(y / 5.0) AS BIGINT) AS v, factor, count(*) AS n FROM p JOIN n USING (point_id) GROUP BY ALL)
SELECT u, v, CAST(factor AS INTEGER) AS factor, n FROM s QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY n DESC, factor) = 1""")
def lowres_map(spark, sf):
    p = points(spark, sf)
    return maptiles.lowres_map(p, _anchors(p), 9.0, 5.0, ["sample_id"])
