"""Queries of the core's data-pipeline problems (1 and 2) and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.hotkeys import heavy_keys, key_profile
from pointloom.operators.proximity import near_pairs, points_in_rings
from pointloom.session import feature_name, materialize, once, small, table

RADIUS = 0.625


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, rings = table(spark, sf_dir, "points"), table(spark, sf_dir, "rings")
    near = near_pairs(points, RADIUS).select(F.lit("near").alias("kind"), F.col("a").alias("point_id"), F.col("b").cast("string").alias("other_id"))
    held = points_in_rings(points, rings).select(F.lit("inside").alias("kind"), F.col("id").alias("point_id"), F.col("region").alias("other_id"))
    return near.unionByName(held)


def _tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tile_points, once each, with the name their code stands for."""
    rows = once(table(spark, sf_dir, "tile_points").select("rec_id", "feature_code", "count_value", "recv_ts"), ["rec_id"])
    names = table(spark, sf_dir, "feature_dict").where("feature_code is not null and feature is not null")
    names = small(names.select("feature_code", feature_name("feature").alias("feature")))
    return materialize(rows.join(names, "feature_code").select("feature", "count_value"))


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "feature_stats").where("feature is not null").select("sample_id", feature_name("feature").alias("feature"), F.coalesce("total_count", F.lit(0)).alias("total_count"), "recv_ts")
    return materialize(once(s, ["sample_id", "feature"]).select("feature", "total_count"))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, total and quartiles of the counts of each feature, in either table."""
    out = []
    for field, rows, value in (("feature_code", _tile_features(spark, sf_dir), "count_value"), ("total_count", _archived(spark, sf_dir), "total_count")):
        p = key_profile(rows, "feature", value, (0.25, 0.5, 0.75, 0.95))
        out.append(p.select(F.lit(field).alias("field_name"), "feature", "n_rows", F.col("total").cast("long").alias("total"), "q25", "q50", "q75", "q95"))
    return out[0].unionByName(out[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = heavy_keys(_tile_features(spark, sf_dir), "feature", 40).select(F.lit("feature_code").alias("field_name"), "feature")
    b = heavy_keys(_archived(spark, sf_dir), "feature", 40, "total_count").select(F.lit("total_count").alias("field_name"), "feature")
    return a.unionByName(b)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_profile": p2_profile}

_TILE = """
t AS (SELECT rec_id, min(feature_code) AS feature_code, min(count_value) AS count_value FROM tile_points GROUP BY rec_id),
f AS (SELECT lower(trim(d.feature)) AS feature, t.count_value FROM t JOIN feature_dict d ON t.feature_code = d.feature_code),
s AS (SELECT sample_id, lower(trim(feature)) AS feature, min(coalesce(total_count, 0)) AS total_count
      FROM feature_stats WHERE feature IS NOT NULL GROUP BY ALL)
"""

SQL = {
    "p1_found": f"""
WITH p AS (SELECT DISTINCT point_id, sample_id, x, y FROM points
           WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND sample_id IS NOT NULL),
near AS (SELECT 'near' AS kind, a.point_id, CAST(b.point_id AS VARCHAR) AS other_id FROM p a JOIN p b
         ON a.sample_id = b.sample_id AND a.point_id < b.point_id
         AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {RADIUS} * {RADIUS}),
r AS (SELECT row_number() OVER () AS rid, polygon_id, sample_id, ring FROM rings
      WHERE polygon_id IS NOT NULL AND len(ring) >= 3),
v AS (SELECT rid, unnest(ring) AS a, unnest(list_concat(ring[2:], ring[1:1])) AS b FROM r),
e AS (SELECT rid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v),
bb AS (SELECT rid, min(x0) AS lx, max(x0) AS hx, min(y0) AS ly, max(y0) AS hy FROM e GROUP BY rid),
c AS (SELECT p.point_id, p.x, p.y, r.rid, r.polygon_id FROM p JOIN r ON p.sample_id = r.sample_id
      JOIN bb ON bb.rid = r.rid AND p.x BETWEEN lx AND hx AND p.y BETWEEN ly AND hy),
w AS (SELECT c.point_id, c.polygon_id, c.rid,
      sum(CASE WHEN y0 <= y AND y1 > y AND (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) > 0 THEN 1
               WHEN y0 > y AND y1 <= y AND (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) < 0 THEN -1 ELSE 0 END) AS turns,
      bool_or((x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) = 0 AND x BETWEEN least(x0, x1) AND greatest(x0, x1)
              AND y BETWEEN least(y0, y1) AND greatest(y0, y1)) AS edge
      FROM c JOIN e ON e.rid = c.rid GROUP BY ALL)
SELECT * FROM near UNION ALL SELECT DISTINCT 'inside', point_id, polygon_id FROM w WHERE turns <> 0 OR edge""",
    "p2_found": f"""WITH {_TILE}
SELECT 'feature_code' AS field_name, feature FROM f GROUP BY feature HAVING count(*) * 40 >= (SELECT count(*) FROM f)
UNION ALL
SELECT 'total_count', feature FROM s GROUP BY feature HAVING sum(total_count) * 40 >= (SELECT sum(total_count) FROM s)""",
    "p2_profile": f"""WITH {_TILE},
u AS (SELECT 'feature_code' AS field_name, feature, count_value AS v FROM f UNION ALL SELECT 'total_count', feature, total_count FROM s)
SELECT field_name, feature, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS total,
  CAST(quantile_disc(v, 0.25) AS DOUBLE) AS q25, CAST(quantile_disc(v, 0.5) AS DOUBLE) AS q50,
  CAST(quantile_disc(v, 0.75) AS DOUBLE) AS q75, CAST(quantile_disc(v, 0.95) AS DOUBLE) AS q95
FROM u GROUP BY ALL""",
}
