"""Queries of the engine's operators on the test tables, each with the SQL it is checked against.

Points are the records of ``points``, once each.  Annotations are made of them by
integer rules on their pixels, so that both engines make the same: a pixel with
``(px + py) mod 5 <> 0`` has the factors ``k1 = (7 px + 13 py) mod 8``,
``k1 + 3`` and ``k1 + 5`` (mod 8) with probabilities 1/2, 1/4 and 1/8.  Sums of
these are exact, in whatever order they are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import grid
from pointloom.operators import aggregates as A
from pointloom.operators import enrichment as E
from pointloom.operators import filters as X
from pointloom.operators import joins as J
from pointloom.operators import ranks as R
from pointloom.operators import tiles as T
from pointloom.session import feature_name, once, table

K, HEX, RES = 8, 12.0, 1.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "WITH RECURSIVE " + _P + sql[len("RECURSIVE") :] if sql.startswith("RECURSIVE") else "WITH " + _P + sql.strip()
        return f

    return add


_P = """p AS (SELECT point_id, min(sample_id) AS sample_id, min(x) AS x, min(y) AS y, min(CAST(z AS DOUBLE)) AS z, min(gene) AS feature,
  CAST(coalesce(min(ct), 1) AS BIGINT) AS ct, min(cell_id) AS cell_id FROM points
  WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND sample_id IS NOT NULL AND gene IS NOT NULL GROUP BY point_id)
"""
_ANNO = """, q0 AS (SELECT DISTINCT sample_id, CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS py FROM p),
q AS (SELECT *, ((px * 7 + py * 13) % 8 + 8) % 8 AS k1 FROM q0 WHERE (px + py) % 5 <> 0),
e AS (SELECT sample_id, px, py, k1 AS k, 0.5::DOUBLE AS p FROM q UNION ALL SELECT sample_id, px, py, (k1 + 3) % 8, 0.25::DOUBLE FROM q
      UNION ALL SELECT sample_id, px, py, (k1 + 5) % 8, 0.125::DOUBLE FROM q)
"""
_COARSE = """, c AS (SELECT DISTINCT sample_id, CAST(floor(px / 2.0) AS BIGINT) AS px, CAST(floor(py / 2.0) AS BIGINT) AS py FROM q0 WHERE px % 3 = 0),
cq AS (SELECT *, ((px * 5 + py * 3) % 8 + 8) % 8 AS k1 FROM c)
"""
_LIVE = """u0 AS (SELECT rec_id, min(unit_id) AS unit_id, min(sample_id) AS sample_id, min(lower(trim(feature))) AS feature, min(coalesce(ct, 0)) AS ct
  FROM unit_features WHERE feature IS NOT NULL GROUP BY rec_id),
u AS (SELECT unit_id, sample_id, feature, CAST(sum(ct) AS BIGINT) AS ct FROM u0 GROUP BY ALL HAVING sum(ct) > 0)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "points").where("x is not null and y is not null and not isnan(x) and not isnan(y) and sample_id is not null and gene is not null")
    t = once(t.select("point_id", "sample_id", "x", "y", F.col("z").cast("double").alias("z"), F.col("gene").alias("feature"), F.coalesce("ct", F.lit(1)).cast("long").alias("ct"), "cell_id", "recv_ts"), ["point_id"])
    return t.drop("recv_ts")


def annotation(p: DataFrame) -> DataFrame:
    q = p.select("sample_id", grid.pixel("x", RES).alias("px"), grid.pixel("y", RES).alias("py")).distinct().where("(px + py) % 5 <> 0")
    return q.withColumn("kp", _kp(F.pmod(F.col("px") * 7 + F.col("py") * 13, F.lit(K))))


def coarse(p: DataFrame) -> DataFrame:
    """Another annotation, with pixels twice as wide."""
    q = p.select("sample_id", grid.pixel("x", RES).alias("px"), grid.pixel("y", RES).alias("py")).where("px % 3 = 0")
    q = q.select("sample_id", F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py")).distinct()
    return q.withColumn("kp", F.array(F.struct(F.pmod(F.col("px") * 5 + F.col("py") * 3, F.lit(K)).cast("int").alias("k"), F.lit(0.5).alias("p"))))


def _kp(k1):
    return F.array(*[F.struct(((k1 + s) % K).cast("int").alias("k"), F.lit(p).alias("p")) for s, p in ((0, 0.5), (3, 0.25), (5, 0.125))])


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "unit_features").where("feature is not null")
    t = once(t.select("rec_id", "unit_id", "sample_id", feature_name("feature").alias("feature"), F.coalesce("ct", F.lit(0)).alias("ct"), "recv_ts"), ["rec_id"])
    return t.groupBy("unit_id", "sample_id", "feature").agg(F.sum("ct").alias("ct")).where("ct > 0")


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by sample number (as the factor) and feature."""
    u = units(spark, sf_dir).withColumn("factor", F.regexp_extract("sample_id", r"(\d+)$", 1).cast("int"))
    return u.groupBy("factor", "feature").agg(F.sum("ct").alias("n"))


_BULK = ", " + _LIVE + ", b AS (SELECT CAST(regexp_extract(sample_id, '(\\d+)$', 1) AS INTEGER) AS factor, feature, CAST(sum(ct) AS BIGINT) AS n FROM u GROUP BY ALL)\n"

# ---------------------------------------------------------------- tiles and side tables


@query("""SELECT sample_id, CAST(floor(y / 50.0) AS BIGINT) AS tile_row, CAST(floor(x / 50.0) AS BIGINT) AS tile_col, count(*) AS n,
  min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM p GROUP BY ALL""")
def tile_summary(spark, sf):
    return T.summary(points(spark, sf), 50.0, ["sample_id"])


@query("SELECT feature, CAST(sum(ct) AS BIGINT) AS ct FROM p GROUP BY feature")
def feature_totals(spark, sf):
    return T.feature_totals(points(spark, sf))


@query(""", z AS (SELECT CAST(floor(z) AS BIGINT) AS z_bin, count(*) AS n FROM p WHERE z IS NOT NULL AND NOT isnan(z) GROUP BY ALL),
r AS (SELECT unnest(generate_series((SELECT min(z_bin) FROM z), (SELECT max(z_bin) FROM z))) AS z_bin)
SELECT r.z_bin, coalesce(z.n, 0) AS n FROM r LEFT JOIN z USING (z_bin)""")
def z_histogram(spark, sf):
    return T.z_histogram(points(spark, sf))


@query("SELECT sample_id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM p GROUP BY sample_id")
def coordinate_range(spark, sf):
    return T.extent(points(spark, sf), ["sample_id"])


@query(""", m AS (SELECT CAST(floor(x * 4) AS BIGINT) AS gx, CAST(floor(y * 4) AS BIGINT) AS gy, CAST(sum(ct) AS BIGINT) AS n FROM p GROUP BY ALL),
l AS (SELECT 3 - s AS zoom, CAST(floor(gx / (2 ** s)) AS BIGINT) AS gx, CAST(floor(gy / (2 ** s)) AS BIGINT) AS gy, CAST(sum(n) AS BIGINT) AS n
      FROM m, (SELECT unnest([0, 1, 2, 3]) AS s) GROUP BY ALL),
t AS (SELECT zoom, quantile_cont(n, 0.99) AS q FROM l WHERE n > 0 GROUP BY zoom)
SELECT CAST(l.zoom AS INTEGER) AS zoom, gx, gy, n, round(least(1.0, n / q), 6) AS shade FROM l JOIN t USING (zoom)""")
def mono_raster(spark, sf):
    p = points(spark, sf).withColumns({"gx": F.floor(F.col("x") * 4), "gy": F.floor(F.col("y") * 4)})
    return T.mono_raster(p, 3, 0).select("zoom", "gx", "gy", "n", F.round("shade", 6).alias("shade"))


# ---------------------------------------------------------------- filters


@query("SELECT point_id FROM p WHERE (x >= 0 AND x < 40 AND y >= -20 AND y < 20) OR (x >= -50 AND x < -10 AND y >= 0 AND y < 60)")
def rectangles(spark, sf):
    t = T.assign(points(spark, sf), 50.0)
    return X.rectangles(t, [(0, 40, -20, 20), (-50, -10, 0, 60)], 50.0).select("point_id")


@query("SELECT point_id, z FROM p WHERE z >= 2.0 AND z < 5.5")
def z_range(spark, sf):
    return X.z_range(points(spark, sf), 2.0, 5.5).select("point_id", "z")


_INSIDE = """, r AS (SELECT row_number() OVER () AS rid, polygon_id, sample_id, ring FROM rings WHERE polygon_id IS NOT NULL AND len(ring) >= 3),
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
      FROM c JOIN e ON e.rid = c.rid GROUP BY ALL),
held AS (SELECT DISTINCT point_id, polygon_id FROM w WHERE turns <> 0 OR edge)
"""


@query(_INSIDE + "SELECT DISTINCT point_id FROM held")
def polygon_region(spark, sf):
    return X.in_polygons(points(spark, sf), table(spark, sf, "rings")).select("point_id")


@query(_INSIDE + """, g AS (SELECT polygon_id AS region, feature, CAST(sum(ct) AS BIGINT) AS ct FROM held JOIN p USING (point_id) GROUP BY ALL HAVING sum(ct) > 0)
SELECT * FROM g WHERE region IN (SELECT region FROM g GROUP BY region HAVING max(ct) >= 3)""")
def roi_counts(spark, sf):
    from pointloom.operators.proximity import points_in_rings

    p = points(spark, sf)
    return J.roi_counts(p, points_in_rings(p, table(spark, sf, "rings")), least=3)


@query("SELECT feature, count(*) AS n FROM p WHERE regexp_full_match(feature, '[A-M].*') AND NOT regexp_full_match(feature, '.*\\d') GROUP BY feature")
def feature_regex(spark, sf):
    return X.features(points(spark, sf), "[A-M].*", r".*\d").groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query(""", """ + _LIVE + """, f AS (SELECT feature FROM u GROUP BY feature HAVING sum(ct) >= 20), k AS (SELECT unit_id FROM u GROUP BY unit_id HAVING sum(ct) >= 15)
SELECT unit_id, feature, ct FROM u WHERE feature IN (FROM f) AND unit_id IN (FROM k)""")
def count_thresholds(spark, sf):
    u = units(spark, sf)
    kept = X.frequent_units(u, ["unit_id"], {"ct": 15})
    return kept.join(X.frequent_features(u, 20).select("feature").distinct(), "feature", "left_semi").select("unit_id", "feature", "ct")


@query(""", """ + _LIVE + """, w AS (SELECT lower(trim(feature)) AS feature, max(floor(info_weight * 1024) / 1024) AS weight FROM feature_stats WHERE info_weight IS NOT NULL AND info_weight >= 0 AND NOT isnan(info_weight) GROUP BY ALL)
SELECT unit_id, round(sum(ct * coalesce(weight, 1.0)), 4) AS total FROM u LEFT JOIN w USING (feature) GROUP BY unit_id""")
def feature_weighting(spark, sf):
    w = table(spark, sf, "feature_stats").where("info_weight is not null and not isnan(info_weight) and info_weight >= 0")
    w = w.groupBy(feature_name("feature").alias("feature")).agg(F.max(F.floor(F.col("info_weight") * 1024) / 1024).alias("weight"))
    return X.weighted(units(spark, sf), w).groupBy("unit_id").agg(F.round(F.sum("wct"), 4).alias("total"))


# ---------------------------------------------------------------- units

_HX, _HY = grid.hexagon_sql("x", "y", HEX)


@query(f""", h AS (SELECT sample_id, {_HX} AS hx, {_HY} AS hy, feature, ct FROM p),
g AS (SELECT sample_id, hx, hy, feature, CAST(sum(ct) AS BIGINT) AS ct FROM h GROUP BY ALL)
SELECT g.* FROM g JOIN (SELECT sample_id, hx, hy FROM g GROUP BY ALL HAVING sum(ct) >= 5) USING (sample_id, hx, hy)""")
def hex_units(spark, sf):
    return A.hex_units(points(spark, sf), HEX, ["sample_id"], least={"ct": 5})


@query(""", s AS (SELECT *, x / 10.0 AS a, y / 10.0 AS b, z / 10.0 AS c FROM p WHERE z IS NOT NULL AND NOT isnan(z)),
n AS (SELECT *, (a - round(a)) * (a - round(a)) + (b - round(b)) * (b - round(b)) + (c - round(c)) * (c - round(c)) AS d0,
  (a - (floor(a) + 0.5)) * (a - (floor(a) + 0.5)) + (b - (floor(b) + 0.5)) * (b - (floor(b) + 0.5)) + (c - (floor(c) + 0.5)) * (c - (floor(c) + 0.5)) AS d1 FROM s)
SELECT sample_id, CAST(CASE WHEN d0 <= d1 THEN round(a) * 2 ELSE (floor(a) + 0.5) * 2 END AS BIGINT) AS bx,
  CAST(CASE WHEN d0 <= d1 THEN round(b) * 2 ELSE (floor(b) + 0.5) * 2 END AS BIGINT) AS "by",
  CAST(CASE WHEN d0 <= d1 THEN round(c) * 2 ELSE (floor(c) + 0.5) * 2 END AS BIGINT) AS bz, feature, CAST(sum(ct) AS BIGINT) AS ct FROM n GROUP BY ALL""")
def bcc_units(spark, sf):
    return A.bcc_units(points(spark, sf).where("z is not null and not isnan(z)"), 10.0, ["sample_id"])


@query("SELECT sample_id, CAST(floor(x / 8.0) AS BIGINT) AS ux, CAST(floor(y / 8.0) AS BIGINT) AS uy, feature, CAST(sum(ct) AS BIGINT) AS ct FROM p GROUP BY ALL")
def square_units(spark, sf):
    return A.square_units(points(spark, sf), 8.0, ["sample_id"])


@query(f""", h AS (SELECT sample_id, {_HX} AS hx, {_HY} AS hy, feature, ct FROM p),
g AS (SELECT sample_id, hx, hy, feature, sum(ct) AS ct FROM h GROUP BY ALL)
SELECT sample_id, hx, hy, count(*) AS n_features, CAST(sum(ct) AS BIGINT) AS total,
  string_agg(feature || ':' || CAST(CAST(ct AS BIGINT) AS VARCHAR), ' ' ORDER BY feature) AS pairs FROM g WHERE ct > 0 GROUP BY ALL""")
def sparse_rows(spark, sf):
    r = A.sparse_rows(A.hex_units(points(spark, sf), HEX, ["sample_id"]), ["sample_id", "hx", "hy"])
    text = F.concat_ws(" ", F.transform("pairs", lambda e: F.concat(e["feature"], F.lit(":"), e["ct"].cast("string"))))
    return r.select("sample_id", "hx", "hy", "n_features", "total", text.alias("pairs"))


@query(f""", t AS (SELECT sum(ct) AS t FROM (SELECT sample_id, {_HX} AS hx, {_HY} AS hy, ct FROM p) GROUP BY sample_id, hx, hy)
SELECT CAST(floor(t / 5) * 5 AS BIGINT) AS bin, count(*) AS n_units FROM t GROUP BY ALL""")
def total_histogram(spark, sf):
    return A.total_histogram(A.hex_units(points(spark, sf), HEX, ["sample_id"]), ["sample_id", "hx", "hy"])


@query(", " + _LIVE + """, n AS (SELECT count(DISTINCT unit_id) AS n FROM u), t AS (SELECT feature, sum(ct) AS t FROM u GROUP BY feature)
SELECT feature, CAST(sum(ct) AS BIGINT) AS total_count, count(*) AS n_units_present, count(*) FILTER (ct > 1) AS n_units_count_gt1,
  count(*) FILTER (ct > 2) AS n_units_count_gt2, count(*) FILTER (ct * n > t) AS n_units_count_gt_mean FROM u JOIN t USING (feature), n GROUP BY feature""")
def feature_occurrence(spark, sf):
    u = _unit_totals(spark, sf)
    return A.occurrence(u, ["unit_id"], u.select("unit_id").distinct().count())


def _unit_totals(spark, sf):
    return units(spark, sf).groupBy("unit_id", "feature").agg(F.sum("ct").alias("ct"))


@query(", " + _LIVE + """, n AS (SELECT count(DISTINCT unit_id) AS n FROM u),
s AS (SELECT feature, sum(ct) AS t, count(*) AS df FROM u GROUP BY feature),
r AS (SELECT *, greatest(0, ln(n / (1.0 + df))) AS r, log2((SELECT sum(t) FROM s) / t) AS bits FROM s, n),
w AS (SELECT quantile_cont(r, 0.95) AS q, sum(t * bits) / sum(t) AS mean FROM r)
SELECT feature, round(0.1 + 0.9 * least(1, r / q) ** 0.3, 6) AS idf, round(least(5.0, bits / mean), 6) AS info_weight FROM r, w""")
def feature_weights(spark, sf):
    u = _unit_totals(spark, sf)
    n = u.select("unit_id").distinct().count()
    w = A.feature_weights(A.occurrence(u, ["unit_id"], n), n)
    return w.select("feature", F.round("idf", 6).alias("idf"), F.round("info_weight", 6).alias("info_weight"))


@query(", " + _LIVE + """, s AS (SELECT feature, sample_id, sum(ct) AS n FROM u GROUP BY ALL), k AS (SELECT count(DISTINCT sample_id) AS k FROM u)
SELECT feature, CAST(CASE WHEN count(*) < any_value(k) THEN 0 ELSE min(n) END AS BIGINT) AS least_total, CAST(sum(n) AS BIGINT) AS total
FROM s, k GROUP BY feature HAVING CASE WHEN count(*) < any_value(k) THEN 0 ELSE min(n) END >= 2""")
def shared_features(spark, sf):
    return J.shared_features(units(spark, sf), least=2)


@query(", " + _LIVE + """, l AS (SELECT unit_id, min(top_k) AS label FROM unit_factors WHERE top_k IS NOT NULL GROUP BY unit_id)
SELECT label, feature, CAST(sum(ct) AS BIGINT) AS ct FROM u JOIN l USING (unit_id) GROUP BY ALL""")
def pseudobulk(spark, sf):
    labels = table(spark, sf, "unit_factors").where("top_k is not null").groupBy("unit_id").agg(F.min("top_k").alias("label"))
    return J.pseudobulk(units(spark, sf), labels)


# ---------------------------------------------------------------- anchors

_ANCHORS = """, an AS (SELECT DISTINCT sample_id, CAST(floor(x / 25.0) AS BIGINT) AS ax, CAST(floor(y / 25.0) AS BIGINT) AS ay FROM p),
anc AS (SELECT sample_id, ax * 10000 + ay AS anchor_id, CAST(((ax + ay) % 2 + 2) % 2 AS INTEGER) AS layer, ax * 25.0 AS x, ay * 25.0 AS y FROM an),
hit AS (SELECT p.point_id, p.sample_id, anc.anchor_id, anc.layer, (p.x - anc.x) * (p.x - anc.x) + (p.y - anc.y) * (p.y - anc.y) AS d2
        FROM p JOIN anc ON p.sample_id = anc.sample_id AND p.x BETWEEN anc.x - 9 AND anc.x + 9 AND p.y BETWEEN anc.y - 9 AND anc.y + 9
        WHERE (p.x - anc.x) * (p.x - anc.x) + (p.y - anc.y) * (p.y - anc.y) < 81)
"""


def _anchors(p: DataFrame) -> DataFrame:
    a = p.select("sample_id", grid.pixel("x", 25).alias("ax"), grid.pixel("y", 25).alias("ay")).distinct()
    return a.select("sample_id", (F.col("ax") * 10000 + F.col("ay")).alias("anchor_id"), F.pmod(F.col("ax") + F.col("ay"), F.lit(2)).cast("int").alias("layer"), (F.col("ax") * 25.0).alias("x"), (F.col("ay") * 25.0).alias("y"))


@query(_ANCHORS + "SELECT point_id, sample_id, anchor_id, layer, round(sqrt(d2), 6) AS d, round(greatest(0.05, least(0.95, 1 - (sqrt(d2) / 9.0) ** (ln(0.5) / ln(0.4)))), 6) AS w FROM hit")
def anchor_graph(spark, sf):
    p = points(spark, sf)
    n = J.near_anchors(p, _anchors(p), 9.0, ["sample_id"])
    return n.select("point_id", "sample_id", "anchor_id", "layer", F.round("d", 6).alias("d"), F.round(grid.decay("d", 9.0, 0.4), 6).alias("w"))


@query(_ANCHORS + f""", l AS (SELECT p.*, coalesce(h.layer, 2) AS layer FROM p LEFT JOIN (SELECT DISTINCT point_id, layer FROM hit) h USING (point_id))
SELECT sample_id, CAST(layer AS INTEGER) AS layer, {_HX} AS hx, {_HY} AS hy, feature, CAST(sum(ct) AS BIGINT) AS ct FROM l GROUP BY ALL""")
def layered_units(spark, sf):
    p = points(spark, sf)
    return A.layered_units(J.anchor_layers(p, _anchors(p), 9.0, 2, ["sample_id"]), HEX, ["sample_id"])


@query(_ANCHORS + "SELECT point_id, arg_min(anchor_id, (d2, anchor_id)) AS anchor_id, round(sqrt(min(d2)), 6) AS d FROM hit GROUP BY point_id")
def nearest_anchor(spark, sf):
    p = points(spark, sf)
    return J.nearest_anchor(p, _anchors(p), 9.0, ["sample_id"]).select("point_id", "anchor_id", F.round("d", 6).alias("d"))


# ---------------------------------------------------------------- annotation and merge

_K = "coalesce(k1, -1) AS k1, coalesce((k1 + 3) % 8, -1) AS k2, coalesce((k1 + 5) % 8, -1) AS k3"
_PIX = "CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS py"


def _flat(df: DataFrame, *cols) -> DataFrame:
    return df.select(*cols, *[_factor("kp", i).alias(f"k{i + 1}") for i in range(3)])


def _factor(kp: str, i: int):
    """Factor i of the pairs, -1 where there is none, as files have it."""
    return F.coalesce(F.get(kp, F.lit(i))["k"], F.lit(-1)).cast("long")


@query(_ANNO + f"SELECT point_id, px, py, {_K} FROM (SELECT *, {_PIX} FROM p) JOIN q USING (sample_id, px, py)")
def annotate(spark, sf):
    p = points(spark, sf)
    return _flat(J.annotate(p, annotation(p), RES, ["sample_id"]), "point_id", "px", "py")


@query(_ANNO + f"SELECT point_id, px, py, {_K} FROM (SELECT *, {_PIX} FROM p) LEFT JOIN q USING (sample_id, px, py)")
def annotate_keep_all(spark, sf):
    p = points(spark, sf)
    return _flat(J.annotate(p, annotation(p), RES, ["sample_id"], keep_all=True), "point_id", "px", "py")


@query(_ANNO + f""", f AS (SELECT DISTINCT q.*, p.feature FROM q JOIN (SELECT *, {_PIX} FROM p) p USING (sample_id, px, py) WHERE p.feature < 'N')
SELECT point_id, px, py, feature, {_K} FROM (SELECT *, {_PIX} FROM p) JOIN f USING (sample_id, px, py, feature)""")
def annotate_molecules(spark, sf):
    p = points(spark, sf)
    pix = p.where("feature < 'N'").select("sample_id", grid.pixel("x", RES).alias("px"), grid.pixel("y", RES).alias("py"), "feature").distinct()
    anno = annotation(p).join(pix, ["sample_id", "px", "py"])
    return _flat(J.annotate(p, anno, RES, ["sample_id"], feature=True), "point_id", "px", "py", "feature")


@query(_ANNO + f""", d AS (SELECT DISTINCT sample_id, px, py, CAST(floor(z / 2.0) AS BIGINT) AS pz, k1 FROM (SELECT *, {_PIX} FROM p) JOIN q USING (sample_id, px, py) WHERE z < 6 AND NOT isnan(z))
SELECT point_id, px, py, pz, {_K} FROM (SELECT *, {_PIX}, CAST(floor(z / 2.0) AS BIGINT) AS pz FROM p WHERE NOT isnan(z)) JOIN d USING (sample_id, px, py, pz)""")
def annotate_3d(spark, sf):
    p = points(spark, sf).where("not isnan(z)")
    deep = p.where("z < 6").select("sample_id", grid.pixel("x", RES).alias("px"), grid.pixel("y", RES).alias("py"), grid.pixel("z", 2.0).alias("pz")).distinct()
    anno = annotation(points(spark, sf)).join(deep, ["sample_id", "px", "py"])
    return _flat(J.annotate(p, anno, RES, ["sample_id"], z_res=2.0), "point_id", "px", "py", "pz")


def _merged(spark, sf, keep):
    p = points(spark, sf)
    m = J.merge(annotation(p), [(coarse(p), 2)], ["sample_id"], keep, [2, 1], ["a", "b"])
    return m.select("sample_id", "px", "py", _factor("kp_a", 0).alias("a1"), _factor("kp_a", 1).alias("a2"), _factor("kp_b", 0).alias("b1"))


_MERGED = "coalesce(q.k1, -1) AS a1, coalesce((q.k1 + 3) % 8, -1) AS a2, coalesce(cq.k1, -1) AS b1"
_ON = "ON cq.sample_id = q.sample_id AND cq.px = CAST(floor(q.px / 2.0) AS BIGINT) AND cq.py = CAST(floor(q.py / 2.0) AS BIGINT)"


@query(_ANNO + _COARSE + f"SELECT q.sample_id, q.px, q.py, {_MERGED} FROM q JOIN cq {_ON}")
def merge_inner(spark, sf):
    return _merged(spark, sf, "inner")


@query(_ANNO + _COARSE + f"SELECT q.sample_id, q.px, q.py, {_MERGED} FROM q LEFT JOIN cq {_ON}")
def merge_keep_main(spark, sf):
    return _merged(spark, sf, "main")


@query(_ANNO + _COARSE + """, l AS (SELECT sample_id, px, py FROM q UNION SELECT sample_id, px * 2, py * 2 FROM cq)
SELECT l.sample_id, l.px, l.py, coalesce(q.k1, -1) AS a1, coalesce((q.k1 + 3) % 8, -1) AS a2, coalesce(cq.k1, -1) AS b1 FROM l LEFT JOIN q USING (sample_id, px, py)
LEFT JOIN cq ON cq.sample_id = l.sample_id AND cq.px = CAST(floor(l.px / 2.0) AS BIGINT) AND cq.py = CAST(floor(l.py / 2.0) AS BIGINT)""")
def merge_keep_all(spark, sf):
    return _merged(spark, sf, "all")


@query(_ANNO + _COARSE + f""", m AS (SELECT q.sample_id, q.px, q.py, q.k1 AS a1, cq.k1 AS b1 FROM q JOIN cq {_ON})
SELECT point_id, a1, b1 FROM (SELECT *, {_PIX} FROM p) JOIN m USING (sample_id, px, py)""")
def merge_annotate(spark, sf):
    p = points(spark, sf)
    m = J.annotate_merged(p, annotation(p), [(coarse(p), 2)], RES, ["sample_id"])
    return m.select("point_id", _factor("kp_0", 0).alias("a1"), _factor("kp_1", 0).alias("b1"))


# ---------------------------------------------------------------- factor sums

_AP = f", ap AS (SELECT p.*, q.k1, q.px, q.py FROM (SELECT *, {_PIX} FROM p) p JOIN q USING (sample_id, px, py)), ae AS (SELECT ap.*, k, e.p AS pr FROM ap JOIN e USING (sample_id, px, py))\n"


def _annotated(spark, sf):
    p = points(spark, sf)
    return J.annotate(p, annotation(p), RES, ["sample_id"])


@query(_ANNO + _AP + """, c AS (SELECT cell_id, 'ALL' AS comp, k, pr, point_id FROM ae WHERE cell_id IS NOT NULL UNION ALL SELECT cell_id, sample_id, k, pr, point_id FROM ae WHERE cell_id IS NOT NULL),
n AS (SELECT cell_id, comp, count(DISTINCT point_id) AS n_query FROM c GROUP BY ALL), s AS (SELECT cell_id, comp, k, sum(pr) AS mass FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell_id, comp ORDER BY mass DESC, k) AS rank FROM s)
SELECT cell_id, comp, CAST(k AS BIGINT) AS k, mass, rank, n_query FROM r JOIN n USING (cell_id, comp) WHERE rank <= 3""")
def cell_factors(spark, sf):
    a = _annotated(spark, sf).where("cell_id is not null")
    return A.cell_factors(a, ["cell_id"], 3, "sample_id").select("cell_id", "comp", F.col("k").cast("long").alias("k"), "mass", F.col("rank").cast("long").alias("rank"), "n_query")


@query(_ANNO + _AP + "SELECT sample_id, CAST(k AS BIGINT) AS k, sum(pr) AS mass FROM ae GROUP BY ALL")
def compartment_bulk(spark, sf):
    return A.compartment_bulk(_annotated(spark, sf), "sample_id").withColumn("k", F.col("k").cast("long"))


@query(_ANNO + "SELECT CAST(k AS BIGINT) AS k, sum(p) AS mass FROM e GROUP BY k")
def factor_marginal(spark, sf):
    return A.marginal(annotation(points(spark, sf))).withColumn("k", F.col("k").cast("long"))


@query(_ANNO + """, o AS (SELECT sample_id, px, py, k, p, row_number() OVER (PARTITION BY sample_id, px, py ORDER BY p DESC) AS i FROM e)
SELECT CAST(least(a.k, b.k) AS BIGINT) AS k1, CAST(greatest(a.k, b.k) AS BIGINT) AS k2, sum(a.p * b.p) AS mass FROM o a JOIN o b USING (sample_id, px, py) WHERE a.i <= b.i GROUP BY ALL""")
def factor_joint(spark, sf):
    return A.joint(annotation(points(spark, sf))).select(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), "mass")


@query(_ANNO + _COARSE + f""", m AS (SELECT e.k AS k1, cq.k1 AS k2, sum(e.p * 0.5) AS mass FROM q JOIN cq {_ON} JOIN e ON e.sample_id = q.sample_id AND e.px = q.px AND e.py = q.py GROUP BY ALL),
t AS (SELECT *, sum(mass) OVER (PARTITION BY k1) AS r, sum(mass) OVER (PARTITION BY k2) AS c, sum(mass) OVER () AS n, 0.5 * least(0.5, min(mass) OVER ()) AS s FROM m),
x AS (SELECT k1, k2, mass, mass + s AS a, greatest(0, r - mass) + s AS b, greatest(0, c - mass) + s AS c, greatest(0, n - r - c + mass) + s AS d FROM t)
SELECT CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, mass, round(log2(a * d / (b * c)), 6) AS log2_or,
  round((a * d - b * c) * (a * d - b * c) * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d)), 4) AS chisq FROM x""")
def factor_cross(spark, sf):
    p = points(spark, sf)
    m = J.merge(annotation(p), [(coarse(p), 2)], ["sample_id"], "inner", None, ["a", "b"])
    c = A.cross(m, "kp_a", "kp_b")
    return c.select(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), "mass", F.round("log2_or", 6).alias("log2_or"), F.round("chisq", 4).alias("chisq"))


@query(_ANNO + "SELECT CAST(a.k AS BIGINT) AS k1, CAST(b.k AS BIGINT) AS k2, sum(a.p * b.p) AS mass FROM e a JOIN e b USING (sample_id, px, py) GROUP BY ALL")
def confusion(spark, sf):
    return A.confusion(annotation(points(spark, sf))).select(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), "mass")


@query(_ANNO + """, s AS (SELECT sample_id, CAST(floor(px / 4.0) AS BIGINT) AS sx, CAST(floor(py / 4.0) AS BIGINT) AS sy, k, sum(p) AS m FROM e GROUP BY ALL),
w AS (SELECT sample_id, sx, sy, sum(m) AS w FROM s GROUP BY ALL)
SELECT CAST(a.k AS BIGINT) AS k1, CAST(b.k AS BIGINT) AS k2, round(sum(a.m * b.m / w), 6) AS mass FROM s a JOIN s b USING (sample_id, sx, sy) JOIN w USING (sample_id, sx, sy) GROUP BY ALL""")
def confusion_squares(spark, sf):
    return A.confusion(annotation(points(spark, sf)), 4, ["sample_id"]).select(F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"), F.round("mass", 6).alias("mass"))


@query(_ANNO + _AP + """SELECT sample_id, CAST(k AS BIGINT) AS k, CAST(floor(x / 20.0) AS BIGINT) AS ux, CAST(floor(y / 20.0) AS BIGINT) AS uy, feature, sum(ct * pr) AS mass
FROM ae WHERE pr >= 0.25 GROUP BY ALL""")
def soft_units(spark, sf):
    return A.soft_units(_annotated(spark, sf), 20.0, 0.25, ["sample_id"]).withColumn("k", F.col("k").cast("long"))


@query(_ANNO + """, s AS (SELECT sample_id, CAST(floor(px / 3.0) AS BIGINT) AS px, CAST(floor(py / 3.0) AS BIGINT) AS py, k, sum(p) AS p FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, px, py ORDER BY p DESC, k) AS i FROM s)
SELECT sample_id, px, py, CAST(i AS BIGINT) AS i, CAST(k AS BIGINT) AS k, p FROM r WHERE i <= 2""")
def resample(spark, sf):
    r = A.resampled(annotation(points(spark, sf)), 3, 2, ["sample_id"]).select("sample_id", "px", "py", F.posexplode("kp").alias("i", "e"))
    return r.select("sample_id", "px", "py", (F.col("i") + 1).cast("long").alias("i"), F.col("e.k").cast("long").alias("k"), F.col("e.p").alias("p"))


@query("SELECT a.feature AS f1, b.feature AS f2, CAST(count(*) AS DOUBLE) AS weight FROM p a JOIN p b ON a.sample_id = b.sample_id AND a.x BETWEEN b.x - 3 AND b.x + 3 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 GROUP BY ALL")
def cooccurrence(spark, sf):
    return A.cooccurrence(points(spark, sf), 3.0, ["sample_id"])


@query(""", n AS (SELECT a.point_id, a.feature AS f1, b.feature AS f2, least(255, a.ct) * least(255, b.ct) * exp(-ln(2) / 4.0 * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS w
  FROM p a JOIN p b ON a.sample_id = b.sample_id AND floor(a.x / 50) = floor(b.x / 50) AND floor(a.y / 50) = floor(b.y / 50) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9),
k AS (SELECT point_id FROM n GROUP BY point_id HAVING count(*) >= 2)
SELECT f1, f2, round(sum(w), 4) AS weight FROM n WHERE point_id IN (FROM k) GROUP BY ALL""")
def cooccurrence_tiles(spark, sf):
    c = A.cooccurrence(points(spark, sf), 3.0, ["sample_id"], half=2.0, tile=50.0, least_neighbours=2, by_count=True)
    return c.select("f1", "f2", F.round("weight", 4).alias("weight"))


@query("""SELECT f1, f2, sum(weight) AS weight FROM (
  SELECT a.feature AS f1, b.feature AS f2, CAST(count(*) AS DOUBLE) AS weight FROM p a JOIN p b ON a.sample_id = b.sample_id AND abs(a.x - b.x) < 2 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 4 GROUP BY ALL
  UNION ALL SELECT a.feature, b.feature, CAST(count(*) AS DOUBLE) FROM p a JOIN p b ON a.sample_id = b.sample_id AND abs(a.x - b.x) < 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 1 GROUP BY ALL) GROUP BY ALL""")
def merge_matrices(spark, sf):
    p = points(spark, sf)
    parts = [A.cooccurrence(p, r, ["sample_id"]) for r in (2.0, 1.0)]
    return J.add_matrices(parts, "f1", "f2", "weight")


@query(", m AS (SELECT a.feature AS f1, b.feature AS f2, count(*) AS v FROM p a JOIN p b ON a.sample_id = b.sample_id AND abs(a.x - b.x) < 3 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 9 WHERE a.feature <> b.feature GROUP BY ALL),"
       """r AS (SELECT *, row_number() OVER (PARTITION BY f1 ORDER BY v DESC, f2) AS r FROM m), b AS (SELECT x.f1, x.f2, x.v, greatest(x.r, y.r) AS score FROM r x JOIN r y ON x.f1 = y.f2 AND x.f2 = y.f1 WHERE x.r <= 30 AND y.r <= 30),
s AS (SELECT *, row_number() OVER (PARTITION BY f1 ORDER BY score, v DESC, f2) AS rank FROM b)
SELECT f1, f2, score, rank FROM s WHERE rank <= 5""")
def mutual_neighbours(spark, sf):
    m = R.mutual_neighbours(A.cooccurrence(points(spark, sf), 3.0, ["sample_id"]), 30, 5)
    return m.select("f1", "f2", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(""", t AS (SELECT point_id, CAST(floor(x / 16) AS BIGINT) AS tx, CAST(floor(y / 16) AS BIGINT) AS ty, (point_id * 7919) % 10007 * 1000000 + point_id AS pr FROM p),
z3 AS (SELECT *, 3 AS zoom FROM t QUALIFY row_number() OVER (PARTITION BY tx, ty ORDER BY pr) <= 6),
z2 AS (SELECT point_id, tx >> 1 AS tx, ty >> 1 AS ty, pr, 2 AS zoom FROM z3 QUALIFY row_number() OVER (PARTITION BY tx >> 1, ty >> 1 ORDER BY pr) <= 6),
z1 AS (SELECT point_id, tx >> 1 AS tx, ty >> 1 AS ty, pr, 1 AS zoom FROM z2 QUALIFY row_number() OVER (PARTITION BY tx >> 1, ty >> 1 ORDER BY pr) <= 6)
SELECT point_id, tx, ty, zoom FROM (FROM z3 UNION ALL FROM z2 UNION ALL FROM z1)""")
def pyramid(spark, sf):
    p = points(spark, sf).select("point_id", F.floor(F.col("x") / 16).alias("tx"), F.floor(F.col("y") / 16).alias("ty"))
    return R.pyramid(p, 3, 1, 6, (F.col("point_id") * 7919) % 10007 * 1000000 + F.col("point_id")).select("point_id", "tx", "ty", "zoom")


@query(""", g AS (SELECT *, greatest(0, least(262143, CAST(floor((x * 1000 + 20037508.342789244) / 40075016.685578488 * 262144.0) AS BIGINT))) AS gx,
  greatest(0, least(262143, CAST(floor((20037508.342789244 - y * 1000) / 40075016.685578488 * 262144.0) AS BIGINT))) AS gy FROM p)
SELECT gx >> 8 AS tx, gy >> 8 AS ty, count(*) AS n FROM g GROUP BY ALL""")
def mercator_tiles(spark, sf):
    m = grid.mercator(F.col("x") * 1000, F.col("y") * 1000, 10)
    return points(spark, sf).withColumns(m).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- enrichment

_TEST = "(a * d - b * c) * (a * d - b * c) * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d))"


@query(_BULK + f""", m AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS r, sum(n) OVER (PARTITION BY factor) AS k, sum(n) OVER () AS t FROM b),
x AS (SELECT factor, feature, r, n + 0.5::DOUBLE AS a, k - n + 0.5::DOUBLE AS b, r - n + 0.5::DOUBLE AS c, t - k - r + n + 0.5::DOUBLE AS d FROM m WHERE r > 10)
SELECT factor, feature, CAST(r AS BIGINT) AS gene_total, round(a * d / (b * c), 6) AS fold_change, round({_TEST}, 4) AS chisq FROM x WHERE a * d / (b * c) >= 1.5""")
def chisq_rest(spark, sf):
    t = E.one_vs_rest(bulk(spark, sf), min_log10p=0.0)
    return t.select("factor", "feature", "gene_total", F.round("fold_change", 6).alias("fold_change"), F.round("chisq", 4).alias("chisq"))


@query(_BULK + f""", l AS (SELECT factor, sqrt(sum(n * n)) AS l, sum(n) AS k FROM b GROUP BY factor),
co AS (SELECT x.factor, y.factor AS other, sum(x.n * y.n / (lx.l * ly.l)) AS c FROM b x JOIN b y ON x.feature = y.feature AND x.factor <> y.factor JOIN l lx ON lx.factor = x.factor JOIN l ly ON ly.factor = y.factor GROUP BY ALL),
ne AS (SELECT factor, other FROM co QUALIFY row_number() OVER (PARTITION BY factor ORDER BY c DESC, other) <= 3),
bk AS (SELECT ne.factor, b.feature, sum(b.n) AS c FROM ne JOIN b ON b.factor = ne.other GROUP BY ALL), bc AS (SELECT ne.factor, sum(l.k) AS k FROM ne JOIN l ON l.factor = ne.other GROUP BY ALL),
m AS (SELECT b.*, sum(n) OVER (PARTITION BY feature) AS r FROM b),
x AS (SELECT m.factor, m.feature, n + 0.5::DOUBLE AS a, l.k - n + 0.5::DOUBLE AS b, coalesce(bk.c, 0) + 0.5::DOUBLE AS c, bc.k - coalesce(bk.c, 0) + 0.5::DOUBLE AS d
      FROM m JOIN l USING (factor) JOIN bc ON bc.factor = m.factor LEFT JOIN bk ON bk.factor = m.factor AND bk.feature = m.feature WHERE r > 10)
SELECT factor, feature, round(a * d / (b * c), 6) AS fold_change, round({_TEST}, 4) AS chisq FROM x WHERE a * d / (b * c) >= 1.5""")
def chisq_neighbours(spark, sf):
    t = E.one_vs_neighbours(bulk(spark, sf), 3, min_log10p=0.0)
    return t.select("factor", "feature", F.round("fold_change", 6).alias("fold_change"), F.round("chisq", 4).alias("chisq"))


def _halves(spark, sf):
    u = units(spark, sf).withColumn("factor", F.regexp_extract("sample_id", r"(\d+)$", 1).cast("int"))
    u = u.withColumn("half", F.when(F.substring("unit_id", -1, 1) < "8", 0).otherwise(1))
    return [u.where(F.col("half") == i).groupBy("factor", "feature").agg(F.sum("ct").alias("n")) for i in (0, 1)]


@query(_BULK + f""", h AS (SELECT CAST(regexp_extract(sample_id, '(\\d+)$', 1) AS INTEGER) AS factor, feature, sum(CASE WHEN right(unit_id, 1) < '8' THEN ct END) AS a, sum(CASE WHEN right(unit_id, 1) >= '8' THEN ct END) AS c FROM u GROUP BY ALL),
m AS (SELECT *, sum(a) OVER (PARTITION BY factor) AS ka, sum(c) OVER (PARTITION BY factor) AS kc FROM h),
x AS (SELECT factor, feature, m.a AS n1, m.c AS n2, m.a + 0.5::DOUBLE AS a, ka - m.a + 0.5::DOUBLE AS b, m.c + 0.5::DOUBLE AS c, kc - m.c + 0.5::DOUBLE AS d FROM m WHERE m.a IS NOT NULL AND m.c IS NOT NULL AND m.a + m.c >= 10)
SELECT factor, feature, CAST(n1 AS BIGINT) AS n_one, CAST(n2 AS BIGINT) AS n_two, round((a / (a + b)) / (c / (c + d)), 6) AS fold_change, round({_TEST}, 4) AS chisq
FROM x WHERE (a / (a + b)) / (c / (c + d)) >= 1.5 OR (a / (a + b)) / (c / (c + d)) <= 1 / 1.5""")
def chisq_pairwise(spark, sf):
    t = E.pairwise(*_halves(spark, sf), min_log10p=0.0)
    return t.select("factor", "feature", "n_one", "n_two", F.round("fold_change", 6).alias("fold_change"), F.round("chisq", 4).alias("chisq"))


def _factor_masses(spark, sf):
    t = annotation(points(spark, sf)).select(F.pmod("px", F.lit(2)).cast("int").alias("group"), F.explode("kp").alias("e"))
    return t.groupBy("group", F.col("e.k").alias("factor")).agg(F.sum("e.p").alias("mass"))


@query(_ANNO + f""", s AS (SELECT k, sum(CASE WHEN (px % 2 + 2) % 2 = 0 THEN p ELSE 0 END) AS m0, sum(CASE WHEN (px % 2 + 2) % 2 = 1 THEN p ELSE 0 END) AS m1 FROM e GROUP BY k),
x AS (SELECT k, m0, m1, m1 + 0.5 AS a, sum(m1) OVER () - m1 + 0.5 AS b, m0 + 0.5 AS c, sum(m0) OVER () - m0 + 0.5 AS d FROM s)
SELECT CAST(k AS BIGINT) AS factor, m0, m1, round(log2(a * d / (b * c)), 6) AS log2_or, round({_TEST}, 6) AS chisq FROM x""")
def abundance(spark, sf):
    t = E.abundance(_factor_masses(spark, sf))
    return t.select(F.col("factor").cast("long").alias("factor"), "m0", "m1", F.round("log2_or", 6).alias("log2_or"), F.round("chisq", 6).alias("chisq"))


def _design(spark, sf):
    u = units(spark, sf)
    f = table(spark, sf, "unit_factors").where("top_k is not null").groupBy("unit_id").agg(F.min("top_k").alias("factor"))
    return u.join(f, "unit_id").select("factor", F.col("unit_id").alias("unit"), F.when(F.substring("unit_id", -1, 1) < "8", 0).otherwise(1).alias("group"), "feature", F.col("ct").alias("y"))


@query(", " + _LIVE + """, l AS (SELECT unit_id, min(top_k) AS factor FROM unit_factors WHERE top_k IS NOT NULL GROUP BY unit_id),
d AS (SELECT factor, unit_id, CASE WHEN right(unit_id, 1) < '8' THEN 0 ELSE 1 END AS g, feature, sum(ct) AS y FROM u JOIN l USING (unit_id) GROUP BY ALL),
t AS (SELECT factor, unit_id, g, sum(y) AS n FROM d GROUP BY ALL HAVING sum(y) >= 5),
s AS (SELECT factor, sum(CASE WHEN g = 0 THEN n ELSE 0 END) AS N0, sum(CASE WHEN g = 1 THEN n ELSE 0 END) AS N1, sum(CASE WHEN g = 0 THEN n * n ELSE 0 END) AS C0, sum(CASE WHEN g = 1 THEN n * n ELSE 0 END) AS C1, count(*) AS m FROM t GROUP BY factor HAVING N0 > 0 AND N1 > 0 AND m > 2),
f AS (SELECT factor, feature, sum(CASE WHEN g = 0 THEN y ELSE 0 END) AS Y0, sum(CASE WHEN g = 1 THEN y ELSE 0 END) AS Y1, sum(CASE WHEN g = 0 THEN y * y ELSE 0 END) AS A0, sum(CASE WHEN g = 1 THEN y * y ELSE 0 END) AS A1,
      sum(CASE WHEN g = 0 THEN y * n ELSE 0 END) AS B0, sum(CASE WHEN g = 1 THEN y * n ELSE 0 END) AS B1 FROM d JOIN t USING (factor, unit_id, g) GROUP BY ALL),
x AS (SELECT *, greatest((Y0 + Y1) / (N0 + N1) * 0.001, least(1 - 1e-8, Y0 / N0)) AS p0, greatest((Y0 + Y1) / (N0 + N1) * 0.001, least(1 - 1e-8, Y1 / N1)) AS p1 FROM f JOIN s USING (factor)),
v AS (SELECT *, (A0 - 2 * p0 * B0 + p0 * p0 * C0) / ((N0 * p0 * (1 - p0)) ** 2) + (A1 - 2 * p1 * B1 + p1 * p1 * C1) / ((N1 * p1 * (1 - p1)) ** 2) AS v FROM x)
SELECT factor, feature, round(p0, 5) AS pi0, round(p1, 5) AS pi1, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) AS beta, round(sqrt(v * m / (m - 2)), 4) AS se FROM v""")
def binomial_sandwich(spark, sf):
    t = E.binomial_sandwich(_design(spark, sf), min_unit=5)
    return t.select("factor", "feature", F.round("pi0", 5).alias("pi0"), F.round("pi1", 5).alias("pi1"), F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"))


@query()
def permutation_test(spark, sf):
    return E.permutation_p(_design(spark, sf), 50, 7)


@query()
def variable_features(spark, sf):
    u = _unit_totals(spark, sf)
    return E.variable_features(u, u.select("unit_id").distinct().count())


@query()
def deconvolution(spark, sf):
    p = points(spark, sf)
    anno = annotation(p)
    b = J.annotate(p, anno, RES, ["sample_id"]).select("feature", "ct", F.explode("kp").alias("e")).groupBy(F.col("e.k").alias("factor"), "feature").agg(F.sum(F.col("ct") * F.col("e.p")).alias("n"))
    return E.deconvolve(b, A.confusion(anno))


@query()
def gene_bins(spark, sf):
    counts = [(r[0], r[1]) for r in T.feature_totals(points(spark, sf)).collect()]  # the table of features
    fixed = [(*r, "fixed") for r in R.fixed_bins(counts, 8)]
    return spark.createDataFrame(fixed + [(*r, "adaptive") for r in R.adaptive_bins(counts, max(1, sum(c for _, c in counts) // 8))], "feature string, ct long, bin int, mode string")


