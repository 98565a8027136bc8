"""Further queries of the engine's operators: molecules, contrasts, masks, regions, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.models import kmeans
from pointloom.operators import enrichment as E
from pointloom.operators import filters as X
from pointloom.operators import hotkeys as H
from pointloom.operators import joins as J
from pointloom.operators import raster as G
from pointloom.operators import ranks as R
from pointloom.operators import tiles as T
from pointloom.plans.reference import _ANNO, _BULK, _LIVE, K, RES, _factor, _kp, annotation, bulk, points, query, units
from pointloom.session import once, table

_MOLECULES = """, m0 AS (SELECT DISTINCT sample_id, CAST(floor(x) AS BIGINT) AS px, CAST(floor(y) AS BIGINT) AS py, lower(trim(feature)) AS feature FROM p),
ma AS (SELECT *, ((px * 7 + py * 13) % 8 + 8) % 8 AS k1 FROM m0 WHERE (px + py) % 5 <> 0),
mb AS (SELECT DISTINCT sample_id, CAST(floor(px / 2.0) AS BIGINT) AS px, CAST(floor(py / 2.0) AS BIGINT) AS py, feature FROM m0 WHERE px % 3 = 0)
"""


def _molecules(spark, sf):
    """Two annotations of single molecules, the second with pixels twice as wide and a dictionary written otherwise."""
    m = points(spark, sf).select("sample_id", F.floor("x").alias("px"), F.floor("y").alias("py"), "feature").distinct()
    one = m.where("(px + py) % 5 <> 0").withColumn("kp", _kp(F.pmod(F.col("px") * 7 + F.col("py") * 13, F.lit(K))))
    two = m.where("px % 3 = 0").select("sample_id", F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py"), F.concat(F.lit(" "), F.upper("feature")).alias("feature")).distinct()
    return one, two.withColumn("kp", F.array(F.struct(F.pmod(F.col("px") * 5 + F.col("py") * 3, F.lit(K)).cast("int").alias("k"), F.lit(0.5).alias("p"))))


def _merged_molecules(spark, sf, keep):
    one, two = _molecules(spark, sf)
    m = J.merge(one, [(two, 2)], ["sample_id"], keep, [1, 1], ["a", "b"], feature=True)
    return m.select("sample_id", "px", "py", "feature", _factor("kp_a", 0).alias("a1"), _factor("kp_b", 0).alias("b1"))


_B1 = "((mb.px * 5 + mb.py * 3) % 8 + 8) % 8"
_MON = "ON mb.sample_id = ma.sample_id AND mb.feature = ma.feature AND mb.px = CAST(floor(ma.px / 2.0) AS BIGINT) AND mb.py = CAST(floor(ma.py / 2.0) AS BIGINT)"


@query(_MOLECULES + f"SELECT ma.sample_id, ma.px, ma.py, ma.feature, ma.k1 AS a1, {_B1} AS b1 FROM ma JOIN mb {_MON}")
def merge_molecules(spark, sf):
    return _merged_molecules(spark, sf, "inner")


@query(_MOLECULES + f"""SELECT l.sample_id, l.px, l.py, l.feature, coalesce(ma.k1, -1) AS a1, coalesce({_B1}, -1) AS b1
FROM (SELECT sample_id, px, py, feature FROM ma UNION SELECT sample_id, px * 2, py * 2, feature FROM mb) l LEFT JOIN ma USING (sample_id, px, py, feature)
LEFT JOIN mb ON mb.sample_id = l.sample_id AND mb.feature = l.feature AND mb.px = CAST(floor(l.px / 2.0) AS BIGINT) AND mb.py = CAST(floor(l.py / 2.0) AS BIGINT)""")
def merge_molecules_keep_all(spark, sf):
    return _merged_molecules(spark, sf, "all")


@query(_MOLECULES + f"SELECT point_id, ma.k1 AS a1, {_B1} AS b1 FROM p JOIN ma ON ma.sample_id = p.sample_id AND ma.px = floor(p.x) AND ma.py = floor(p.y) AND ma.feature = lower(trim(p.feature)) JOIN mb {_MON}")
def annotate_merged_molecules(spark, sf):
    one, two = _molecules(spark, sf)
    m = J.merge(one, [(two, 2)], ["sample_id"], "inner", names=["a", "b"], feature=True)
    p = points(spark, sf).withColumn("feature", F.lower(F.trim("feature")))
    out = J.annotate(p, m.withColumn("kp", F.struct("kp_a", "kp_b")), RES, ["sample_id"], feature=True)
    return out.select("point_id", _factor("kp.kp_a", 0).alias("a1"), _factor("kp.kp_b", 0).alias("b1"))


# ---------------------------------------------------------------- contrasts

_DESIGN = {"odd": lambda n: -1 if n % 2 else 1, "low": lambda n: (n < 5) - (n > 7)}


def _samples(spark, sf):
    """Sample names with the number they end in."""
    s = units(spark, sf).select("sample_id").distinct().collect()  # the list of samples
    return {r[0]: int("".join(c for c in r[0] if c.isdigit())) for r in s}


@query(", " + _LIVE + """, l AS (SELECT unit_id, min(top_k) AS factor FROM unit_factors WHERE top_k IS NOT NULL GROUP BY unit_id),
n AS (SELECT DISTINCT sample_id, CAST(regexp_replace(sample_id, '[^0-9]', '', 'g') AS INTEGER) AS i FROM u),
g AS (SELECT 'odd' AS contrast, sample_id, CASE WHEN i % 2 = 1 THEN 0 ELSE 1 END AS g FROM n UNION ALL SELECT 'low', sample_id, CASE WHEN i < 5 THEN 1 ELSE 0 END FROM n WHERE i < 5 OR i > 7),
d AS (SELECT contrast, factor, unit_id, g, feature, sum(ct) AS y FROM u JOIN l USING (unit_id) JOIN g USING (sample_id) GROUP BY ALL),
t AS (SELECT contrast, factor, unit_id, g, sum(y) AS n FROM d GROUP BY ALL HAVING sum(y) >= 5),
s AS (SELECT contrast, factor, sum(CASE WHEN g = 0 THEN n ELSE 0 END) AS N0, sum(CASE WHEN g = 1 THEN n ELSE 0 END) AS N1, sum(CASE WHEN g = 0 THEN n * n ELSE 0 END) AS C0, sum(CASE WHEN g = 1 THEN n * n ELSE 0 END) AS C1, count(*) AS m FROM t GROUP BY ALL HAVING N0 > 0 AND N1 > 0 AND m > 2),
f AS (SELECT contrast, factor, feature, sum(CASE WHEN g = 0 THEN y ELSE 0 END) AS Y0, sum(CASE WHEN g = 1 THEN y ELSE 0 END) AS Y1, sum(CASE WHEN g = 0 THEN y * y ELSE 0 END) AS A0, sum(CASE WHEN g = 1 THEN y * y ELSE 0 END) AS A1,
      sum(CASE WHEN g = 0 THEN y * n ELSE 0 END) AS B0, sum(CASE WHEN g = 1 THEN y * n ELSE 0 END) AS B1 FROM d JOIN t USING (contrast, factor, unit_id, g) GROUP BY ALL),
x AS (SELECT *, greatest((Y0 + Y1) / (N0 + N1) * 0.001, least(1 - 1e-8, Y0 / N0)) AS p0, greatest((Y0 + Y1) / (N0 + N1) * 0.001, least(1 - 1e-8, Y1 / N1)) AS p1 FROM f JOIN s USING (contrast, factor)),
v AS (SELECT *, (A0 - 2 * p0 * B0 + p0 * p0 * C0) / ((N0 * p0 * (1 - p0)) ** 2) + (A1 - 2 * p1 * B1 + p1 * p1 * C1) / ((N1 * p1 * (1 - p1)) ** 2) AS v FROM x)
SELECT contrast, factor, feature, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 4) AS beta, round(sqrt(v * m / (m - 2)), 4) AS se FROM v""")
def contrast_de(spark, sf):
    f = table(spark, sf, "unit_factors").where("top_k is not null").groupBy("unit_id").agg(F.min("top_k").alias("factor"))
    u = units(spark, sf).join(f, "unit_id").select(F.col("sample_id").alias("sample"), "factor", F.col("unit_id").alias("unit"), "feature", F.col("ct").alias("y"))
    names = _samples(spark, sf)
    design = {name: {s: rule(n) for s, n in names.items()} for name, rule in _DESIGN.items()}
    rows = E.contrasts(sorted(names), {k: v for k, v in design.items() if {-1, 1} <= set(v.values())})
    t = E.contrast_de(u, rows, min_unit=5)
    return t.select("contrast", "factor", "feature", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"))


@query(_ANNO + """, s AS (SELECT sample_id, px, py, sum(p) AS t FROM e GROUP BY ALL), r AS (SELECT sum((1 - t) * (1 - t)) / 64 AS r FROM s),
ab AS (SELECT a.k AS k1, b.k AS k2, sum(a.p * b.p) AS m FROM e a JOIN e b USING (sample_id, px, py) GROUP BY ALL),
g AS (SELECT i AS k1, j AS k2 FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))
SELECT CAST(g.k1 AS INTEGER) AS k1, CAST(g.k2 AS INTEGER) AS k2, coalesce(m, 0) + r AS mass FROM g LEFT JOIN ab USING (k1, k2), r""")
def pixel_confusion(spark, sf):
    return E.pixel_confusion(annotation(points(spark, sf)), K)


# ---------------------------------------------------------------- regions and masks


@query(""", b AS (SELECT sample_id, CAST(floor(y / 50.0) AS BIGINT) AS tile_row, CAST(floor(x / 50.0) AS BIGINT) AS tile_col, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY ALL)
SELECT sample_id, tile_row, tile_col, CAST(CASE WHEN -30 >= x1 OR 90 <= x0 OR -20 >= y1 OR 70 <= y0 THEN 0 WHEN -30 <= x0 AND 90 >= x1 AND -20 <= y0 AND 70 >= y1 THEN 2
  WHEN -30 >= x0 AND 90 <= x1 AND -20 >= y0 AND 70 <= y1 THEN 3 ELSE 1 END AS INTEGER) AS relation FROM b""")
def tile_relations(spark, sf):
    t = T.summary(points(spark, sf), 50.0, ["sample_id"])
    code = X.relation(tuple(F.col(c) for c in ("xmin", "xmax", "ymin", "ymax")), (-30.0, 90.0, -20.0, 70.0))
    return t.select("sample_id", "tile_row", "tile_col", code.alias("relation"))


@query(_ANNO + """, rg AS (SELECT row_number() OVER () AS rid, polygon_id, sample_id, ring FROM rings WHERE polygon_id IS NOT NULL AND len(ring) >= 3),
v AS (SELECT rid, unnest(ring) AS a, unnest(list_concat(ring[2:], ring[1:1])) AS b FROM rg), ed AS (SELECT rid, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v),
bb AS (SELECT rid, min(x0) AS lx, max(x0) AS hx, min(y0) AS ly, max(y0) AS hy FROM ed GROUP BY rid),
mid AS (SELECT sample_id, px, py, px + 0.5::DOUBLE AS x, py + 0.5::DOUBLE AS y FROM q),
c AS (SELECT mid.*, rg.rid, rg.polygon_id FROM mid JOIN rg USING (sample_id) JOIN bb ON bb.rid = rg.rid AND x BETWEEN lx AND hx AND y BETWEEN ly AND hy),
w AS (SELECT c.sample_id, px, py, polygon_id, c.rid,
  sum(CASE WHEN y0 <= y AND y1 > y AND (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) > 0 THEN 1 WHEN y0 > y AND y1 <= y AND (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) < 0 THEN -1 ELSE 0 END) AS turns,
  bool_or((x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) = 0 AND x BETWEEN least(x0, x1) AND greatest(x0, x1) AND y BETWEEN least(y0, y1) AND greatest(y0, y1)) AS edge
  FROM c JOIN ed ON ed.rid = c.rid GROUP BY ALL),
h AS (SELECT DISTINCT sample_id, px, py, polygon_id FROM w WHERE turns <> 0 OR edge)
SELECT polygon_id AS region, CAST(k AS INTEGER) AS k, count(*) AS pixels, sum(p) AS mass FROM e JOIN h USING (sample_id, px, py) GROUP BY ALL""")
def region_soft(spark, sf):
    return J.region_soft(annotation(points(spark, sf)), table(spark, sf, "rings"), RES)


def _window(k: int) -> str:
    return f"SELECT a.sample_id, a.px, a.py FROM o a JOIN o b ON a.sample_id = b.sample_id AND b.px BETWEEN a.px - 2 AND a.px + 2 AND b.py BETWEEN a.py - 2 AND a.py + 2 GROUP BY ALL HAVING sum(b.o{k}) >= 0.01 * 25"


@query(_ANNO + ", o AS (SELECT sample_id, px, py, " + ", ".join(f"sum(CASE WHEN k = {k} THEN p ELSE 0 END) AS o{k}" for k in (2, 3, 5)) + " FROM e GROUP BY ALL), "
       + ", ".join(f"m{k} AS ({_window(k)})" for k in (2, 3, 5)) + """,
s AS (SELECT k, sum(CASE WHEN m2.px IS NOT NULL THEN p ELSE 0 END) AS inside, sum(p) AS overall FROM e LEFT JOIN m2 USING (sample_id, px, py) GROUP BY k),
x AS (SELECT 3 AS k, count(*) AS overlap FROM m3 SEMI JOIN m2 USING (sample_id, px, py) UNION ALL SELECT 5, count(*) FROM m5 SEMI JOIN m2 USING (sample_id, px, py))
SELECT CAST(s.k AS INTEGER) AS k, inside, overall, overlap FROM s LEFT JOIN x USING (k)""")
def mask_profile(spark, sf):
    return G.mask_profile(annotation(points(spark, sf)), 2, 2, 0.01, [3, 5], by=["sample_id"])


@query()
def pixel_states(spark, sf):
    """Pixels in and about the outlines, by whether a polygon test is needed."""
    return G.pixel_states(table(spark, sf, "rings"), 2.0).groupBy("sample_id", "state").agg(F.count(F.lit(1)).alias("pixels"))


# ---------------------------------------------------------------- profiles


@query(_BULK + """, c AS (SELECT factor, sum(n) AS col FROM b GROUP BY factor), r AS (SELECT factor, feature, sqrt(n / col) AS r FROM b JOIN c USING (factor))
SELECT x.factor AS a, y.factor AS b, round(least(1.0, sum(x.r * y.r)), 6) AS coefficient FROM r x JOIN r y ON x.feature = y.feature AND x.factor < y.factor GROUP BY ALL""")
def profile_similarity(spark, sf):
    return R.profile_similarity(bulk(spark, sf)).select("a", "b", F.round("coefficient", 6).alias("coefficient"))


@query(", " + _LIVE + """, m AS (SELECT feature, CAST(quantile_disc(ct, 0.5) AS DOUBLE) AS median FROM u GROUP BY feature)
SELECT feature, median, quantile_disc(abs(ct - median), 0.5) AS mad FROM u JOIN m USING (feature) GROUP BY ALL""")
def feature_median_mad(spark, sf):
    return H.median_mad(units(spark, sf), "feature", "ct")


@query(", " + _LIVE + ", f AS (SELECT DISTINCT feature FROM u UNION SELECT DISTINCT lower(trim(feature)) FROM feature_stats WHERE feature IS NOT NULL) SELECT feature FROM f")
def feature_union(spark, sf):
    other = table(spark, sf, "feature_stats").where("feature is not null").select(F.lower(F.trim("feature")).alias("feature"))
    return units(spark, sf).select("feature").union(other).distinct()


@query("""RECURSIVE, o AS (SELECT feature, CAST(sum(ct) AS BIGINT) AS ct FROM p GROUP BY feature),
i AS (SELECT feature, ct, row_number() OVER (ORDER BY ct DESC, feature) AS i FROM o),
w AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS bin, CAST(0 AS HUGEINT) AS held, (SELECT sum(ct) FROM o) AS rest, 1 AS b
  UNION ALL SELECT i.i, w.b, CASE WHEN w.b < 8 AND (w.held + i.ct) * (9 - w.b) >= w.rest THEN 0 ELSE w.held + i.ct END,
    CASE WHEN w.b < 8 AND (w.held + i.ct) * (9 - w.b) >= w.rest THEN w.rest - w.held - i.ct ELSE w.rest END, CASE WHEN w.b < 8 AND (w.held + i.ct) * (9 - w.b) >= w.rest THEN w.b + 1 ELSE w.b END
  FROM w JOIN i ON i.i = w.i + 1)
SELECT feature, ct, w.bin FROM i JOIN w USING (i)""")
def gene_bins_fixed(spark, sf):
    counts = [(r[0], r[1]) for r in T.feature_totals(points(spark, sf)).collect()]  # the table of features
    return spark.createDataFrame(R.fixed_bins(counts, 8), "feature string, ct long, bin int")


@query()
def dense_kmeans(spark, sf):
    """Clusters of the units' factor values: size and mean squared distance."""
    u = once(table(spark, sf, "unit_factors").select("unit_id", F.col("dense").alias("vec"), "recv_ts"), ["unit_id"]).select("unit_id", "vec")
    centres, _, _ = kmeans.fit(u, 8, 32)
    return kmeans.assign(u, centres, "unit_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("distance"), 6).alias("spread"))
