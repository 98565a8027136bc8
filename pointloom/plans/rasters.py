"""Queries of the raster operators: the top labels of ``reference.annotation``, in tiles of 16 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointloom.operators import raster as G
from pointloom.plans.reference import _ANNO, annotation, points, query

TILE = 16


def _raster(spark, sf):
    """Pixels in neighbourhoods of four share a label, so that there is something to smooth and to outline."""
    a = annotation(points(spark, sf)).select("sample_id", "px", "py")
    odd = F.pmod(F.col("px") * 31 + F.col("py") * 17, F.lit(11)) == 0
    base = F.pmod(F.floor(F.col("px") / 4) + F.floor(F.col("py") / 4), F.lit(3))
    return a.select("sample_id", "px", "py", F.when(odd, 3).otherwise(base).cast("int").alias("label"), (F.lit(0.5) + F.pmod("px", F.lit(4)) / F.lit(8.0)).alias("p"))


_R = _ANNO + """, ra AS (SELECT sample_id, px, py, CASE WHEN ((px * 31 + py * 17) % 11 + 11) % 11 = 0 THEN 3
  ELSE CAST(((floor(px / 4.0) + floor(py / 4.0)) % 3 + 3) % 3 AS BIGINT) END AS label, 0.5 + ((px % 4 + 4) % 4) / 8.0 AS p FROM q)
"""
_OFF = "(SELECT unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx, unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i)"


@query(_R + f""", v AS (SELECT sample_id, px - dx AS px, py - dy AS py, label AS vote, count(*) AS n, min(i) AS i, min(p) AS vp FROM ra, {_OFF}
  WHERE floor((px - dx) / 16.0) = floor(px / 16.0) AND floor((py - dy) / 16.0) = floor(py / 16.0) GROUP BY ALL),
b AS (SELECT sample_id, px, py, vote, n, vp FROM v QUALIFY row_number() OVER (PARTITION BY sample_id, px, py ORDER BY n DESC, i) = 1),
o AS (SELECT ra.sample_id, ra.px, ra.py, n AS own FROM ra JOIN v ON v.sample_id = ra.sample_id AND v.px = ra.px AND v.py = ra.py AND v.vote = ra.label),
t AS (SELECT ra.*, b.vote, b.vp, coalesce(own, 0) <= 1 AND b.n - coalesce(own, 0) > 3 AND b.vote <> ra.label AS turn FROM ra LEFT JOIN b USING (sample_id, px, py) LEFT JOIN o USING (sample_id, px, py))
SELECT sample_id, px, py, CAST(CASE WHEN turn THEN vote ELSE label END AS INTEGER) AS label, CASE WHEN turn THEN vp ELSE p END AS p FROM t""")
def smooth_labels(spark, sf):
    return G.smooth(_raster(spark, sf), 1, TILE, by=["sample_id"])


_EDGES = _R + """, m AS (SELECT ra.sample_id, ra.label AS a, coalesce(o.label, 8) AS b, CASE WHEN o.label IS NULL THEN 2 ELSE 1 END AS w
  FROM (SELECT *, px + dx AS qx, py + dy AS qy FROM ra, (SELECT unnest([0, -1, 1, 0]) AS dx, unnest([-1, 0, 0, 1]) AS dy)) ra
  LEFT JOIN ra o ON o.sample_id = ra.sample_id AND o.px = qx AND o.py = qy
  WHERE floor(qx / 16.0) = floor(ra.px / 16.0) AND floor(qy / 16.0) = floor(ra.py / 16.0) AND ra.label <> coalesce(o.label, 8)),
ed AS (SELECT sample_id, least(a, b) AS l1, greatest(a, b) AS l2, CAST(sum(w) / 2 AS BIGINT) AS n FROM m GROUP BY ALL),
ar AS (SELECT sample_id, label, count(*) AS area FROM ra GROUP BY ALL),
pe AS (SELECT sample_id, label, CAST(sum(n) AS BIGINT) AS perimeter FROM (SELECT sample_id, l1 AS label, n FROM ed UNION ALL SELECT sample_id, l2, n FROM ed) GROUP BY ALL),
one AS (SELECT sample_id, label, coalesce(area, 0) AS area, coalesce(perimeter, 0) AS perimeter FROM ar FULL JOIN pe USING (sample_id, label))
"""


@query(_EDGES + "SELECT sample_id, CAST(label AS INTEGER) AS label, area, perimeter FROM one")
def label_areas(spark, sf):
    return G.metrics(_raster(spark, sf), 8, TILE, ["sample_id"])[0]


@query(_EDGES + """SELECT ed.sample_id, CAST(l1 AS INTEGER) AS l1, CAST(l2 AS INTEGER) AS l2, n AS contact, round(n / greatest(1, x.perimeter), 6) AS frac1, round(n / greatest(1, y.perimeter), 6) AS frac2,
  round(n / greatest(1, x.perimeter + y.perimeter - n), 6) AS frac0, round(n / greatest(1, least(x.area, y.area)), 6) AS density
FROM ed JOIN one x ON x.sample_id = ed.sample_id AND x.label = l1 JOIN one y ON y.sample_id = ed.sample_id AND y.label = l2""")
def label_contacts(spark, sf):
    two = G.metrics(_raster(spark, sf), 8, TILE, ["sample_id"])[1]
    return two.select("sample_id", "l1", "l2", "contact", *[F.round(c, 6).alias(c) for c in ("frac1", "frac2", "frac0", "density")])


_FIRST = "(ra.py + 1073741824) * 2147483648 + ra.px + 1073741824"
_CC = "RECURSIVE " + _R + f""", w AS (SELECT sample_id, px, py, label, {_FIRST} AS c FROM ra
  UNION SELECT ra.sample_id, ra.px, ra.py, ra.label, w.c FROM w JOIN ra ON ra.sample_id = w.sample_id AND ra.label = w.label AND abs(ra.px - w.px) + abs(ra.py - w.py) = 1 AND w.c < {_FIRST}),
cc AS (SELECT sample_id, px, py, label, min(c) AS component FROM w GROUP BY ALL),
cs AS (SELECT sample_id, label, component, count(*) AS size FROM cc GROUP BY ALL)
"""


@query(_CC + "SELECT sample_id, CAST(label AS INTEGER) AS label, component, size FROM cs")
def label_components(spark, sf):
    c = G.label_components(_raster(spark, sf), TILE, ["sample_id"])
    return c.groupBy("sample_id", "label", "component").agg(F.count(F.lit(1)).alias("size"))


@query(_CC + "SELECT sample_id, CAST(label AS INTEGER) AS label, size, count(*) AS n FROM cs WHERE size >= 2 GROUP BY ALL")
def component_sizes(spark, sf):
    return G.hard_masks(_raster(spark, sf), 2, TILE, ["sample_id"])[1]


def _ring(i: int) -> str:
    """Pixels reached at step i and not before, in SQL."""
    new = " ".join(f"AND NOT EXISTS (FROM f{j} b WHERE b.sample_id = ra.sample_id AND b.px = ra.px AND b.py = ra.py AND b.seed = f.seed)" for j in range(1, i))
    return f", f{i} AS (SELECT DISTINCT ra.sample_id, ra.px, ra.py, f.seed, ra.label AS other, {i} AS d FROM f{i - 1} f JOIN ra ON ra.sample_id = f.sample_id AND abs(ra.px - f.px) + abs(ra.py - f.py) = 1 WHERE ra.label <> f.seed {new})"


@query(_CC + ", f0 AS (SELECT sample_id, px, py, label AS seed FROM cc SEMI JOIN (FROM cs WHERE size >= 2) USING (sample_id, label, component))" + _ring(1) + _ring(2) + _ring(3)
       + " SELECT sample_id, CAST(seed AS INTEGER) AS label, CAST(other AS INTEGER) AS other, d, count(*) AS n FROM (FROM f1 UNION ALL FROM f2 UNION ALL FROM f3) GROUP BY ALL")
def shells(spark, sf):
    return G.shells(_raster(spark, sf), 3, 2, TILE, ["sample_id"])


@query(_ANNO + """, o AS (SELECT sample_id, px, py, sum(CASE WHEN k = 2 THEN p ELSE 0 END) AS own, sum(p) AS t FROM e GROUP BY ALL),
w AS (SELECT a.sample_id, a.px, a.py, sum(b.own) AS w, sum(b.t) AS t FROM o a JOIN o b ON a.sample_id = b.sample_id AND b.px BETWEEN a.px - 2 AND a.px + 2 AND b.py BETWEEN a.py - 2 AND a.py + 2 GROUP BY ALL)
SELECT * FROM w WHERE t >= 1.0 AND w >= 0.3 * t""")
def soft_mask(spark, sf):
    return G.soft_mask(annotation(points(spark, sf)), 2, 2, 0.3, by=["sample_id"])


@query(_ANNO + """, o AS (SELECT sample_id, px, py, sum(CASE WHEN k = 2 THEN p ELSE 0 END) AS own, sum(p) AS t FROM e GROUP BY ALL),
w AS (SELECT a.sample_id, a.px, a.py, sum(b.own) AS w, sum(b.t) AS t FROM o a JOIN o b ON a.sample_id = b.sample_id AND b.px BETWEEN a.px - 2 AND a.px + 2 AND b.py BETWEEN a.py - 2 AND a.py + 2 GROUP BY ALL),
m AS (SELECT * FROM w WHERE t >= 1.0 AND w >= 0.3 * t)
SELECT 2 AS focal, CAST(k AS INTEGER) AS k, sum(p) AS mass FROM e JOIN m USING (sample_id, px, py) GROUP BY ALL UNION ALL SELECT -1, CAST(k AS INTEGER), sum(p) FROM e GROUP BY ALL""")
def mask_composition(spark, sf):
    a = annotation(points(spark, sf))
    m = G.soft_mask(a, 2, 2, 0.3, by=["sample_id"]).withColumn("focal", F.lit(2))
    return G.mask_composition(a, m, ["sample_id"])


@query(_R + """, n AS (SELECT sample_id, px + dx AS px, py + dy AS py, count(*) AS n FROM ra, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE label = 1 GROUP BY ALL)
SELECT sample_id, px, py FROM n""")
def mask_dilated(spark, sf):
    return G.grown(_raster(spark, sf).where("label = 1"), 1, ["sample_id"])


@query(_CC + "SELECT sample_id, CAST(label AS INTEGER) AS label, component, CAST(size AS DOUBLE) AS area FROM cs")
def mask_outlines(spark, sf):
    """The area within each component's rings, holes taken off."""
    c = G.label_components(_raster(spark, sf), TILE, ["sample_id"])
    return G.outlines(c, ["sample_id"]).groupBy("sample_id", "label", "component").agg(F.sum("area").alias("area"))
