import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.functions import grid, pairs, stats
from pointloom.operators import aggregates, ranks


def test_hexagon_holds_its_point(spark):
    rng = np.random.default_rng(0)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-50, 50, (300, 2))] + [(0.0, 0.0)]
    h = spark.createDataFrame(pts, "x double, y double").withColumns(grid.hexagon("x", "y", 1.0))
    h = h.withColumns({f"c{k}": v for k, v in grid.hexagon_centre("hx", "hy", 1.0).items()}).collect()
    for r in h:
        d = math.hypot(r.x - r.cx, r.y - r.cy)
        assert d <= 1.0 + 1e-9
        around = [(r.cx + math.sqrt(3) * math.cos(a), r.cy + math.sqrt(3) * math.sin(a)) for a in np.arange(6) * math.pi / 3]
        assert all(d <= math.hypot(r.x - u, r.y - v) + 1e-9 for u, v in around)
    assert (h[-1].hx, h[-1].hy) == (0, 0)


def test_bcc_takes_the_nearest_centre(spark):
    rng = np.random.default_rng(1)
    pts = [tuple(map(float, p)) for p in rng.uniform(-5, 5, (200, 3))]
    b = spark.createDataFrame(pts, "x double, y double, z double").withColumns(grid.bcc("x", "y", "z", 2.0)).collect()
    for r in b:
        p, c = np.array([r.x, r.y, r.z]), np.array([r.bx, r.by, r.bz]) * 1.0
        assert len({int(v) % 2 for v in c}) == 1
        lattice = [np.array(q) * 2.0 + o for o in (0.0, 1.0) for q in np.ndindex(7, 7, 7)]
        best = min(np.linalg.norm(p - (q - 6)) for q in lattice)
        assert abs(np.linalg.norm(p - c) - best) < 1e-9


def test_pairs(spark):
    d = spark.createDataFrame([([(3, 0.2), (1, 0.5), (0, 0.2)],), ([],)], "kp array<struct<k:int,p:double>>")
    r = d.select(pairs.top("kp", 2).alias("t"), pairs.placeholder("kp", 2).alias("f"), pairs.entropy("kp").alias("e")).collect()
    assert [(e.k, e.p) for e in r[0].t] == [(1, 0.5), (0, 0.2)]
    assert [(e.k, e.p) for e in r[1].f] == [(-1, 0.0), (-1, 0.0)]
    assert abs(r[0].e + sum(p * math.log(p) for p in (0.2, 0.5, 0.2))) < 1e-12


def test_chisq_and_p(spark):
    r = spark.range(1).select(stats.chisq_2x2(F.lit(10), F.lit(20), F.lit(30), F.lit(40), 0.5).alias("c"), stats.chisq_2x2(F.lit(0), F.lit(0), F.lit(1), F.lit(2)).alias("z")).first()
    a, b, c, d = 10.5, 20.5, 30.5, 40.5
    assert abs(r.c - (a * d - b * c) ** 2 * (a + b + c + d) / ((a + b) * (c + d) * (a + c) * (b + d))) < 1e-12
    assert r.z == 0
    assert abs(stats.log10p_of(np.array([3.841459]))[0] - -math.log10(0.05)) < 1e-5
    assert np.all(np.diff(stats.log10p_of(np.linspace(150, 260, 50))) > 0)


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 1e4))
def test_digamma(x):
    h = 1e-4 * max(1, x)
    if x > 0.1:
        assert abs(stats.digamma(np.array([x]))[0] - (math.lgamma(x + h / 2) - math.lgamma(x - h / 2)) / h) < 1e-4 * max(1, abs(math.log(x))) + 1e-4


def test_occurrence_golden(spark):
    units = spark.createDataFrame([("u0", "A", 1), ("u0", "B", 3), ("u1", "A", 2), ("u1", "C", 5), ("u2", "B", 1), ("u2", "D", 0)], "unit_id string, feature string, ct int")
    s = aggregates.occurrence(units, ["unit_id"], 3)
    got = {r.feature: r for r in aggregates.feature_weights(s, 3).collect()}
    cols = ("total_count", "n_units_present", "n_units_count_gt1", "n_units_count_gt2", "n_units_count_gt_mean")
    assert [tuple(got[f][c] for c in cols) for f in "ABCD"] == [(3, 2, 1, 0, 1), (4, 2, 1, 1, 1), (5, 1, 1, 1, 1), (0, 0, 0, 0, 0)]
    want = {"A": (0.1, 1.286517), "B": (0.1, 1.01954), "C": (0.787589, 0.812458), "D": (1.0, 5.0)}
    for f, (i, w) in want.items():
        assert abs(got[f].idf - i) < 1e-5, f
        assert abs(got[f].info_weight - w) < 1e-5, f


def test_gene_bins():
    counts = [("a", 50), ("b", 30), ("c", 10), ("d", 10)]
    assert [b for *_, b in ranks.fixed_bins(counts, 2)] == [1, 2, 2, 2]
    bins = ranks.adaptive_bins(counts, 40, 0.9)
    assert bins[0] == ("a", 50, 1) and {b for *_, b in bins} <= {1, 2, 3}
    assert sorted(f for f, *_ in bins) == ["a", "b", "c", "d"]
