import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import proximity as P

POINT = "point_id long, sample_id string, x double, y double"
RING = "polygon_id string, sample_id string, ring array<struct<x double, y double>>"


def brute_pairs(rows, r):
    seen = {}
    for i, g, x, y in rows:
        if None not in (i, g, x, y) and math.isfinite(x) and math.isfinite(y):
            seen.setdefault(g, set()).add((i, x, y))
    out = set()
    for pts in seen.values():
        for i, x, y in pts:
            out |= {(i, j) for j, u, v in pts if i < j and (x - u) ** 2 + (y - v) ** 2 < r * r}
    return out


@pytest.mark.parametrize("r", [0.625, 3.0])
def test_near_pairs_equal_brute_force(spark, r):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 3}", float(round(x * 64) / 64), float(round(y * 64) / 64)) for i, (x, y) in enumerate(rng.normal(0, 8, (700, 2)))]
    rows += rows[:50]  # repeated rows
    rows += [(1000, None, 0.0, 0.0), (1001, "s0", None, 0.0), (1002, "s0", math.nan, 0.0), (1003, "s0", math.inf, 0.0), (None, "s0", 0.0, 0.0)]
    rows += [(2000, "s9", 0.0, 0.0), (2001, "s9", r, 0.0), (2002, "s9", -0.0, 0.0)]  # exactly at the radius; the same place
    got = P.near_pairs(spark.createDataFrame(rows, POINT), r).collect()
    assert len(got) == len(set(got))
    assert {tuple(g) for g in got} == brute_pairs(rows, r)


@pytest.mark.parametrize("hot,listed", [(40, P.HOT_LIST), (8, P.HOT_LIST), (8, 2)])
def test_near_pairs_in_hot_blocks(spark, monkeypatch, hot, listed):
    """Half of the rows in one block, which is cut; small blocks that are hot still; more hot blocks than are listed."""
    monkeypatch.setattr(P, "HOT_BLOCK", hot)
    monkeypatch.setattr(P, "HOT_LIST", listed)
    rng = np.random.default_rng(4)
    rows = [(i, "s", float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(0, 4, (200, 2)), rng.normal(16, 0.6, (100, 2)), rng.uniform(-40, 40, (150, 2))]))]
    assert {tuple(g) for g in P.near_pairs(spark.createDataFrame(rows, POINT), 0.5).collect()} == brute_pairs(rows, 0.5)


def test_empty_tables(spark):
    p, r = spark.createDataFrame([], POINT), spark.createDataFrame([], RING)
    assert P.near_pairs(p, 1.0).count() == 0
    assert P.points_in_rings(p, r).count() == 0


def test_clashing_columns(spark):
    p = spark.createDataFrame([(1, "s", 0.0, 0.0), (2, "s", 0.1, 0.0)], POINT)
    for c in ("id", "grp", "bx", "lx", "salt", "home", "edges"):
        p = p.withColumn(c, F.lit("x"))
    assert [tuple(r) for r in P.near_pairs(p, 1.0).collect()] == [(1, 2)]
    ring = spark.createDataFrame([("a", "s", [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0)])], RING).withColumn("region", F.lit(1)).withColumn("lo", F.lit(2))
    assert {tuple(r) for r in P.points_in_rings(p, ring).collect()} == {(1, "a"), (2, "a")}


def winding(px, py, ring):
    turns = 0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        c = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
        if c == 0 and min(x0, x1) <= px <= max(x0, x1) and min(y0, y1) <= py <= max(y0, y1):
            return True
        turns += (y0 <= py < y1 and c > 0) - (y1 <= py < y0 and c < 0)
    return turns != 0


@pytest.mark.parametrize("hot", [P.HOT_BLOCK, 20])
def test_points_in_rings_equal_brute_force(spark, monkeypatch, hot):
    """Also with points of a block divided over tasks."""
    monkeypatch.setattr(P, "HOT_BLOCK", hot)
    rng = np.random.default_rng(5)
    rings = []
    for k in range(12):
        n, c, size = int(rng.integers(3, 12)), rng.uniform(-40, 40, 2), rng.choice([3.0, 20.0, 90.0])
        a = np.sort(rng.uniform(0, 2 * math.pi, n))[:: rng.choice([1, -1])]
        v = [(float(round(64 * (c[0] + size * w * math.cos(t))) / 64), float(round(64 * (c[1] + size * w * math.sin(t))) / 64)) for t, w in zip(a, rng.uniform(0.4, 1, n))]
        rings.append((f"p{k % 9}", f"s{k % 2}", v + [v[0]] * (k % 2)))
    rings += rings[:2] + [(None, "s0", rings[0][2]), ("short", "s0", [(0.0, 0.0), (1.0, 1.0)]), ("none", "s0", None), ("empty", "s0", [])]
    pts = [(i, f"s{i % 2}", float(round(x * 64) / 64), float(round(y * 64) / 64)) for i, (x, y) in enumerate(rng.uniform(-120, 120, (900, 2)))]
    pts += [(5000 + i, "s0", x, y) for i, (x, y) in enumerate(rings[0][2])]  # vertices are inside
    want = {(i, name) for i, g, x, y in pts for name, s, ring in rings if name and s == g and ring and len(ring) >= 3 and winding(x, y, ring)}
    got = P.points_in_rings(spark.createDataFrame(pts, POINT), spark.createDataFrame(rings, RING)).collect()
    assert len(got) == len(set(got)) and {tuple(g) for g in got} == want


def test_cover_of_a_wide_ring_is_quick():
    """A ring 4,000 across with 400 vertices takes less than a second, and its ranges hold what they should."""
    import time

    a = np.linspace(0, 2 * math.pi, 400, endpoint=False)
    ring = np.stack([2000 * np.cos(a), (1500 + 500 * np.cos(7 * a)) * np.sin(a)], 1)
    e = P.ring_edges(ring)
    began = time.time()
    cover = list(P.cover_ring(e, 4.0))
    assert time.time() - began < 1
    rng = np.random.default_rng(1)
    pts = rng.uniform(-2100, 2100, (3000, 2))
    want = P.inside(pts[:, 0], pts[:, 1], e)
    cell = np.floor(pts / 4).astype(int)
    block, code = cell // P.REGION_BLOCK, P.morton(*(cell % P.REGION_BLOCK).T)
    by = {}
    for bx, by_, lo, hi, inner, es in cover:
        by.setdefault((bx, by_), []).append((lo, hi, inner, es))
    for (x, y), b, c, w in zip(pts, block, code, want):
        hit = [r for r in by.get(tuple(b.tolist()), []) if r[0] <= c < r[1]]
        assert len(hit) <= 1
        got = bool(hit) and (hit[0][2] or bool(P.inside(np.array([x]), np.array([y]), np.array(hit[0][3]).reshape(-1, 4))[0]))
        assert got == w


def test_morton_codes_are_interleaved_bits():
    assert P.morton(np.array([1, 0, 3]), np.array([0, 1, 3])).tolist() == [1, 2, 15]
