"""Row filters: rectangles, polygons, z, features, counts, weights."""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.proximity import points_in_rings


def rectangles(points: DataFrame, boxes: list[tuple[float, float, float, float]], tile_size: float | None = None) -> DataFrame:
    """Points in any of the half-open boxes (xmin, xmax, ymin, ymax).

    With ``tile_size`` the input carries ``tile_row`` and ``tile_col`` of that
    size; the ranges of tiles are added as predicates, which prune partitions.
    """
    x, y = F.col("x"), F.col("y")
    tests = []
    for x0, x1, y0, y1 in boxes:
        t = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        if tile_size:
            r, c = F.col("tile_row"), F.col("tile_col")
            t = t & r.between(int(np.floor(y0 / tile_size)), int(np.floor(y1 / tile_size))) & c.between(int(np.floor(x0 / tile_size)), int(np.floor(x1 / tile_size)))
        tests.append(t)
    return points.where(reduce(lambda a, b: a | b, tests)) if tests else points.limit(0)


def z_range(points: DataFrame, low: float | None, high: float | None, z: str = "z") -> DataFrame:
    if low is not None:
        points = points.where(F.col(z) >= low)
    return points.where(F.col(z) < high) if high is not None else points


def in_polygons(points: DataFrame, rings: DataFrame, key: str = "point_id", group: str = "sample_id", **names) -> DataFrame:
    """Points in the union of the rings, each once (see ``points_in_rings`` for what counts as inside)."""
    held = points_in_rings(points, rings, key=key, group=group, **names).select(F.col("id").alias(key)).distinct()
    return points.join(held, key, "left_semi")


def geojson_polygons(text: str) -> list[list[list[tuple[float, float]]]]:
    """Rings of the polygons in GeoJSON of any nesting; holes count as filled, as does every other ring."""
    out: list[list[list[tuple[float, float]]]] = []

    def walk(o) -> None:
        if isinstance(o, list):
            for x in o:
                walk(x)
        elif isinstance(o, dict):
            kind = o.get("type")
            if kind == "Polygon":
                out.append([[(float(p[0]), float(p[1])) for p in ring] for ring in o["coordinates"]])
            elif kind == "MultiPolygon":
                out.extend([[(float(p[0]), float(p[1])) for p in ring] for ring in poly] for poly in o["coordinates"])
            else:
                for k in ("features", "geometry", "geometries", "geojson", "regions"):
                    if k in o:
                        walk(o[k])

    walk(json.loads(text))
    return out


def relation(own: tuple, other: tuple):
    """Code of how two rectangles (xmin, xmax, ymin, ymax, columns or numbers) lie: 0 apart, 1 overlapping, 2 the other holds this one, 3 this one holds the other."""
    x0, x1, y0, y1 = (c if isinstance(c, Column) else F.lit(c) for c in own)
    u0, u1, v0, v1 = (c if isinstance(c, Column) else F.lit(c) for c in other)
    apart = (u0 >= x1) | (u1 <= x0) | (v0 >= y1) | (v1 <= y0)
    held = (u0 <= x0) & (u1 >= x1) & (v0 <= y0) & (v1 >= y1)
    holds = (u0 >= x0) & (u1 <= x1) & (v0 >= y0) & (v1 <= y1)
    return F.when(apart, 0).when(held, 2).when(holds, 3).otherwise(1)


def repaired_ring(ring: list[tuple[float, float]], scale: float = 64.0) -> list[list[tuple[float, float]]]:
    """Simple rings that enclose what the ring encloses by the even-odd rule; [] if nothing.

    Vertices are rounded to ``1 / scale``.  Edges are cut where they meet, pieces
    that lie on each other an even number of times vanish, and at every corner the
    walk takes the turn furthest to the left, so no ring crosses itself.
    """
    from fractions import Fraction as Q

    pts = [(Q(round(x * scale), 1), Q(round(y * scale), 1)) for x, y, *_ in ring]
    edges = [(a, b) for a, b in zip(pts, pts[1:] + pts[:1]) if a != b]
    cuts: list[set] = [{a, b} for a, b in edges]
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    within = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    order = sorted(range(len(edges)), key=lambda i: min(edges[i][0][0], edges[i][1][0]))
    for n, i in enumerate(order):  # sweep by x: only edges whose spans of x overlap are compared
        a, b = edges[i]
        most = max(a[0], b[0])
        for j in order[n + 1 :]:
            c, d = edges[j]
            if min(c[0], d[0]) > most:
                break
            s1, s2, s3, s4 = cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)
            if s1 * s2 < 0 and s3 * s4 < 0:
                t = s3 / (s3 - s4)
                at = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                cuts[i].add(at)
                cuts[j].add(at)
            for s, k, u, v, w in ((s1, i, a, b, c), (s2, i, a, b, d), (s3, j, c, d, a), (s4, j, c, d, b)):
                if s == 0 and within(u, v, w):
                    cuts[k].add(w)
    odd: dict[tuple, int] = {}
    for (a, b), at in zip(edges, cuts):
        line = sorted(at, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        for u, v in zip(line, line[1:]):
            odd[min(u, v), max(u, v)] = odd.get((min(u, v), max(u, v)), 0) ^ 1
    links: dict[tuple, list] = {}
    for (u, v), k in odd.items():
        if k:
            links.setdefault(u, []).append(v)
            links.setdefault(v, []).append(u)
    out = []
    while links:
        start = min(links)
        path, at, came = [start], start, None
        while True:
            last = path[-2] if len(path) > 1 else None
            came = (at[0] - last[0], at[1] - last[1]) if last else (Q(0), Q(-1))

            def turn(p):
                d = (p[0] - at[0], p[1] - at[1])
                back = (-came[0], -came[1])
                # angle from the way back, clockwise: the last one is the turn furthest to the left
                return math.atan2(float(back[0] * d[1] - back[1] * d[0]), float(back[0] * d[0] + back[1] * d[1])) % (2 * math.pi)

            to = min(links[at], key=lambda p: (turn(p) or 2 * math.pi, p))
            for u, v in ((at, to), (to, at)):
                links[u].remove(v)
                if not links[u]:
                    del links[u]
            if to in path:  # a ring is closed; what came before goes on from here
                k = path.index(to)
                out.append(path[k:])
                path = path[: k + 1]
                at = to
                if len(path) == 1:
                    break
                continue
            path.append(to)
            at = to
    return [[(float(x) / scale, float(y) / scale) for x, y in r] for r in out if len(r) >= 3]


def normal_ring(ring: list[tuple[float, float]], scale: float = 1.0) -> list[tuple[int, int]]:
    """Rounded to the integer grid of ``scale``, without repeated and collinear vertices; [] if fewer than 3 are left."""
    pts = [(round(x * scale), round(y * scale)) for x, y, *_ in ring]
    pts = [p for i, p in enumerate(pts) if p != pts[i - 1]] if len(pts) > 1 else pts
    while len(pts) >= 3:
        keep = [b for a, b, c in zip(pts[-1:] + pts[:-1], pts, pts[1:] + pts[:1]) if (b[0] - a[0]) * (c[1] - a[1]) != (c[0] - a[0]) * (b[1] - a[1])]
        if len(keep) == len(pts):
            return pts
        pts = keep
    return []


def self_intersects(ring: list[tuple[float, float]]) -> bool:
    """Whether two edges of the ring that aren't neighbours meet."""
    e = list(zip(ring, ring[1:] + ring[:1]))
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    for i in range(len(e)):
        for j in range(i + 1, len(e)):
            if j == i + 1 or (i == 0 and j == len(e) - 1):
                continue
            (a, b), (c, d) = e[i], e[j]
            s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
            if (s[0] > 0) != (s[1] > 0) and (s[2] > 0) != (s[3] > 0) and 0 not in s:
                return True
            if any(v == 0 and on(*w) for v, w in zip(s, ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))):
                return True
    return False


def tile_states(rings: DataFrame, size: float, group: str = "sample_id") -> DataFrame:
    """Tiles the union of rings touches: 'partial' if an edge may cross it, 'inside' if it is covered as a whole."""
    from pointloom.operators.proximity import REGION_BLOCK, cover_ring, ring_edges

    def cover(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for g, ring in zip(b.column("grp").to_pylist(), b.column("ring").to_pylist()):
                v = [(p["x"], p["y"]) for p in ring or [] if p and p["x"] is not None and p["y"] is not None]
                if len(v) < 3 or not len(e := ring_edges(np.array(v, float))):
                    continue
                for bx, by, lo, hi, inner, _ in cover_ring(e, size):
                    for code in range(lo, hi):
                        cx = sum(((code >> (2 * i)) & 1) << i for i in range(4))
                        cy = sum(((code >> (2 * i + 1)) & 1) << i for i in range(4))
                        out.append((g, by * REGION_BLOCK + cy, bx * REGION_BLOCK + cx, int(inner)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32()))], ["grp", "tile_row", "tile_col", "inner"])

    t = rings.select(F.col(group).cast("string").alias("grp"), "ring").mapInArrow(cover, "grp string, tile_row long, tile_col long, inner int")
    t = t.groupBy("grp", "tile_row", "tile_col").agg(F.max("inner").alias("inner"))
    return t.select(F.col("grp").alias(group), "tile_row", "tile_col", F.when(F.col("inner") == 1, "inside").otherwise("partial").alias("state"))


def features(rows: DataFrame, include: str | None = None, exclude: str | None = None, feature: str = "feature", search: bool = False) -> DataFrame:
    """Rows whose feature matches ``include`` and not ``exclude``: as a whole, or anywhere with ``search``."""
    whole = (lambda p: p) if search else (lambda p: f"^(?:{p})$")
    if include:
        rows = rows.where(F.col(feature).rlike(whole(include)))
    return rows.where(~F.col(feature).rlike(whole(exclude))) if exclude else rows


def frequent_features(rows: DataFrame, least: int, feature: str = "feature", count: str = "ct") -> DataFrame:
    """Rows of features whose counts sum to at least ``least``."""
    kept = rows.groupBy(feature).agg(F.sum(F.col(count).cast("long")).alias("__n")).where(F.col("__n") >= least)
    return rows.join(kept.select(feature), feature, "left_semi")


def frequent_units(rows: DataFrame, unit: list[str], thresholds: dict[str, int]) -> DataFrame:
    """Rows of units of which any count column sums to at least its threshold; before any weighting."""
    sums = rows.groupBy(*unit).agg(*[F.sum(F.col(c).cast("long")).alias(f"__{c}") for c in thresholds])
    any_ = reduce(lambda a, b: a | b, [F.col(f"__{c}") >= n for c, n in thresholds.items()])
    return rows.join(sums.where(any_).select(*unit), unit, "left_semi")


def weighted(rows: DataFrame, weights: DataFrame, default: float | None = 1.0, feature: str = "feature", count: str = "ct") -> DataFrame:
    """``rows`` with ``wct``: counts times the feature's weight.

    Negative, NaN and infinite weights are ignored.  Features without a weight get
    ``default``, or with None are dropped.
    """
    ok = weights.where((F.col("weight") >= 0) & ~F.isnan("weight") & (F.col("weight") < float("inf"))).select(feature, "weight")
    out = rows.join(ok, feature, "left" if default is not None else "inner")
    return out.withColumn("wct", F.col(count) * F.coalesce("weight", F.lit(default))).drop("weight")


def remapped(rows: DataFrame, mapping: DataFrame, keep_unmapped: bool = False, feature: str = "feature") -> DataFrame:
    """Features renamed by ``mapping`` (``feature, new_feature``); others are dropped unless kept as they are."""
    out = rows.join(mapping.select(feature, "new_feature"), feature, "left" if keep_unmapped else "inner")
    return out.withColumn(feature, F.coalesce("new_feature", feature)).drop("new_feature")


def sampled_tiles(tiled: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """All records of a seeded share of the tiles."""
    u = F.pmod(F.xxhash64(F.lit(seed), "tile_row", "tile_col"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return tiled.where(u < fraction)


def columns(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, always: list[str] = ()) -> DataFrame:
    """The columns kept; those of ``always`` stay whatever the lists say."""
    return df.select([c for c in df.columns if c in always or ((include is None or c in include) and c not in (exclude or []))])


