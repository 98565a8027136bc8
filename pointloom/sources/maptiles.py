"""Polygons in map tiles, tiles read back, pyramids by size, low-resolution maps."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.functions.grid import EARTH, mercator
from pointloom.operators.groups import apply_groups
from pointloom.operators.joins import nearest_anchor
from pointloom.session import materialize, small
from pointloom.sources.tiled import mvt, point_tiles, read_pmtiles, tile_number


def clip(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """The part of a ring inside a box, side by side (Sutherland-Hodgman)."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out: list[tuple[float, float]] = []
        for a, b in zip(ring[-1:] + ring[:-1], ring):
            ia, ib = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if ia != ib:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                p = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                p[axis] = bound
                out.append((p[0], p[1]))
            if ib:
                out.append(b)
        ring = out
        if not ring:
            break
    return ring


def polygon_tiles(rings: DataFrame, zoom: int, layer: str, properties: list[str], extent: int = 4096, buffer: int = 64, clipping: bool = True, duplicates: bool = True) -> DataFrame:
    """Encoded polygon tiles ``z, x, y, data`` of rings (``ring`` in Web Mercator metres).

    A ring goes to each tile its box touches, with ``buffer`` units around tiles,
    and is cut to it; without ``clipping`` it is written whole, without
    ``duplicates`` only to the tile of its box's centre.
    """
    side = float(extent << zoom)
    most = (1 << zoom) - 1
    gx = F.transform("ring", lambda p: (p["x"] + EARTH) / (2 * EARTH) * side)
    gy = F.transform("ring", lambda p: (F.lit(EARTH) - p["y"]) / (2 * EARTH) * side)
    t = rings.where(F.size("ring") >= 3).select(*properties, gx.alias("gx"), gy.alias("gy"))
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(c / extent)))
    if duplicates:
        span = lambda c: F.sequence(inside(F.array_min(c) - buffer), inside(F.array_max(c) + buffer))
        t = t.withColumn("tx", F.explode(span("gx"))).withColumn("ty", F.explode(span("gy")))
    else:
        middle = lambda c: inside((F.array_min(c) + F.array_max(c)) / 2)
        t = t.withColumns({"tx": middle("gx"), "ty": middle("gy")})

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.tx.iloc[0]) * extent, int(pdf.ty.iloc[0]) * extent
        feats = []
        for gx_, gy_, props in zip(pdf.gx, pdf.gy, pdf[properties].to_dict("records")):
            ring = [(float(a) - x0, float(b) - y0) for a, b in zip(gx_, gy_)]
            if clipping:
                ring = clip(ring, -buffer, -buffer, extent + buffer, extent + buffer)
            pts = [(round(a), round(b)) for a, b in ring]
            pts = [p for i, p in enumerate(pts) if p != pts[i - 1]]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))
            if len(pts) >= 3 and area:
                feats.append((3, [pts if area > 0 else pts[::-1]], props))
        return pdf.head(1)[["tx", "ty"]].assign(data=gzip.compress(mvt(layer, feats, extent), 6, mtime=0)) if feats else pd.DataFrame()

    out = apply_groups(t, ["tx", "ty"], encode, "tx bigint, ty bigint, data binary")
    return out.select(F.lit(zoom).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), "data")


def decode_tile(data: bytes) -> list[tuple[str, int, list[list[tuple[int, int]]], dict, int]]:
    """Features of a vector tile: layer, kind, parts, properties, extent."""

    def fields(b: bytes):
        i = 0
        while i < len(b):
            key, i = number(b, i)
            if key & 7 == 0:
                v, i = number(b, i)
            elif key & 7 == 1:
                v, i = b[i : i + 8], i + 8
            elif key & 7 == 5:
                v, i = b[i : i + 4], i + 4
            else:
                n, i = number(b, i)
                v, i = b[i : i + n], i + n
            yield key >> 3, v

    def number(b: bytes, i: int) -> tuple[int, int]:
        v = s = 0
        while True:
            v |= (b[i] & 127) << s
            s += 7
            i += 1
            if b[i - 1] < 128:
                return v, i

    def packed(b: bytes) -> list[int]:
        out, i = [], 0
        while i < len(b):
            v, i = number(b, i)
            out.append(v)
        return out

    def value(b: bytes):
        for k, v in fields(b):
            return {1: lambda: v.decode(), 2: lambda: struct.unpack("<f", v)[0], 3: lambda: struct.unpack("<d", v)[0], 6: lambda: (v >> 1) ^ -(v & 1), 7: lambda: bool(v)}.get(k, lambda: v)()

    signed = lambda n: (n >> 1) ^ -(n & 1)
    out = []
    for k, layer in fields(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
        if k != 3:
            continue
        parts = list(fields(layer))
        name = next(v.decode() for n, v in parts if n == 1)
        keys, values = [v.decode() for n, v in parts if n == 3], [value(v) for n, v in parts if n == 4]
        extent = next((v for n, v in parts if n == 5), 4096)
        for n, f in parts:
            if n != 2:
                continue
            feature = dict(fields(f))
            tags, geo = packed(feature.get(2, b"")), packed(feature.get(4, b""))
            rings, at, i = [], (0, 0), 0
            while i < len(geo):
                command, count = geo[i] & 7, geo[i] >> 3
                i += 1
                if command == 7:
                    continue
                for _ in range(count):
                    at = (at[0] + signed(geo[i]), at[1] + signed(geo[i + 1]))
                    i += 2
                    if command == 1:
                        rings.append([at])
                    else:
                        rings[-1].append(at)
            out.append((name, feature.get(3, 1), rings, {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}, extent))
    return out


def export_tiles(encoded: DataFrame, properties: dict[str, str], zoom: int | None = None) -> DataFrame:
    """Point features of encoded tiles as ``x, y`` (Web Mercator metres) and typed properties; absent ones are null."""
    t = encoded.where(F.col("z") == zoom) if zoom is not None else encoded
    schema = "x double, y double" + "".join(f", `{n}` {k}" for n, k in properties.items())

    def run(batches):
        for pdf in batches:
            rows = []
            for z, tx, ty, data in zip(pdf.z, pdf.x, pdf.y, pdf["data"]):
                for _, kind, parts, props, extent in decode_tile(bytes(data)):
                    if kind == 1:
                        side = extent << int(z)
                        for (u, v), *_ in parts:
                            x = (tx * extent + u + 0.5) / side * 2 * EARTH - EARTH
                            rows.append((x, EARTH - (ty * extent + v + 0.5) / side * 2 * EARTH, *[props.get(p) for p in properties]))
            yield pd.DataFrame(rows, columns=["x", "y", *properties])

    return t.mapInPandas(run, schema)


def archive_table(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of an archive as a table ``z, x, y, data``."""
    _, found = read_pmtiles(path)
    rows = [(*place(n), data) for n, data in found]
    return spark.createDataFrame(rows, "z int, x long, y long, data binary")


def place(n: int) -> tuple[int, int, int]:
    """Zoom and tile of a number in the order of archives: the inverse of ``tile_number``."""
    z = 0
    while n >= 4**z:
        n -= 4**z
        z += 1
    x = y = 0
    s, t = 1, n
    while s < 1 << z:
        rx = 1 & (t // 2)
        ry = 1 & (t ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, t, s = x + s * rx, y + s * ry, t // 4, s * 2
    assert tile_number(z, x, y) == n + sum(4**i for i in range(z))
    return z, x, y


def sized_pyramid(points: DataFrame, zoom: int, lowest: int, layer: str, properties: list[str], most_rows: int, most_bytes: int, key: str = "point_id") -> DataFrame:
    """Encoded tiles for all zooms; below the highest, rows are thinned until each tile keeps to both limits.

    Each tile of a level keeps the share of its rows that the fullest one would
    allow, in the order of a hash of the key and at least one, so that what shows at
    a zoom also shows at the next; a tile still too large loses its last rows by
    that hash, never all of them.
    """
    rows, out = points.withColumn("__h", F.xxhash64(key)), point_tiles(points, zoom, layer, properties)
    for z in range(zoom - 1, lowest - 1, -1):
        m = mercator("x", "y", z)
        tile = Window.partitionBy("__tx", "__ty")
        rows = rows.withColumns({"__tx": m["tx"], "__ty": m["ty"]})
        rows = materialize(rows.withColumns({"__r": F.row_number().over(tile.orderBy("__h", key, "x", "y")), "__n": F.count(F.lit(1)).over(tile)}))
        fullest = rows.agg(F.max("__n")).first()[0] or 0
        worst = point_tiles(rows, z, layer, properties).select(F.max(F.length("data"))).first()[0] or 0
        share = min(1.0, most_rows / max(1, fullest), most_bytes / max(1, worst))
        rows = rows.where(F.col("__r") <= F.greatest(F.lit(1), F.least(F.lit(most_rows), F.floor(F.col("__n") * share + 1e-9))))
        tiles = materialize(_fitted(rows, z, layer, properties, most_bytes))
        out = out.unionByName(tiles.select("z", "x", "y", "data"))
        kept = small(tiles.select(F.col("x").alias("__tx"), F.col("y").alias("__ty"), "kept"))
        rows = rows.join(kept, ["__tx", "__ty"]).where("__r <= kept").drop("__tx", "__ty", "__r", "__n", "kept")
    return out


def _fitted(rows: DataFrame, zoom: int, layer: str, properties: list[str], most_bytes: int, extent: int = 4096) -> DataFrame:
    """Point tiles ``z, x, y, data, kept`` of the first ``kept`` rows by ``__r``: as many as ``most_bytes`` takes, at least one."""
    m = mercator("x", "y", zoom, extent)
    t = rows.select(m["tx"].alias("tx"), m["ty"].alias("ty"), m["px"].cast("int").alias("u"), m["py"].cast("int").alias("v"), "__r", *properties)

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r")
        feats = [(1, [[(u, v)]], p) for u, v, p in zip(pdf.u.tolist(), pdf.v.tolist(), pdf[properties].to_dict("records"))]
        n = len(feats)
        while len(data := gzip.compress(mvt(layer, feats[:n], extent), 6, mtime=0)) > most_bytes and n > 1:
            n = max(1, min(n - 1, int(n * 0.95 * most_bytes / len(data))))
        return pdf.head(1)[["tx", "ty"]].assign(data=data, kept=n)

    out = apply_groups(t, ["tx", "ty"], encode, "tx bigint, ty bigint, data binary, kept int")
    return out.select(F.lit(zoom).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), "data", "kept")


def lowres_map(points: DataFrame, units: DataFrame, radius: float, scale: float, by: list[str] = ()) -> DataFrame:
    """``u, v, factor, n``: screen pixels by the factor of the nearest unit (``anchor_id, x, y, layer``) within ``radius``."""
    near = nearest_anchor(points, units, radius, by).select("point_id", "layer")
    p = points.join(near, "point_id").groupBy(F.floor(F.col("x") / scale).alias("u"), F.floor(F.col("y") / scale).alias("v"), F.col("layer").alias("factor")).agg(F.count(F.lit(1)).alias("n"))
    best = p.groupBy("u", "v").agg(F.max(F.struct("n", (-F.col("factor")).alias("f"))).alias("m"))
    return best.select("u", "v", (-F.col("m.f")).cast("int").alias("factor"), F.col("m.n").alias("n"))


def tile_image(rgb: np.ndarray, zoom: int, pixels: int = 256) -> list[tuple[int, int, int, bytes]]:
    """An image as PNG tiles of zooms ``zoom`` down to 0, each half the size of the one before (means of four)."""
    from pointloom.sources.tiled import png

    out = []
    for z in range(zoom, -1, -1):
        h, w = rgb.shape[:2]
        for y in range(-(-h // pixels)):
            for x in range(-(-w // pixels)):
                part = np.zeros((pixels, pixels, 3), np.uint8)
                cut = rgb[y * pixels : (y + 1) * pixels, x * pixels : (x + 1) * pixels]
                part[: cut.shape[0], : cut.shape[1]] = cut
                out.append((z, x, y, png(part)))
        padded = np.pad(rgb, ((0, h % 2), (0, w % 2), (0, 0)), mode="edge").astype(np.float64)
        rgb = ((padded[::2, ::2] + padded[1::2, ::2] + padded[::2, 1::2] + padded[1::2, 1::2]) / 4 + 0.5).astype(np.uint8)
    return out
