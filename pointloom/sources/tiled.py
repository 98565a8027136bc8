"""Tiled storage: Parquet partitioned by tile, with an index and metadata beside it; text, PNG and map-tile sinks."""

from __future__ import annotations

import gzip
import json
import math
import struct
import zlib
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.functions import pairs
from pointloom.operators import filters, tiles


def write_tiles(points: DataFrame, path: str, size: float, coarse: int = 16, meta: dict | None = None) -> None:
    """Write points by blocks of ``coarse`` x ``coarse`` tiles (one folder each), sorted by tile within.

    Rows of a block may go to several files, so a dense block is no single task.
    """
    t = tiles.assign(points, size)
    t = t.withColumns({"block_row": F.floor(F.col("tile_row") / coarse), "block_col": F.floor(F.col("tile_col") / coarse)})
    t = t.repartitionByRange("block_row", "block_col", "tile_row", "tile_col", "x").sortWithinPartitions("block_row", "block_col", "tile_row", "tile_col")
    t.write.mode("overwrite").partitionBy("block_row", "block_col").parquet(f"{path}/data")
    spark = points.sparkSession
    tiles.summary(points, size).write.mode("overwrite").parquet(f"{path}/index")
    spark.createDataFrame([(json.dumps({"tile_size": size, "coarse": coarse, **(meta or {})}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_tiles(spark: SparkSession, path: str, boxes: list[tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Tiled points, of which only folders and row groups that the boxes (xmin, xmax, ymin, ymax) touch are read."""
    meta = tile_meta(spark, path)
    t = spark.read.parquet(f"{path}/data")
    if boxes:
        wide = meta["tile_size"] * meta["coarse"]
        block = F.lit(False)
        for x0, x1, y0, y1 in boxes:
            block = block | (F.col("block_row").between(math.floor(y0 / wide), math.floor(y1 / wide)) & F.col("block_col").between(math.floor(x0 / wide), math.floor(x1 / wide)))
        t = filters.rectangles(t.where(block), boxes, meta["tile_size"])
    return t.drop("block_row", "block_col")


def tile_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def print_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index").orderBy("tile_row", "tile_col")


def dump_tsv(anno: DataFrame, path: str, k: int, coordinates: list[str], digits: int = 4, prob_digits: int = 4, null_k: str = "-1", null_p: str = "0") -> None:
    """Annotations as text with the columns K1 P1 ... and placeholders where there are fewer pairs."""
    out = [F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) for c in coordinates]
    full = pairs.placeholder("kp", k)
    for i in range(k):
        out.append(F.when(full[i]["k"] < 0, F.lit(null_k)).otherwise(full[i]["k"].cast("string")).alias(f"K{i + 1}"))
        out.append(F.when(full[i]["k"] < 0, F.lit(null_p)).otherwise(F.format_string(f"%.{prob_digits}f", full[i]["p"])).alias(f"P{i + 1}"))
    anno.select(*out).write.mode("overwrite").csv(path, sep="\t", header=True)


# ---------------------------------------------------------------- images


def png(rgb: np.ndarray) -> bytes:
    """An RGB image (height, width, 3 of uint8) as PNG."""
    h, w, _ = rgb.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = rgb.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def colour(text: str) -> tuple[int, int, int]:
    """#RRGGBB as three numbers."""
    t = text.strip().lstrip("#")
    if len(t) != 6:
        raise ValueError(f"not a colour: {text}")
    return int(t[:2], 16), int(t[2:4], 16), int(t[4:], 16)


def draw_factors(anno: DataFrame, colours: dict[int, str], scale: int, box: tuple[int, int, int, int], top_only: bool = False) -> bytes:
    """The pixels of a box (x0, x1, y0, y1), ``scale`` to a screen pixel, coloured by their factors' probabilities.

    Colours are mixed by sums over all pixels in Spark; only the image itself
    reaches the driver.
    """
    x0, x1, y0, y1 = box
    table = anno.sparkSession.createDataFrame([(k, *map(float, colour(c))) for k, c in colours.items()], "k int, r double, g double, b double")
    kp = pairs.top("kp", 1) if top_only else F.col("kp")
    t = anno.where((F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1))
    t = t.select(F.floor((F.col("px") - x0) / scale).alias("u"), F.floor((F.col("py") - y0) / scale).alias("v"), F.explode(kp).alias("e"))
    t = t.select("u", "v", F.col("e.k").alias("k"), F.col("e.p").alias("p")).join(F.broadcast(table), "k")
    s = t.groupBy("u", "v").agg(F.sum("p").alias("w"), *[F.sum(F.col("p") * F.col(c)).alias(c) for c in "rgb"]).toPandas()
    image = np.zeros((-(-(y1 - y0) // scale), -(-(x1 - x0) // scale), 3), np.uint8)
    if len(s):
        image[s.v.to_numpy(int), s.u.to_numpy(int)] = np.clip(s[["r", "g", "b"]].to_numpy() / np.maximum(s[["w"]].to_numpy(), 1e-12) + 0.5, 0, 255)
    return png(image)


def draw_features(points: DataFrame, colours: dict[str, str], scale: float, box: tuple[float, float, float, float], quantile: float = 0.99) -> bytes:
    """Density of some features in their colours, each brightest at its ``quantile`` of counts."""
    x0, x1, y0, y1 = box
    t = filters.rectangles(points, [box]).where(F.col("feature").isin(list(colours)))
    s = t.groupBy("feature", F.floor((F.col("x") - x0) / scale).alias("u"), F.floor((F.col("y") - y0) / scale).alias("v")).agg(F.sum("ct").alias("n")).toPandas()
    image = np.zeros((math.ceil((y1 - y0) / scale), math.ceil((x1 - x0) / scale), 3))
    for f, part in s.groupby("feature"):
        top = max(1.0, float(np.quantile(part.n, quantile)))
        image[part.v.to_numpy(int), part.u.to_numpy(int)] += np.minimum(1, part.n.to_numpy(float) / top)[:, None] * np.array(colour(colours[f]))
    return png(np.clip(image, 0, 255).astype(np.uint8))


# ---------------------------------------------------------------- map tiles


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, kind: int, data: bytes) -> bytes:
    return varint(number << 3 | kind) + (varint(len(data)) + data if kind == 2 else data)


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _field(7, 0, varint(int(v)))
    if isinstance(v, (int, np.integer)):
        return _field(6, 0, varint((int(v) << 1) ^ (int(v) >> 63)))
    if isinstance(v, (float, np.floating)):
        return _field(3, 1, struct.pack("<d", v))
    return _field(1, 2, str(v).encode())


def mvt(layer: str, features: Iterable[tuple[int, list[list[tuple[int, int]]], dict]], extent: int = 4096) -> bytes:
    """A vector tile with one layer: features are (1 point or 3 polygon, lists of vertices, properties)."""
    keys: dict[str, int] = {}
    values: dict = {}
    body = []
    zig = lambda n: (n << 1) ^ (n >> 31)
    for kind, parts, props in features:
        tags = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault((type(v), v), len(values))) for k, v in props.items() if v is not None)
        at, geo = (0, 0), []
        for part in parts:
            geo.append(1 | 1 << 3)
            geo += [zig(part[0][0] - at[0]), zig(part[0][1] - at[1])]
            at = part[0]
            if kind == 3:
                geo.append(2 | len(part[1:]) << 3)
                for p in part[1:]:
                    geo += [zig(p[0] - at[0]), zig(p[1] - at[1])]
                    at = p
                geo.append(7 | 1 << 3)
        body.append(_field(2, 2, _field(2, 2, tags) + _field(3, 0, varint(kind)) + _field(4, 2, b"".join(map(varint, geo)))))
    head = _field(15, 0, varint(2)) + _field(1, 2, layer.encode())
    tail = b"".join(_field(3, 2, k.encode()) for k in keys) + b"".join(_field(4, 2, _value(v)) for _, v in values) + _field(5, 0, varint(extent))
    return _field(3, 2, head + b"".join(body) + tail)


def tile_number(z: int, x: int, y: int) -> int:
    """Place of a tile in the order of archives: zooms in turn, a Hilbert curve within each."""
    n, d, s = sum(4**i for i in range(z)), 0, (1 << z) >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = (1 << z) - 1 - x, (1 << z) - 1 - y
            x, y = y, x
        s >>= 1
    return n + d


def point_tiles(points: DataFrame, zoom: int, layer: str, properties: list[str], extent: int = 4096) -> DataFrame:
    """Encoded point tiles ``z, x, y, data`` of points in Web Mercator metres, each tile made in one task."""
    from pointloom.functions.grid import mercator
    from pointloom.operators.groups import apply_groups

    shift = extent.bit_length() - 1
    m = mercator("x", "y", zoom, 1 << shift)
    t = points.select(m["tx"].alias("tx"), m["ty"].alias("ty"), m["px"].cast("int").alias("u"), m["py"].cast("int").alias("v"), *properties)

    def encode(pdf):
        rows = pdf[properties].to_dict("records")
        data = mvt(layer, ((1, [[(u, v)]], p) for u, v, p in zip(pdf.u.tolist(), pdf.v.tolist(), rows)), extent)
        return pdf.head(1)[["tx", "ty"]].assign(data=gzip.compress(data, 6, mtime=0))

    out = apply_groups(t, ["tx", "ty"], encode, "tx bigint, ty bigint, data binary")
    return out.select(F.lit(zoom).alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), "data")


def write_pmtiles(encoded: DataFrame, path: str, meta: dict | None = None, kind: int = 1) -> int:
    """An archive (version 3) of encoded tiles ``z, x, y, data``; tiles stream through the driver one by one.

    Returns the number of tiles.  The directory is one root directory followed by
    leaves of 4096 entries if there are more.
    """

    @F.pandas_udf(T.LongType())
    def number(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([tile_number(*v) for v in zip(z.tolist(), x.tolist(), y.tolist())], dtype="int64")

    rows = encoded.withColumn("n", number("z", "x", "y")).orderBy("n").select("n", "z", "data")
    entries, offset, zooms = [], 0, set()
    body = Path(path + ".body")
    with body.open("wb") as f:
        for r in rows.toLocalIterator():
            f.write(r["data"])
            entries.append((r["n"], offset, len(r["data"])))
            offset += len(r["data"])
            zooms.add(r["z"])

    def directory(es, leaf=False):
        out, last = varint(len(es)), 0
        for e in es:
            out += varint(e[0] - last)
            last = e[0]
        out += b"".join(varint(0 if leaf else 1) for _ in es) + b"".join(varint(e[2]) for e in es)
        for i, e in enumerate(es):
            out += varint(0 if i and e[1] == es[i - 1][1] + es[i - 1][2] else e[1] + 1)
        return gzip.compress(out, 6, mtime=0)

    leaves = b""
    root = directory(entries)
    if len(root) > 16000:
        heads = []
        for i in range(0, len(entries), 4096):
            d = directory(entries[i : i + 4096])
            heads.append((entries[i][0], len(leaves), len(d)))
            leaves += d
        root = directory(heads, True)
    about = gzip.compress(json.dumps(meta or {}).encode(), 6, mtime=0)
    at = [127, 127 + len(root)]
    at += [at[1] + len(about), at[1] + len(about) + len(leaves)]
    head = b"PMTiles\x03" + struct.pack("<QQQQQQQQQQQ", at[0], len(root), at[1], len(about), at[2], len(leaves), at[3], offset, len(entries), len(entries), len(entries))
    head += struct.pack("<BBBBBB", 1, 2, 2, kind, min(zooms, default=0), max(zooms, default=0)) + struct.pack("<iiii", -1800000000, -850000000, 1800000000, 850000000) + struct.pack("<Bii", min(zooms, default=0), 0, 0)
    with open(path, "wb") as f, body.open("rb") as src:
        f.write(head.ljust(127, b"\0") + root + about + leaves)
        while block := src.read(1 << 20):
            f.write(block)
    body.unlink()
    return len(entries)


def read_pmtiles(path: str) -> tuple[dict, list[tuple[int, bytes]]]:
    """Metadata and (number, data) of the tiles of an archive written by ``write_pmtiles``."""
    with open(path, "rb") as f:
        head = f.read(127)
        root_at, root_n, meta_at, meta_n, leaf_at, _, data_at, *_ = struct.unpack("<QQQQQQQQQQQ", head[8:96])

        def entries(at, n):
            f.seek(at)
            raw, i = gzip.decompress(f.read(n)), 0

            def number():
                nonlocal i
                v = s = 0
                while True:
                    b = raw[i]
                    i += 1
                    v |= (b & 127) << s
                    s += 7
                    if b < 128:
                        return v

            count = number()
            ids, runs, last = [], [], 0
            for _ in range(count):
                last += number()
                ids.append(last)
            runs = [number() for _ in range(count)]
            sizes = [number() for _ in range(count)]
            offs: list[int] = []
            for k in range(count):
                v = number()
                offs.append(offs[-1] + sizes[k - 1] if not v else v - 1)
            return list(zip(ids, runs, offs, sizes))

        found = []
        for i, run, off, size in entries(root_at, root_n):
            found += [(i, off, size)] if run else [(a, c, d) for a, _, c, d in entries(leaf_at + off, size)]
        f.seek(meta_at)
        meta = json.loads(gzip.decompress(f.read(meta_n)))
        out = []
        for i, off, size in found:
            f.seek(data_at + off)
            out.append((i, f.read(size)))
        return meta, out
