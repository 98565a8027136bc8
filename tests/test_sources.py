import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import filters, joins
from pointloom.sources import matrices, text, tiled
from pointloom.streaming import ingest


def test_points_text(spark, tmp_path):
    f = tmp_path / "p.tsv.gz"
    f.write_bytes(gzip.compress(b"#x\ty\tgene\tcount\n1.5\t-2\tA\t1\n3\tbad\tB\t2\n"))
    t = text.read_points(spark, str(f), {"x": "x", "y": "y", "feature": "gene", "ct": "count"}, header=True, scale={"x": 2.0})
    assert [tuple(r) for r in t.collect()] == [(3.0, -2.0, "A", 1), (6.0, None, "B", 2)]
    c = tmp_path / "p.csv"
    c.write_text('junk\n1,2,"a,b"\n')
    assert [tuple(r) for r in text.read_points(spark, str(c), {"x": 0, "y": 1, "feature": 2}, sep=",", skip=1).collect()] == [(1.0, 2.0, "a,b")]


def test_factor_table(spark, tmp_path):
    f = tmp_path / "f.tsv"
    f.write_text("#x\ty\tz\tfeature\tK1\tP1\tK2\tP2\n1.25\t2.5\t3.5\tgene_a\t1\t.75\t2\t.25\n11.25\t2.5\t4.5\tunknown\t0\t.8\t3\t.2\n12.25\t3.5\t5.5\tgene_b\t3\t.6\t0\t.4\n")
    d = spark.createDataFrame([("gene_b",), ("gene_a",)], "feature string")
    rows = text.read_factors(spark, str(f), 4, d).orderBy("x").collect()
    assert [(r.x, r.feature, [(e.k, e.p) for e in r.kp]) for r in rows] == [(1.25, "gene_a", [(1, 0.75), (2, 0.25)]), (12.25, "gene_b", [(3, 0.6), (0, 0.4)])]
    with pytest.raises(Exception, match="bad factor"):
        text.read_factors(spark, str(f), 3).collect()


def test_geojson(spark, tmp_path):
    f = tmp_path / "r.json"
    square = [[0, 0], [20, 0], [20, 5], [0, 5], [0, 0]]
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"title": "a"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square]]}}]}))
    rings = text.read_geojson(spark, str(f), sample="s")
    pts = spark.createDataFrame([(1, "s", 1.0, 1.0), (2, "s", 8.0, 8.0), (3, "s", 11.0, 1.0)], "point_id long, sample_id string, x double, y double")
    assert sorted(r.point_id for r in filters.in_polygons(pts, rings).collect()) == [1, 3]
    assert filters.normal_ring([(0, 0), (1, 0), (2, 0), (2, 2), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert filters.self_intersects([(0, 0), (2, 2), (2, 0), (0, 2)]) and not filters.self_intersects([(0, 0), (2, 0), (2, 2), (0, 2)])


def test_tiled_storage(spark, tmp_path):
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-30, 30, (400, 2)))], "i int, x double, y double")
    tiled.write_tiles(p, str(tmp_path / "t"), 2.0, 4, {"K": 3})
    got = tiled.read_tiles(spark, str(tmp_path / "t"), [(-5, 5, -5, 5)])
    want = {r.i for r in p.where("x >= -5 and x < 5 and y >= -5 and y < 5").collect()}
    assert {r.i for r in got.collect()} == want
    assert tiled.tile_meta(spark, str(tmp_path / "t"))["K"] == 3
    assert tiled.print_index(spark, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 400


def test_mex_and_units(spark, tmp_path):
    (tmp_path / "b").write_text("AA\nCC\n")
    (tmp_path / "f").write_text("g1\tX\ng2\tX\ng3\tY\n")
    (tmp_path / "m").write_text("%%MatrixMarket\n%\n3 2 3\n1 1 5\n2 2 1\n3 2 3\n")
    m = matrices.read_mex(spark, *(str(tmp_path / n) for n in "bfm"))
    assert sorted((r.barcode, r.feature, r.ct) for r in m.collect()) == [("AA", "X", 5), ("CC", "X_g2", 1), ("CC", "Y", 3)]
    matrices.write_units(m, str(tmp_path / "u"), ["barcode"])
    back = matrices.read_units(spark, str(tmp_path / "u"), str(tmp_path / "u.meta"))
    assert sorted((r.barcode, r.feature, r.ct) for r in back.collect()) == [("AA", "X", 5), ("CC", "X_g2", 1), ("CC", "Y", 3)]
    pos = spark.createDataFrame([("AA", 1, 10.0, 20.0), ("CC", 0, 1.0, 2.0)], "barcode string, in_tissue int, x double, y double")
    idx = spark.createDataFrame([(1, 1, 5), (2, 2, 1)], "gene_idx int, barcode_idx int, ct int")
    names = spark.createDataFrame([(1, "AA"), (2, "CC")], "barcode_idx int, barcode string")
    genes = spark.createDataFrame([(1, "X"), (2, "mt-Y")], "gene_idx int, feature string")
    assert [tuple(r) for r in joins.matrix_points(idx, names, pos, genes, 0.5, exclude="^mt").collect()] == [(5.0, 10.0, "X", 5)]


def test_images_and_archives(spark, tmp_path):
    anno = spark.createDataFrame([(0, 0, [(0, 0.5), (1, 0.5)]), (1, 0, [(1, 1.0)])], "px int, py int, kp array<struct<k:int,p:double>>")
    data = tiled.draw_factors(anno, {0: "#ff0000", 1: "#0000ff"}, 1, (0, 2, 0, 1))
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    pts = spark.createDataFrame([(float(i * 1e6), float(-i * 1e6), f"f{i}", i) for i in range(15)], "x double, y double, feature string, ct int")
    n = tiled.write_pmtiles(tiled.point_tiles(pts, 3, "points", ["feature", "ct"]), str(tmp_path / "a.pmtiles"), {"name": "test"})
    meta, tiles = tiled.read_pmtiles(str(tmp_path / "a.pmtiles"))
    assert meta == {"name": "test"} and len(tiles) == n and [i for i, _ in tiles] == sorted(i for i, _ in tiles)
    assert all(b"points" in gzip.decompress(d) for _, d in tiles)
    assert len({tiled.tile_number(3, x, y) for x in range(8) for y in range(8)}) == 64 and tiled.tile_number(1, 0, 0) == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "a", 1.0, 1.0, 2, "2024-01-01 00:10:00"), (1, "a", 1.0, 1.0, 2, "2024-01-01 00:10:00"), (2, "b", 90.0, 1.0, 1, "2024-01-01 01:10:00")]
    df = spark.createDataFrame(rows, "point_id long, feature string, x double, y double, ct int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(src))
    stream = ingest.latest_once(ingest.stream_points(spark, str(src), df.schema.simpleString()[7:-1].replace(":", " ")), "point_id", "t")
    ingest.append_tiles(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 10.0).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    seen = []
    w = ingest.stream_points(spark, str(src), df.schema.simpleString()[7:-1].replace(":", " "))
    ingest.each_batch(w, str(tmp_path / "ck2"), lambda b, i: seen.append(b.count())).awaitTermination(60)
    assert sum(seen) == 3


def test_polygon_tiles_and_export(spark, tmp_path):
    from pointloom.sources import maptiles

    ring = [(-1e6, -1e6), (1.5e6, -1e6), (1.5e6, 1.2e6), (-1e6, 1.2e6)]
    df = spark.createDataFrame([("a", ring), ("flat", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), ("none", None)], "name string, ring array<struct<x double, y double>>")
    tiles = maptiles.polygon_tiles(df, 2, "shapes", ["name"]).collect()
    assert {(t.x, t.y) for t in tiles} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    scale, total = 4096 * 4 / (2 * 20037508.342789244), 0.0
    for t in tiles:
        for _, kind, (part,), props, extent in maptiles.decode_tile(bytes(t["data"])):
            assert kind == 3 and props == {"name": "a"} and extent == 4096
            cut = maptiles.clip([(float(x), float(y)) for x, y in part], 0, 0, 4096, 4096)
            total += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(cut, cut[1:] + cut[:1])) / 2
    assert abs(total / (2.5e6 * 2.2e6 * scale**2) - 1) < 0.01
    pts = spark.createDataFrame([(i, float(i * 1e5), float(-i * 1e5), f"f{i}", i, 0.5 * i) for i in range(30)], "point_id int, x double, y double, feature string, ct int, w double")
    enc = tiled.point_tiles(pts, 6, "points", ["feature", "ct", "w"])
    tiled.write_pmtiles(enc, str(tmp_path / "p.pmtiles"))
    back = maptiles.export_tiles(maptiles.archive_table(spark, str(tmp_path / "p.pmtiles")), {"feature": "string", "ct": "bigint", "w": "double"}, 6).orderBy("ct").collect()
    assert [(r.feature, r.ct, r.w) for r in back] == [(f"f{i}", i, 0.5 * i) for i in range(30)]
    assert max(abs(r.x - i * 1e5) for i, r in enumerate(back)) < 200
    for n in range(90):
        maptiles.place(n)
    small = maptiles.sized_pyramid(pts, 3, 0, "points", ["ct"], 5, 1000).collect()
    assert {t.z for t in small} == {0, 1, 2, 3} and all(len(maptiles.decode_tile(bytes(t["data"]))) <= 6 for t in small if t.z == 0)
    tiles = maptiles.tile_image(np.zeros((300, 500, 3), np.uint8), 1)
    assert sorted((z, x, y) for z, x, y, _ in tiles) == [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]


def test_sized_pyramid_keeps_sparse_tiles_and_both_limits(spark):
    """A tile with most rows doesn't empty the others, and no tile exceeds a limit."""
    from pointloom.sources import maptiles

    rng = np.random.default_rng(1)
    rows = [(i, 1e6 + float(i), 1e6, f"{rng.integers(1 << 60):x}") for i in range(400)]
    rows += [(1000 + i, -19e6 + 2.5e6 * (i % 16), -19e6 + 2.5e6 * (i // 16), f"{rng.integers(1 << 60):x}") for i in range(256)]
    pts = spark.createDataFrame(rows, "point_id int, x double, y double, name string")
    shown = {}
    for t in maptiles.sized_pyramid(pts, 4, 0, "points", ["name"], 40, 700).collect():
        names = {f[3]["name"] for f in maptiles.decode_tile(bytes(t["data"]))}
        shown[t.z, t.x, t.y] = names
        if t.z < 4:
            assert 1 <= len(names) <= 40 and (len(t["data"]) <= 700 or len(names) == 1)
    for z in range(4, 0, -1):
        assert {(x // 2, y // 2) for k, x, y in shown if k == z} == {(x, y) for k, x, y in shown if k == z - 1}
        below = set().union(*(v for k, v in shown.items() if k[0] == z))
        assert all(v <= below for k, v in shown.items() if k[0] == z - 1)
    assert len({k for k in shown if k[0] == 3}) == 64
