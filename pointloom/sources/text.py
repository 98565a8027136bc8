"""Delimited point files, factor tables and regions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.filters import geojson_polygons
from pointloom.session import small


def read_points(spark: SparkSession, path: str, columns: dict[str, int | str], sep: str = "\t", skip: int = 0, header: bool = False, scale: dict[str, float] | None = None, types: dict[str, str] | None = None, keep_quotes: bool = False, null: str | None = None) -> DataFrame:
    """Points of a delimited file, plain or gzipped.

    ``columns`` maps names to column numbers (from 0) or, with ``header``, to names
    in the file.  Lines that begin with # are comments unless that line is the
    header.  ``scale`` multiplies coordinates; x, y and z are doubles and ct an
    integer unless ``types`` says otherwise, others are text, ``null`` a token that
    means null.  A value that can't be read as its type is null.
    """
    lines = spark.read.text(path)
    if header:
        head = lines.limit(1 + skip).collect()[skip][0].lstrip("#")
        named = {n: i for i, n in enumerate(head.split(sep))}
        columns = {k: named[v] if isinstance(v, str) else v for k, v in columns.items()}
        lines = lines.where(F.ltrim("value") != head)
    if skip:
        first = [r[0] for r in lines.limit(skip).collect()]
        lines = lines.where(~F.col("value").isin(first))
    lines = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    width = max(int(i) for i in columns.values()) + 1
    if sep == "," and not keep_quotes:
        schema = ", ".join(f"_c{i} string" for i in range(width))
        row = F.from_csv("value", F.lit(schema), {"sep": sep, "quote": '"', "mode": "PERMISSIVE"})
        cell = lambda i: row[f"_c{i}"]
    else:
        parts = F.split("value", "\\" + sep if sep in "|.*+" else sep)
        cell = lambda i: F.get(parts, F.lit(i))
    kinds = {"x": "double", "y": "double", "z": "double", "ct": "int", **(types or {})}
    out = []
    for name, i in columns.items():
        v = F.nullif(cell(int(i)), F.lit(null)) if null is not None else cell(int(i))
        v = v.try_cast(kinds[name]) if name in kinds else v
        out.append((v * scale[name] if scale and name in scale else v).alias(name))
    return lines.select(*out)


def read_factors(spark: SparkSession, path: str, k: int, dictionary: DataFrame | None = None, sep: str = "\t") -> DataFrame:
    """A factor table with a header ``#x y [z] [feature] K1 P1 K2 P2 ...`` as ``x, y[, z][, feature], kp``.

    Fails on factors outside [0, k) and on probabilities that are not in [0, 1];
    features that the ``dictionary`` (``feature``) doesn't hold are dropped.
    """
    head = spark.read.text(path).first()[0].lstrip("#").split(sep)
    pairs = [n for n in range(1, len(head)) if f"K{n}" in head and f"P{n}" in head]
    names = {n: n for n in head if n in ("x", "y", "z", "feature")} | {f"{a}{n}": f"{a}{n}" for n in pairs for a in "KP"}
    t = read_points(spark, path, names, sep, header=True, types={**{f"K{n}": "int" for n in pairs}, **{f"P{n}": "double" for n in pairs}})
    for n in pairs:
        ok = F.col(f"K{n}").isNull() | ((F.col(f"K{n}") >= 0) & (F.col(f"K{n}") < k) & F.col(f"P{n}").between(0, 1))
        t = t.withColumn(f"K{n}", F.when(ok, F.col(f"K{n}")).otherwise(F.raise_error(F.concat(F.lit("bad factor: "), F.col(f"K{n}").cast("string"), F.lit(" "), F.col(f"P{n}").cast("string"))).cast("int")))
    kp = F.filter(F.array(*[F.struct(F.col(f"K{n}").alias("k"), F.col(f"P{n}").alias("p")) for n in pairs]), lambda e: e["k"].isNotNull())
    t = t.select(*[c for c in ("x", "y", "z", "feature") if c in head], kp.alias("kp"))
    return t.join(small(dictionary.select("feature").distinct()), "feature", "left_semi") if dictionary is not None and "feature" in head else t


def read_geojson(spark: SparkSession, path: str, name: str = "title", sample: str = "") -> DataFrame:
    """Rings of GeoJSON polygons: ``sample_id, polygon_id, part_index, ring``; the id is a property or the feature's number."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    data = json.loads(text)
    feats = data.get("features", [data]) if isinstance(data, dict) else data
    rows = []
    for i, f in enumerate(feats):
        who = str((f.get("properties") or {}).get(name, i)) if isinstance(f, dict) else str(i)
        rings = [r for poly in geojson_polygons(json.dumps(f)) for r in poly]
        rows += [(sample, who, k, [(float(x), float(y)) for x, y in ring]) for k, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "sample_id string, polygon_id string, part_index int, ring array<struct<x double, y double>>")


def rings_of_vertices(vertices: DataFrame, key: str = "cell_id", order: str | None = None) -> DataFrame:
    """Vertex rows (``key, x, y``) as rings, in ``order`` or as the file gives them."""
    v = vertices if order else vertices.withColumn("__n", F.monotonically_increasing_id())
    o = order or "__n"
    l = F.sort_array(F.collect_list(F.struct(F.col(o).alias("o"), "x", "y")))  # noqa: E741
    return v.groupBy(key).agg(F.transform(l, lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"))).alias("ring")).withColumnRenamed(key, "polygon_id")


def manifest(spark: SparkSession, path: str, readers) -> DataFrame:
    """Union of the samples of a list (``sample_id``, path, separated by a tab), each read by ``readers(path)``."""
    from pointloom.operators.joins import union_samples

    rows = [r[0].split("\t") for r in spark.read.text(path).where(~F.startswith("value", F.lit("#"))).collect()]
    return union_samples({r[0]: readers(r[1]) for r in rows if len(r) > 1})
