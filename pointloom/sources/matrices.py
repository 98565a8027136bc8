"""Sparse matrix folders (barcodes, features, matrix), unit files with their metadata, matrices in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.session import small


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 1; names lists are read as whole files, which keeps their order."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return t.where(F.length("line") > 0).select((F.col("i") + 1).alias("i"), F.rtrim("line").alias("line"))


def read_mex(spark: SparkSession, barcodes: str, features: str, matrix: str) -> DataFrame:
    """``barcode, feature_id, feature, ct`` of a matrix in coordinates (gene, barcode, count, from 1).

    Features that share a name are told apart by their id: all but the first get
    ``name_id``.
    """
    b = _numbered(spark, barcodes).select(F.col("i").alias("bi"), F.col("line").alias("barcode"))
    f = _numbered(spark, features).select(F.col("i").alias("gi"), F.split("line", "\t").alias("p"))
    f = f.select("gi", F.col("p")[0].alias("feature_id"), F.coalesce(F.get("p", F.lit(1)), F.col("p")[0]).alias("name"))
    first = f.groupBy("name").agg(F.min("gi").alias("g0"))
    f = f.join(small(first), "name").select("gi", "feature_id", F.when(F.col("gi") == F.col("g0"), F.col("name")).otherwise(F.concat_ws("_", "name", "feature_id")).alias("feature"))
    lines = spark.read.text(matrix).where(~F.startswith("value", F.lit("%")))
    m = lines.select(F.split("value", r"\s+").alias("p"))
    m = m.select(*[F.col("p")[i].try_cast("long").alias(n) for i, n in enumerate(("gi", "bi", "ct"))])
    m = _without_first(lines, m)
    return m.where("ct is not null").join(small(f), "gi").join(b, "bi").select("barcode", "feature_id", "feature", "ct")


def _without_first(lines: DataFrame, m: DataFrame) -> DataFrame:
    """The entries without the line of sizes, which comes first."""
    head = lines.first()[0].split()
    size = [int(v) for v in head[:3]]
    t = m.withColumn("__n", F.monotonically_increasing_id())
    at = t.where((F.col("gi") == size[0]) & (F.col("bi") == size[1]) & (F.col("ct") == size[2])).agg(F.min("__n")).first()[0]
    return t.where(F.col("__n") != at).drop("__n")


def read_units(spark: SparkSession, data: str, meta: str, modality: int = 0) -> DataFrame:
    """Units of a text file as ``<header columns>, feature, ct``, one row for each feature.

    A line holds the header columns, then for each modality the number of features
    and the total, then for each modality ``index count`` pairs; fields are
    separated by tabs, the numbers of a pair by a blank.
    """
    info = json.loads(spark.read.text(meta, wholetext=True).first()[0])
    head, n_mod, off = info["header_info"], info.get("n_modalities", 1), info["offset_data"]
    names = spark.createDataFrame([(int(i), n) for n, i in info["dictionary"].items()], "i int, feature string")
    t = spark.read.text(data).select(F.split("value", "\t").alias("p"))
    used = [F.get("p", F.lit(off + 2 * k)).cast("int") for k in range(n_mod)]
    begin = F.lit(off + 2 * n_mod)
    for k in range(modality):
        begin = begin + used[k]
    pairs = F.slice("p", begin + 1, used[modality])
    t = t.select(*[F.get("p", F.lit(i)).alias(h) for i, h in enumerate(head)], F.explode(pairs).alias("e"))
    t = t.select(*head, F.split("e", " ")[0].cast("int").alias("i"), F.split("e", " ")[1].cast("int").alias("ct"))
    return t.join(small(names), "i").drop("i")


def write_units(units: DataFrame, path: str, unit: list[str], feature: str = "feature", count: str = "ct", seed: int = 0) -> dict:
    """Write units in that text form in the order of their random key; returns (and writes beside) the metadata."""
    from pointloom.operators.aggregates import sparse_rows

    spark = units.sparkSession
    names = [r[0] for r in units.select(feature).distinct().orderBy(feature).collect()]  # the dictionary
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "f string, i int")
    t = sparse_rows(units.join(small(index), units[feature] == index["f"]).select(*unit, F.lpad("i", 9, "0").alias("feature"), F.col(count).alias("ct")), unit, seed=seed)
    pairs = F.concat_ws("\t", F.transform("pairs", lambda e: F.concat_ws(" ", e["feature"].cast("int").cast("string"), e["ct"].cast("string"))))
    line = F.concat_ws("\t", "random_key", *[F.col(c).cast("string") for c in unit], F.lit("0"), F.col("n_features").cast("string"), F.col("total").cast("string"), pairs)
    t.orderBy("random_key").select(line.alias("value")).write.mode("overwrite").text(path)
    meta = {"n_units": t.count(), "n_features": len(names), "n_modalities": 1, "offset_data": 2 + len(unit), "header_info": ["random_key", *unit, "layer"], "dictionary": {n: i for i, n in enumerate(names)}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")
    return meta


def read_matrix(spark: SparkSession, path: str, row: str = "Feature", sep: str = "\t") -> DataFrame:
    """A dense table with a name column and one column for each factor, as ``feature, factor, n``."""
    t = spark.read.csv(path, sep=sep, header=True, inferSchema=True)
    first = t.columns[0] if row not in t.columns else row
    values = [c for c in t.columns if c != first]
    out = t.withColumnRenamed(first, "feature").unpivot(["feature"], values, "factor", "n")
    return out.where("n != 0")


def write_matrix(cells: DataFrame, path: str, row: str = "feature", col: str = "factor", value: str = "n", sep: str = "\t") -> None:
    """Long cells as a dense table, one column for each value of ``col`` (few)."""
    names = [r[0] for r in cells.select(col).distinct().orderBy(col).collect()]
    wide = cells.groupBy(row).pivot(col, names).agg(F.sum(value)).fillna(0)
    wide.write.mode("overwrite").csv(path, sep=sep, header=True)
