"""Session set-up, shared storage for cut lineage, and small plan helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIXED = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}
#: What a null version counts as: later than any other.
_LATE = {"timestamp": "9999-12-31 23:59:59", "timestamp_ntz": "9999-12-31 23:59:59", "date": "9999-12-31"}
_WRITTEN: list[str] = []

#: Rows up to which a lookup table is broadcast; above it the join shuffles.
BROADCAST_ROWS = 200_000


def get_spark(app: str = "pointloom", cpus: int | None = None, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the cluster's own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("POINTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs on one machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, *partition: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/pointloom-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables ``materialize`` wrote in this process, once no result that reads them is needed; returns how many."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else unmarked (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, keys: list[str], version: str = "recv_ts") -> DataFrame:
    """One row for each record, the earliest version of it.

    Rows with a null in ``keys`` can't be told to be copies and are all kept.
    Copies are taken to be equal but for ``version``, so any of them would do;
    taking the first by ``version`` keeps the result the same in every run.
    """
    rest = [c for c in df.columns if c not in keys]
    lone = F.lit(False)
    for k in keys:
        lone = lone | F.col(k).isNull()
    groups = df.withColumn("__lone", F.when(lone, F.monotonically_increasing_id())).groupBy(*keys, "__lone")
    kinds = dict(df.dtypes)
    if version in rest and kinds[version] in _LATE and all(kinds[c] in _FIXED for c in rest):
        # buffers of fixed width: Spark aggregates by hash; min_by leaves out rows whose order is null
        order = F.coalesce(version, F.lit(_LATE[kinds[version]]).cast(kinds[version]))
        return groups.agg(*[F.min(c).alias(c) if c == version else F.min_by(c, order).alias(c) for c in rest]).select(*df.columns)
    if not rest:
        return groups.agg(F.count(F.lit(1))).select(*df.columns)
    order = [version] if version in rest else []
    packed = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return groups.agg(packed.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def feature_name(col):
    """Names of features compare after trimming blanks and lower-casing."""
    return F.lower(F.trim(col))
