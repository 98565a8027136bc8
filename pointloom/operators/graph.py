"""Connected components of any number of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node of each node's component.

    Alternating large-star and small-star steps: each node links its larger (then
    its smaller) neighbours to the smallest it knows, which needs a logarithmic
    number of rounds; a hub's links are spread again in the next step.  Each round
    is written to the shared folder, so lineage stays short and lost executors
    cost one round.  Nodes without a link don't come out.
    """
    e = materialize(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = e.where("a != b")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = materialize(small.select("e.a", "e.b").where("a != b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return nodes.join(e, nodes["node"] == e["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
        before = now
