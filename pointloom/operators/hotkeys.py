"""Per-key counts, totals and exact quantiles when a few keys hold most rows.

Counts and totals are mergeable, so they are added up before the shuffle and a
hot key costs one row for each input task.  Quantiles are found by distributed
selection: each round counts the values of every open (key, quantile) interval
in ``BINS`` equal bins, keeps the bin that holds the wanted rank with its least
and greatest value as the next interval, and ends when these two are equal.
Values of a key are never gathered, sorted or sent anywhere; what moves is at
most ``BINS`` counters for each open interval and input task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.session import BROADCAST_ROWS, materialize, small

BINS = 512
#: A key with more than one in so many of all values is heavy: there are fewer of them than that, so they are always broadcast.
HEAVY = 10_000


def key_profile(df: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """``key, n_rows, n_values, total`` and for each quantile q a column ``q<100 q>``, one row for each key.

    A quantile is the value of rank ``ceil(q n)`` (at least 1) among the key's
    values, an element of the data.  A null key is a key of its own.  Null and
    NaN values count in ``n_rows`` only; a key with no value has null total and
    quantiles.  Infinite values are values.  An empty table gives no rows.
    """
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    rows = df.select(F.col(key).alias("k"), F.when(v.isNotNull(), F.col(value)).alias("raw"), v.alias("v"))
    first = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_values"), F.sum("raw").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    first = materialize(first)
    qs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles)])
    state = first.where("n_values > 0").select("k", "lo", "hi", F.explode(qs).alias("t"), "n_values")
    state = state.select("k", "n_values", F.col("t.i").alias("i"), F.greatest(F.lit(1), F.ceil(F.col("t.q") * F.col("n_values"))).cast("long").alias("rank"), "lo", "hi")
    found = state.where("lo = hi")
    state = state.where("lo < hi")
    n_all = first.agg(F.sum("n_values")).first()[0] or 0
    while quantiles and (n := state.count()):
        state = materialize(refine(rows.where("v is not null"), state, n <= BROADCAST_ROWS, n_all))
        found = found.unionByName(state.where("lo = hi"))
        state = state.where("lo < hi")
    names = [f"q{q * 100:g}".replace(".", "_") for q in quantiles]
    wide = found.groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col("lo"))).alias(n) for i, n in enumerate(names)]) if quantiles else None
    out = first.drop("lo", "hi")
    if wide is not None:
        out = out.join(small(wide).withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left").drop("k2")
    return out.withColumnRenamed("k", key)


def refine(rows: DataFrame, state: DataFrame, few: bool, n_all: int, weight: str | None = None) -> DataFrame:
    """One round: the interval, rank and bounds of each open quantile within its next bin.

    ``few``: the intervals fit a broadcast.  If not, those of heavy keys still do,
    and only rows of the other keys, of which none has many, are shuffled by key.
    """
    s = state.select(F.col("k").alias("sk"), F.col("n_values").alias("sn"), "i", "rank", F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    on = F.col("k").eqNullSafe(F.col("sk")) & (F.col("v") >= F.col("slo")) & (F.col("v") <= F.col("shi"))
    if few:
        hit = rows.join(F.broadcast(s), on)
    else:
        heavy = F.broadcast(s.where(F.col("sn") * HEAVY > n_all))
        hit = rows.join(heavy, on).unionByName(rows.join(heavy, F.col("k").eqNullSafe(F.col("sk")), "left_anti").join(s.where(F.col("sn") * HEAVY <= n_all), on))
    # halves, so that the width of an interval can't overflow
    width = F.col("shi") / 2 - F.col("slo") / 2
    part = (F.col("v") / 2 - F.col("slo") / 2) / F.when(width > 0, width)
    step = F.when(F.col("v") == F.col("slo"), 0).when(F.col("v") == F.col("shi"), BINS - 1)
    step = F.coalesce(step, F.when(F.isnan(part) | part.isNull(), BINS // 2).otherwise(F.least(F.floor(part * BINS), F.lit(BINS - 1)))).cast("int")
    bins = hit.groupBy("k", "i", "rank", F.col("sn").alias("n_values"), step.alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    below = F.sum("c").over(Window.partitionBy("k", "i").orderBy("bin"))  # at most BINS rows a window
    bins = bins.withColumn("upto", below).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
    return bins.select("k", "n_values", "i", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), "lo", "hi")


def median_mad(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, median, mad``: each key's median, and the median distance from it; both by selection, so no key's values are gathered.

    Medians are elements of the data (the lower of two middle ones).  Keys without a value have null in both.
    """
    mid = key_profile(df, key, value, (0.5,)).select(F.col(key).alias("k2"), F.col("q50").alias("median"))
    mid = materialize(mid)
    far = df.join(small(mid), F.col(key).eqNullSafe(F.col("k2"))).select(F.col("k2").alias("k3"), F.abs(F.col(value).cast("double") - F.col("median")).alias("far"))
    out = key_profile(far, "k3", "far", (0.5,)).select("k3", F.col("q50").alias("mad"))
    return mid.join(small(out), F.col("k2").eqNullSafe(F.col("k3"))).select(F.col("k2").alias(key), "median", "mad")


def heavy_keys(rows: DataFrame, key: str, parts: int, amount: str | None = None) -> DataFrame:
    """``key, amount``: keys that hold at least ``1/parts`` of all rows, or of the sum of ``amount``.

    Laid out in order of a code of their key, rows at every ``1/parts`` of the whole
    hit each such key.  These ranks are selected exactly by rounds of mergeable
    histograms (``refine``) over amounts added up by key before the shuffle; the
    keys they hit are then held against the bound.  Null keys, and null and
    negative amounts, count for nothing; without any amount there is no such key.
    """
    w = F.greatest(F.coalesce(F.col(amount).cast("decimal(38,0)"), F.lit(0)), F.lit(0)) if amount else F.lit(1)
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(w).cast("decimal(38,0)").alias("amount")).where("amount > 0")
    # a code is exact as a double; keys that share one are told apart by their amounts below
    sums = materialize(sums.withColumns({"k": F.lit(0), "v": F.shiftright(F.xxhash64(key), 11).cast("double")}))
    whole, lo, hi = sums.agg(F.sum("amount"), F.min("v"), F.max("v")).first()
    if not whole:
        return sums.select(key, "amount").limit(0)
    ranks = [(0, 1, i, -(-i * int(whole) // parts), lo, hi) for i in range(1, parts + 1)]
    state = sums.sparkSession.createDataFrame([(*r[:3], Decimal(r[3]), *r[4:]) for r in ranks], "k int, n_values long, i int, rank decimal(38,0), lo double, hi double")
    hit: set[float] = set()
    while open_ := [r for r in state.collect() if r["lo"] < r["hi"] or hit.add(r["lo"])]:  # at most one row for each part
        state = refine(sums, sums.sparkSession.createDataFrame(open_, state.schema), True, 1, "amount")
        state = state.select("k", "n_values", "i", F.col("rank").cast("decimal(38,0)").alias("rank"), "lo", "hi")
    return sums.where(F.col("v").isin(sorted(hit)) & (F.col("amount") * parts >= F.lit(whole))).select(key, "amount")
