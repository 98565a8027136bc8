"""Expressions on arrays of (factor, probability) pairs: ``kp array<struct<k int, p double>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(ks: list[str], ps: list[str]) -> Column:
    """Columns K1, P1, K2, P2 ... as one array; pairs with a null or negative factor are left out."""
    both = F.array(*[F.struct(F.col(k).cast("int").alias("k"), F.col(p).cast("double").alias("p")) for k, p in zip(ks, ps)])
    return F.filter(both, lambda e: e["k"].isNotNull() & (e["k"] >= 0))


def top(kp, k: int) -> Column:
    """The k most probable pairs, the smaller factor first among equals."""
    kp = F.col(kp) if isinstance(kp, str) else kp
    order = F.array_sort(F.transform(kp, lambda e: F.struct((-e["p"]).alias("n"), e["k"].alias("k"))))
    return F.transform(F.slice(order, 1, k), lambda e: F.struct(e["k"].alias("k"), (-e["n"]).alias("p")))


def first(kp, k: int) -> Column:
    """The first k pairs as they stand."""
    return F.slice(F.col(kp) if isinstance(kp, str) else kp, 1, k)


def at_least(kp, p: float) -> Column:
    return F.filter(F.col(kp) if isinstance(kp, str) else kp, lambda e: e["p"] >= p)


def placeholder(kp, k: int) -> Column:
    """Exactly k pairs, filled up with (-1, 0) as files need them."""
    kp = F.coalesce(F.col(kp) if isinstance(kp, str) else kp, F.array().cast("array<struct<k:int,p:double>>"))
    blank = F.array_repeat(F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("p")), k)
    return F.slice(F.concat(kp, blank), 1, k)


def encoded(kp, least: float, eps: float = 1e-6) -> Column:
    """Pairs as written to tiles: p of later pairs below ``least`` and a first p of almost 1 become null."""
    kp = F.col(kp) if isinstance(kp, str) else kp
    return F.transform(kp, lambda e, i: F.struct(F.when((i == 0) | (e["p"] >= least), e["k"]).alias("k"), F.when(((i == 0) & (e["p"] <= 1 - eps)) | ((i > 0) & (e["p"] >= least)), e["p"]).alias("p")))


def normalised(kp) -> Column:
    kp = F.col(kp) if isinstance(kp, str) else kp
    total = F.aggregate(kp, F.lit(0.0), lambda a, e: a + e["p"])
    return F.transform(kp, lambda e: F.struct(e["k"].alias("k"), F.try_divide(e["p"], total).alias("p")))


def entropy(kp) -> Column:
    """Shannon entropy in nats of the pairs' probabilities."""
    kp = F.col(kp) if isinstance(kp, str) else kp
    return F.aggregate(kp, F.lit(0.0), lambda a, e: a - F.when(e["p"] > 0, e["p"] * F.log(e["p"])).otherwise(F.lit(0.0)))


def sensitive_entropy(kp, similarity: list[list[float]]) -> Column:
    """Entropies of the pairs' probabilities, scaled to a sum of one, that know how alike factors are: a struct ``lcr, q``.

    With z = p S for the matrix ``similarity`` S: ``lcr`` is the sum of -p log z, ``q``
    is 1 - p S p.  Pairs without mass give 0 and 0.
    """
    kp = F.col(kp) if isinstance(kp, str) else kp
    n = len(similarity)
    s = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in similarity])
    mass = F.aggregate(kp, F.lit(0.0), lambda a, e: a + F.greatest(e["p"], F.lit(0.0)))
    at = lambda e, l: F.get(F.get(s, e["k"]), F.lit(l))
    p = lambda e: F.try_divide(F.greatest(e["p"], F.lit(0.0)), mass)
    like = lambda l: F.aggregate(kp, F.lit(0.0), lambda a, e: a + p(e) * at(e, l))
    z = F.array(*[like(l) for l in range(n)])
    lcr = F.aggregate(kp, F.lit(0.0), lambda a, e: a - F.when(p(e) > 0, p(e) * F.log(F.greatest(F.get(z, e["k"]), F.lit(2.2250738585072014e-308)))).otherwise(0.0))
    q = F.lit(1.0) - F.aggregate(kp, F.lit(0.0), lambda a, e: a + F.when(p(e) > 0, p(e) * F.get(z, e["k"])).otherwise(0.0))
    return F.struct(F.when(mass > 0, lcr).otherwise(0.0).alias("lcr"), F.when(mass > 0, q).otherwise(0.0).alias("q"))
