"""Enrichment and differential tests on count tables in long form (``factor, feature, n``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.stats import chisq_2x2, log10p, loess, nonnegative_ridge
from pointloom.operators.ranks import similar_factors
from pointloom.session import small


def _margins(bulk: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    rows = bulk.groupBy("feature").agg(F.sum("n").alias("row"))
    cols = bulk.groupBy("factor").agg(F.sum("n").alias("col"))
    return rows, cols, float(bulk.agg(F.sum("n")).first()[0] or 0)


def _tested(t: DataFrame, a, b, c, d, pseudo: float, min_fc: float, min_log10p: float) -> DataFrame:
    a, b, c, d = (F.col(v).cast("double") for v in (a, b, c, d))
    p = F.lit(pseudo)
    fc = F.try_divide((a + p) * (d + p), (b + p) * (c + p))
    t = t.withColumns({"fold_change": fc, "chisq": chisq_2x2(a, b, c, d, pseudo)}).where(F.col("fold_change") >= min_fc)
    return t.withColumn("log10pval", log10p("chisq")).where(F.col("log10pval") >= min_log10p)


def one_vs_rest(bulk: DataFrame, pseudo: float = 0.5, min_count: float = 10, min_fc: float = 1.5, min_log10p: float = 3.0) -> DataFrame:
    """Features enriched in a factor against all others: ``factor, feature, gene_total, fold_change, chisq, log10pval``.

    Features need a total above ``min_count``.
    """
    rows, cols, whole = _margins(bulk)
    t = bulk.join(small(rows.where(F.col("row") > min_count)), "feature").join(small(cols), "factor")
    t = t.withColumns({"b": F.col("col") - F.col("n"), "c": F.col("row") - F.col("n"), "d": F.lit(whole) - F.col("col") - F.col("row") + F.col("n")})
    t = _tested(t, "n", "b", "c", "d", pseudo, min_fc, min_log10p)
    return t.select("factor", "feature", F.col("row").alias("gene_total"), "fold_change", "chisq", "log10pval")


def one_vs_neighbours(bulk: DataFrame, k: int, pseudo: float = 0.5, min_count: float = 10, min_fc: float = 1.5, min_log10p: float = 3.0) -> DataFrame:
    """As ``one_vs_rest``, with the ``k`` most similar factors as background."""
    rows, cols, _ = _margins(bulk)
    near = small(similar_factors(bulk, k).select("factor", "other"))
    back = near.join(bulk.withColumnRenamed("factor", "other"), "other").groupBy("factor", "feature").agg(F.sum("n").alias("bn"))
    back_col = near.join(cols.withColumnsRenamed({"factor": "other", "col": "oc"}), "other").groupBy("factor").agg(F.sum("oc").alias("bcol"))
    t = bulk.join(small(rows.where(F.col("row") > min_count)), "feature").join(small(cols), "factor").join(small(back_col), "factor")
    t = t.join(back, ["factor", "feature"], "left").withColumn("c", F.coalesce("bn", F.lit(0)))
    t = t.withColumns({"b": F.col("col") - F.col("n"), "d": F.col("bcol") - F.col("c")})
    t = _tested(t, "n", "b", "c", "d", pseudo, min_fc, min_log10p)
    return t.select("factor", "feature", F.col("row").alias("gene_total"), "fold_change", "chisq", "log10pval")


def pairwise(one: DataFrame, two: DataFrame, pseudo: float = 0.5, min_count: float = 10, min_fc: float = 1.5, min_log10p: float = 3.0) -> DataFrame:
    """For each factor, features that differ between two tables; features of both with a total of at least ``min_count`` in each factor.

    ``fold_change`` compares shares, and either direction passes.
    """
    a = one.groupBy("factor", "feature").agg(F.sum("n").alias("a"))
    c = two.groupBy("factor", "feature").agg(F.sum("n").alias("c"))
    ca, cc = one.groupBy("factor").agg(F.sum("n").alias("ca")), two.groupBy("factor").agg(F.sum("n").alias("cc"))
    t = a.join(c, ["factor", "feature"]).where(F.col("a") + F.col("c") >= min_count).join(small(ca), "factor").join(small(cc), "factor")
    t = t.withColumns({"b": F.col("ca") - F.col("a"), "d": F.col("cc") - F.col("c")})
    p = F.lit(pseudo)
    fc = ((F.col("a") + p) / (F.col("ca") + 2 * p)) / ((F.col("c") + p) / (F.col("cc") + 2 * p))
    t = t.withColumns({"fold_change": fc, "chisq": chisq_2x2("a", "b", "c", "d", pseudo)})
    t = t.where((F.col("fold_change") >= min_fc) | (F.col("fold_change") <= 1 / min_fc)).withColumn("log10pval", log10p("chisq"))
    return t.where(F.col("log10pval") >= min_log10p).select("factor", "feature", F.col("a").alias("n_one"), F.col("c").alias("n_two"), "fold_change", "chisq", "log10pval")


def abundance(masses: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """Factors that differ in abundance between groups 0 and 1 (``group, factor, mass``): odds ratio and chi-square."""
    s = masses.groupBy("factor").agg(F.sum(F.when(F.col("group") == 0, F.col("mass")).otherwise(0.0)).alias("m0"), F.sum(F.when(F.col("group") == 1, F.col("mass")).otherwise(0.0)).alias("m1"))
    w = s.agg(F.sum("m0"), F.sum("m1")).first()
    t0, t1 = float(w[0] or 0), float(w[1] or 0)
    r0, r1, p = F.lit(t0) - F.col("m0"), F.lit(t1) - F.col("m1"), F.lit(pseudo)
    odds = (F.col("m1") + p) * (r0 + p) / ((F.col("m0") + p) * (r1 + p))
    return s.select("factor", "m0", "m1", F.log2(odds).alias("log2_or"), chisq_2x2("m1", r1, "m0", r0, pseudo).alias("chisq"))


def binomial_sandwich(units: DataFrame, min_unit: float = 1.0, eps: float = 1e-3, by: list[str] = ()) -> DataFrame:
    """Difference of a feature's share between groups 0 and 1 with a robust standard error, for each of ``by``.

    ``units``: ``factor, unit, group, feature, y`` with the counts of each unit.
    By factor and group, from sums alone: N of unit totals n, C of n^2, and by
    feature Y of y, A of y^2, B of n y.  The estimate is the difference of logits of
    the shares, its variance ``sum (A - 2 pi B + pi^2 C) / (N pi (1 - pi))^2`` times
    ``m / (m - 2)``.  Units with a total below ``min_unit`` are dropped.
    """
    tot = units.groupBy(*by, "factor", "unit", "group").agg(F.sum("y").alias("n")).where(F.col("n") >= min_unit)
    g = tot.groupBy(*by, "factor", "group").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("C"), F.count(F.lit(1)).alias("m"))
    per = units.groupBy(*by, "factor", "unit", "group", "feature").agg(F.sum("y").alias("y")).join(tot, [*by, "factor", "unit", "group"])
    f = per.groupBy(*by, "factor", "group", "feature").agg(F.sum("y").alias("Y"), F.sum(F.col("y") * F.col("y")).alias("A"), F.sum(F.col("n") * F.col("y")).alias("B"))
    # both groups of a factor side by side, a feature absent from one counts 0 there
    pick = lambda c, i: F.coalesce(F.max(F.when(F.col("group") == i, F.col(c))), F.lit(0.0)).alias(f"{c}{i}")
    wide = f.groupBy(*by, "factor", "feature").agg(*[pick(c, i) for c in ("Y", "A", "B") for i in (0, 1)])
    sizes = g.groupBy(*by, "factor").agg(*[pick(c, i) for c in ("N", "C", "m") for i in (0, 1)]).where("N0 > 0 and N1 > 0 and m0 + m1 > 2")
    t = wide.join(small(sizes), [*by, "factor"])
    null = (F.col("Y0") + F.col("Y1")) / (F.col("N0") + F.col("N1"))
    for i in (0, 1):
        pi = F.greatest(null * eps, F.least(F.lit(1 - 1e-8), F.col(f"Y{i}") / F.col(f"N{i}")))
        t = t.withColumn(f"pi{i}", pi)
        s = F.col(f"N{i}") * F.col(f"pi{i}") * (1 - F.col(f"pi{i}"))
        r = F.col(f"A{i}") - 2 * F.col(f"pi{i}") * F.col(f"B{i}") + F.col(f"pi{i}") * F.col(f"pi{i}") * F.col(f"C{i}")
        t = t.withColumn(f"v{i}", r / (s * s))
    m = F.col("m0") + F.col("m1")
    beta = F.log(F.col("pi1") / (1 - F.col("pi1"))) - F.log(F.col("pi0") / (1 - F.col("pi0")))
    return t.select(*by, "factor", "feature", "pi0", "pi1", beta.alias("beta"), F.sqrt((F.col("v0") + F.col("v1")) * m / (m - 2)).alias("se"))


def contrasts(labels: dict[str, list[str]] | list[str], design: dict[str, dict[str, int]] | None = None) -> list[tuple[str, str, int]]:
    """Rows (contrast, sample, group) of a design: by contrast the samples with -1 and 1 (0 and unnamed ones take no part).

    Without a design every two of the samples ``labels`` are a contrast, the
    earlier one -1.  Group is 0 for -1 and 1 for 1.  A contrast without a sample
    on either side, an unknown sample or any other number is an error.
    """
    names = list(labels)
    if design is None:
        return [(f"{a}_vs_{b}", s, g) for i, a in enumerate(names) for b in names[i + 1 :] for s, g in ((a, 0), (b, 1))]
    out = []
    for name, column in design.items():
        if not set(column) <= set(names) or not set(column.values()) <= {-1, 0, 1} or not {-1, 1} <= set(column.values()):
            raise ValueError(f"contrast {name}: values are -1, 0 or 1 of known samples, with both -1 and 1")
        out += [(name, s, (v + 1) // 2) for s, v in column.items() if v]
    return out


def contrast_de(units: DataFrame, rows: list[tuple[str, str, int]], min_unit: float = 1.0, eps: float = 1e-3) -> DataFrame:
    """``binomial_sandwich`` of each contrast (``contrasts``) over ``units``: ``sample, factor, unit, feature, y``.

    All contrasts are one plan: units are copied to those their sample takes part in.
    """
    design = F.broadcast(units.sparkSession.createDataFrame(rows, "contrast string, sample string, group int"))  # as many rows as the design
    return binomial_sandwich(units.join(design, "sample"), min_unit, eps, ["contrast"])


def pixel_confusion(anno: DataFrame, n_factors: int, by: list[str] = ()) -> DataFrame:
    """``k1, k2, mass``: how often two factors share a pixel, symmetric, with what pixels leave unsaid spread over all pairs.

    Each pixel adds the products of its probabilities; the square of what they lack
    of one is added up over pixels and divided evenly by the ``n_factors`` squared pairs.
    """
    rest = F.lit(1.0) - F.aggregate("kp", F.lit(0.0), lambda a, e: a + e["p"])
    p = anno.select(*by, "kp", F.when(rest > 0, rest * rest).otherwise(0.0).alias("r2"))
    spread = p.groupBy(*by).agg((F.sum("r2") / (n_factors * n_factors)).alias("r"))
    both = F.flatten(F.transform("kp", lambda a, i: F.transform(F.filter("kp", lambda b, j: j >= i), lambda b: F.struct(a["k"].alias("a"), b["k"].alias("b"), (a["p"] * b["p"]).alias("m")))))
    e = p.select(*by, F.explode(both).alias("e")).groupBy(*by, F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.sum("e.m").alias("m"))
    turned = e.where("a <> b").select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "m")
    sums = e.unionByName(turned).groupBy(*by, F.col("a").alias("k1"), F.col("b").alias("k2")).agg(F.sum("m").alias("m"))
    whole = spread.withColumn("k1", F.explode(F.sequence(F.lit(0), F.lit(n_factors - 1)))).withColumn("k2", F.explode(F.sequence(F.lit(0), F.lit(n_factors - 1))))
    out = whole.join(sums, [*by, "k1", "k2"], "left")
    return out.select(*by, "k1", "k2", (F.coalesce("m", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("mass"))


def permutation_p(units: DataFrame, rounds: int = 100, seed: int = 0) -> DataFrame:
    """Share of random regroupings with an effect at least as large: ``factor, feature, p``.

    The units of a factor are given to group 1 anew, as many as it had; a factor's
    units are one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        units_, ui = np.unique(pdf.unit.to_numpy(), return_inverse=True)
        feats, fi = np.unique(pdf.feature.to_numpy(), return_inverse=True)
        y = np.zeros((len(units_), len(feats)))
        np.add.at(y, (ui, fi), pdf.y.to_numpy(float))
        group = np.zeros(len(units_), int)
        group[ui] = pdf.group.to_numpy(int)

        def effect(one):
            a, b = y[one].sum(0), y[~one].sum(0)
            return np.abs((a + 0.5) / (a.sum() + 1) - (b + 0.5) / (b.sum() + 1))

        rng = np.random.default_rng([seed, abs(hash(str(pdf.factor.iloc[0]))) % (1 << 31) if isinstance(pdf.factor.iloc[0], str) else int(pdf.factor.iloc[0])])
        real, n1, hit = effect(group == 1), int((group == 1).sum()), np.zeros(len(feats))
        for _ in range(rounds):
            one = np.zeros(len(units_), bool)
            one[rng.permutation(len(units_))[:n1]] = True
            hit += effect(one) >= real
        return pd.DataFrame({"factor": pdf.factor.iloc[0], "feature": feats, "p": hit / rounds})

    kind = dict(units.dtypes)
    return units.groupBy("factor").applyInPandas(run, f"factor {kind['factor']}, feature {kind['feature']}, p double")


def variable_features(units: DataFrame, n_units: int, span: float = 0.3, clip: float | None = None, feature: str = "feature", count: str = "ct") -> DataFrame:
    """Features by standardised variance: ``feature, mean, variance, expected_sd, standardized_variance, rank``.

    Variances (over all units, zeros included) are compared with a LOESS of their
    log10 on the log10 of the mean; standardised values are clipped at ``clip`` or
    the root of the number of units.  Only the table of features reaches the driver.
    """
    c = F.col(count).cast("double")
    s = units.groupBy(feature).agg(F.sum(c).alias("s1"), F.sum(c * c).alias("s2"), F.sum((c > 0).cast("long")).alias("nnz")).toPandas()
    mean = s.s1.to_numpy() / n_units
    var = s.s2.to_numpy() / n_units - mean**2
    sd = np.zeros(len(s))
    ok = (var > 1e-12) & (mean > 0)
    if ok.any():
        sd[ok] = np.sqrt(10 ** loess(np.log10(mean[ok]), np.log10(var[ok]), span))
    top = clip or np.sqrt(n_units)
    spark = units.sparkSession
    fit = spark.createDataFrame(pd.DataFrame({feature: s[feature], "mean": mean, "variance": var, "expected_sd": sd, "nnz": s.nnz}))
    z = F.when(F.col("expected_sd") > 0, F.least(F.lit(float(top)), (c - F.col("mean")) / F.col("expected_sd"))).otherwise(0.0)
    zero = F.when(F.col("expected_sd") > 0, F.col("mean") / F.col("expected_sd")).otherwise(0.0)
    part = units.where(c > 0).join(small(fit), feature).groupBy(feature).agg(F.sum(z * z).alias("zz"))
    out = fit.join(part, feature, "left")
    sv = (F.coalesce("zz", F.lit(0.0)) + (F.lit(n_units) - F.col("nnz")) * zero * zero) / F.lit(n_units - 1)
    out = out.withColumn("standardized_variance", sv)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("standardized_variance"), feature))  # the table of features
    return out.select(feature, "mean", "variance", "expected_sd", "standardized_variance").withColumn("rank", rank)


def deconvolve(bulk: DataFrame, confusion: DataFrame) -> DataFrame:
    """Factor columns with the mixing of ``confusion`` (``k1, k2, mass``) undone by non-negative ridge: ``feature, factor, n``.

    Factors are few; the table of features is worked on in pieces on the executors.
    """
    ks = sorted({r[0] for r in confusion.select("k1").distinct().collect()} | {r[0] for r in confusion.select("k2").distinct().collect()})
    at = {k: i for i, k in enumerate(ks)}
    m = np.zeros((len(ks), len(ks)))
    for a, b, w in confusion.select("k1", "k2", "mass").collect():
        m[at[a], at[b]] += w
    m = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    kind = dict(bulk.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="feature", columns="factor", values="n", aggfunc="sum", fill_value=0).reindex(columns=ks, fill_value=0)
        x = nonnegative_ridge(m.T, wide.to_numpy(float).T).T
        i, j = np.nonzero(x > 1e-9)
        return pd.DataFrame({"feature": wide.index.to_numpy()[i], "factor": np.array(ks)[j], "n": x[i, j]})

    parts = bulk.withColumn("part", F.pmod(F.hash("feature"), F.lit(64)))
    return parts.groupBy("part").applyInPandas(lambda p: solve(p.drop(columns="part")), f"feature {kind['feature']}, factor {kind['factor']}, n double")
