"""Queries of the models on the units of unit_features; iterative, so checked by tests of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointloom.models import mixtures as M
from pointloom.models import topics as T
from pointloom.models.counts import documents, vocabulary
from pointloom.models.decode import decode
from pointloom.operators.aggregates import cooccurrence
from pointloom.plans.reference import points, query, units
from pointloom.session import materialize

K = 6
#: Total that a feature must exceed to be an anchor.
ANCHOR_COUNT = 1


def _docs(spark, sf):
    u = units(spark, sf)
    words = vocabulary(u, least=5)
    return materialize(documents(u, words)), words


def _matrix(spark, m: np.ndarray, words: list[str], name: str = "topic"):
    k, j = np.nonzero(m > 0)
    return spark.createDataFrame(pd.DataFrame({name: k.astype(np.int32), "feature": np.array(words)[j], "weight": m[k, j]}))


@query()
def lda_fit(spark, sf):
    docs, words = _docs(spark, sf)
    return _matrix(spark, T.fit_lda(docs, words, K).by_abundance().share, words)


@query()
def lda_transform(spark, sf):
    docs, words = _docs(spark, sf)
    return T.transform(docs, T.fit_lda(docs, words, K))


@query()
def lda_pseudobulk(spark, sf):
    docs, words = _docs(spark, sf)
    return _matrix(spark, T.pseudobulk(docs, T.fit_lda(docs, words, K)).T, words)


@query()
def lda_feature_residuals(spark, sf):
    docs, words = _docs(spark, sf)
    r = T.feature_residuals(docs, T.fit_lda(docs, words, K))
    return spark.createDataFrame(pd.DataFrame({"feature": words, "observed": r[:, 0], "expected": r[:, 1], "residual": r[:, 2]}))


@query()
def factor_evaluation(spark, sf):
    docs, words = _docs(spark, sf)
    r = T.leave_one_out(docs, T.fit_lda(docs, words, K))
    return spark.createDataFrame(pd.DataFrame({"topic": np.arange(K), "n_units": r[:, 0], "mass": r[:, 1], "loss": r[:, 2]}))


@query()
def hdp_fit(spark, sf):
    docs, words = _docs(spark, sf)
    return _matrix(spark, T.fit_hdp(docs, words, 12).share, words)


@query()
def gamma_poisson_transform(spark, sf):
    docs, words = _docs(spark, sf)
    return T.transform_gamma_poisson(docs, T.fit_gamma_poisson(docs, words, K))


@query()
def gamma_poisson_clusters(spark, sf):
    docs, words = _docs(spark, sf)
    share = materialize(T.transform_gamma_poisson(docs, T.fit_gamma_poisson(docs, words, K)).select("id", F.col("share").alias("theta")))
    return M.gaussian_clusters(share, 4, K)[1]


@query()
def joint_clusters(spark, sf):
    docs, words = _docs(spark, sf)
    return T.transform_joint(docs, *T.fit_joint(docs, words, K, 4))


@query()
def collapsed_lda_fit(spark, sf):
    docs, words = _docs(spark, sf)
    return _matrix(spark, T.fit_collapsed(docs, words, K).by_abundance().share, words)


@query()
def background_lda_transform(spark, sf):
    """LDA with the overall distribution of features as a fixed last topic."""
    docs, words = _docs(spark, sf)
    total = units(spark, sf).groupBy("feature").agg(F.sum("ct").alias("t")).toPandas().set_index("feature").t
    share = np.array([float(total.get(w, 0)) for w in words])
    return T.transform(docs, T.fit_lda(docs, words, K, background=share / share.sum()))


@query()
def nmf_transform(spark, sf):
    docs, words = _docs(spark, sf)
    return M.transform_nmf(docs, M.fit_nmf(docs, words, K))


def _design(spark, sf):
    docs, words = _docs(spark, sf)
    theta = T.transform(docs, T.fit_lda(docs, words, 3)).select(F.col("id").alias("unit"), "theta", F.lit(1.0).alias("size"), F.when(F.substring("id", -1, 1) < "8", -1).otherwise(1).alias("x"))
    return units(spark, sf).select(F.col("unit_id").alias("unit"), "feature", F.col("ct").alias("y")), materialize(theta)


@query()
def poisson_mixture_de(spark, sf):
    return M.mixture_de(*_design(spark, sf), 3)


@query()
def negative_binomial_mixture_de(spark, sf):
    return M.mixture_de(*_design(spark, sf), 3, negative_binomial=True)


@query()
def anchor_markers(spark, sf):
    """All features are in the matrix; an anchor has a total above ``ANCHOR_COUNT``, as in the reference."""
    p = points(spark, sf)
    total = {r[0]: r[1] for r in p.groupBy("feature").agg(F.sum("ct").alias("t")).collect()}
    words = sorted(total)
    q = M.matrix_of(cooccurrence(p, 3.0, ["sample_id"]), words)
    anchors = M.anchor_features(q, 5, np.array([total[w] > ANCHOR_COUNT for w in words], bool))
    return _matrix(spark, M.recover(q, anchors).T, words, "factor")


@query()
def pixel_decode(spark, sf):
    p = points(spark, sf)
    words = vocabulary(p, least=3)
    docs = materialize(documents(p.withColumn("unit_id", F.concat_ws("_", "sample_id", F.floor(F.col("x") / 12), F.floor(F.col("y") / 12))), words))
    return decode(p, T.fit_lda(docs, words, 4), 1.0, 8.0, 12.0, ["sample_id"])
