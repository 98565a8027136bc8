import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pointloom.models import mixtures, topics
from pointloom.models.counts import documents, read, vocabulary


def planted(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i:02d}" for i in range(30)]
    beta = np.full((3, 30), 0.002)
    for k in range(3):
        beta[k, 10 * k : 10 * k + 10] += rng.uniform(0.5, 1, 10)
    beta /= beta.sum(1, keepdims=True)
    rows, label = [], []
    for d in range(n):
        theta = rng.dirichlet([0.1] * 3)
        label.append(int(theta.argmax()))
        for w, c in zip(words, rng.multinomial(80, theta @ beta)):
            if c:
                rows.append((f"d{d:03d}", w, int(c)))
    return spark.createDataFrame(rows, "unit_id string, feature string, ct int"), np.array(label)


def purity(pred, true):
    return sum(np.bincount(true[pred == k]).max() for k in np.unique(pred)) / len(true)


def test_topics_are_recovered(spark):
    units, label = planted(spark)
    words = vocabulary(units)
    docs = documents(units, words).cache()
    model = topics.fit_lda(docs, words, 3, epochs=4)
    rows = topics.transform(docs, model).orderBy("id").collect()
    assert purity(np.array([r.ks[0] for r in rows]), label) > 0.9
    assert all(abs(sum(r.theta) - 1) < 1e-9 and 0 <= r.residual <= 1 for r in rows)
    bulk = topics.pseudobulk(docs, model)
    assert abs(bulk.sum() - units.agg(F.sum("ct")).first()[0]) < 1e-6
    loss = topics.leave_one_out(docs, model)
    assert (loss[:, 2] > 0).all()


def test_hdp_empties_topics(spark):
    units, _ = planted(spark)
    words = vocabulary(units)
    m = topics.fit_hdp(documents(units, words).cache(), words, 8, epochs=4)
    mass = m.weights.sum(1) / m.weights.sum()
    assert mass[:4].sum() > 0.75 and (np.diff(mass) <= 1e-12).all()


def test_gamma_poisson_and_clusters(spark):
    units, label = planted(spark)
    words = vocabulary(units)
    docs = documents(units, words).cache()
    share = topics.transform_gamma_poisson(docs, topics.fit_gamma_poisson(docs, words, 3, epochs=4)).orderBy("id").collect()
    assert purity(np.array([np.argmax(r.share) for r in share]), label) > 0.85


def test_mixture_de_finds_the_effect(spark):
    rng = np.random.default_rng(3)
    theta, counts = [], []
    for i in range(300):
        t, x = rng.dirichlet([0.3, 0.3]), 1 if i % 2 else -1
        theta.append((i, [float(v) for v in t], 1.0, x))
        counts.append((i, "up", int(rng.poisson(t @ np.array([4 * np.exp(0.5 * x), 3.0])))))
        counts.append((i, "flat", int(rng.poisson(t @ np.array([5.0, 2.0])))))
    r = mixtures.mixture_de(spark.createDataFrame(counts, "unit int, feature string, y int"), spark.createDataFrame(theta, "unit int, theta array<double>, size double, x int"), 2).collect()
    e = {(x.feature, x.topic): x for x in r}
    assert abs(e["up", 0].effect - 0.5) < 0.2 and e["up", 0].z > 4
    assert all(abs(e[k].z) < 4 for k in (("up", 1), ("flat", 0), ("flat", 1)))


def test_markers_and_nmf(spark):
    units, _ = planted(spark)
    words = vocabulary(units)
    docs = documents(units, words).cache()
    x = np.zeros((240, 30))
    for r in docs.orderBy("id").collect():
        x[int(r.id[1:]), r.words] = r.counts
    q = x.T @ x
    anchors = mixtures.anchor_features(q, 3)
    assert len({a // 10 for a in anchors}) == 3
    assert abs(mixtures.recover(q, anchors).sum(0) - 1).max() < 1e-9
    beta = mixtures.fit_nmf(docs, words, 3)
    assert beta.shape == (3, 30) and (beta >= 0).all()
    rows = mixtures.transform_nmf(docs, beta).collect()
    assert all(r.deviance >= -1e-6 for r in rows)


class Captured:
    """Stands for documents whose function is called here instead of in a task."""

    dtypes = [("id", "string")]

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def batch_of(lists):
    ids = pa.array([f"d{i}" for i in range(len(lists))])
    words, counts = (pa.array([[x[i] for x in own] for own in lists], kind) for i, kind in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float64()))))
    return pa.RecordBatch.from_arrays([ids, words, counts], ["id", "words", "counts"])


def sparse_batch(n, m, seed=0):
    rng = np.random.default_rng(seed)
    return batch_of([[(int(w), float(rng.poisson(2) + 1)) for w in np.sort(rng.choice(m, 12, False))] for _ in range(n)])


def test_nmf_holds_no_documents_by_features(monkeypatch):
    """4,000 documents and 5,000 features are 160 MB an array; neither the fit nor the transform may hold one."""
    b, m = sparse_batch(4000, 5000), 5000
    monkeypatch.setattr(mixtures, "added", lambda docs, stats, shape: stats(read(docs)))
    tracemalloc.start()
    try:
        beta = mixtures.fit_nmf(b, ["w"] * m, 3, outer=1, inner=1)
        fit = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        next(mixtures.transform_nmf(Captured(), beta, rounds=1)(iter([b])))
        peak = max(fit, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert peak < 60e6


def test_nmf_by_blocks_equals_the_dense_form(monkeypatch):
    """Slight factors, documents of great factors and no slight ones at all, several blocks, a feature given twice."""
    monkeypatch.setattr(mixtures, "CELLS", 1500)
    c, rng = 1e-3, np.random.default_rng(1)
    b = sparse_batch(150, 300, 1)
    d = read(b)
    y = np.zeros((150, 300))
    y[d.doc, d.word] = d.n
    size = np.maximum(y.sum(1), 1)[:, None] * c
    for scale, few in ((1.0, 100), (0.02, 100), (1.0, 300)):
        beta = rng.uniform(0.1, 1, (3, 300)) * scale
        beta[:, few:] *= 1e-5
        t = np.full((150, 3), 0.1)
        for _ in range(20):
            ex = np.exp(np.minimum(t @ beta + 1e-8, 30))
            grad = (y / np.maximum(size * (ex - 1), 1e-12) - 1) * size * ex
            hess = y / np.maximum(ex - 1, 1e-12) ** 2 * ex + size * ex
            t = np.maximum(0, t + 0.7 * (grad @ beta.T) / np.maximum(hess @ (beta**2).T * 1.5, 1e-9))
        lam = np.maximum(size * (np.exp(np.minimum(t @ beta, 30)) - 1), 1e-12)
        dev = 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / lam), 0) - y + lam).sum(1)
        out = next(mixtures.transform_nmf(Captured(), beta, c, 20)(iter([b])))
        assert np.allclose(np.array(out.column("theta").to_pylist()), t, rtol=1e-5, atol=1e-7)
        assert np.allclose(out.column("deviance").to_numpy(), dev, rtol=1e-6)
        assert scale == 1 or (t.sum(1) > mixtures.REACH).any()
        w = np.hstack([t, t**2]) * size
        assert np.allclose(mixtures._Exponentials(beta).by_feature(t, w), w.T @ np.exp(t @ beta + 1e-8), rtol=1e-10)
    split = batch_of([[(3, 1.0), (3, 2.0), (7, 4.0)]])
    whole = batch_of([[(3, 3.0), (7, 4.0)]])
    one, two = (next(mixtures.transform_nmf(Captured(), beta)(iter([x]))) for x in (split, whole))
    assert one.equals(two)


def test_joint_and_collapsed(spark):
    units, label = planted(spark)
    words = vocabulary(units)
    docs = documents(units, words).cache()
    rows = topics.transform_joint(docs, *topics.fit_joint(docs, words, 3, 3)).orderBy("id").collect()
    assert purity(np.array([int(np.argmax(r.theta)) for r in rows]), label) > 0.85
    assert {r.cluster for r in rows} <= {0, 1, 2} and all(0 < r.p <= 1 + 1e-9 for r in rows)
    m = topics.fit_collapsed(docs, words, 3)
    best = topics.transform(docs, m).orderBy("id").collect()
    assert purity(np.array([r.ks[0] for r in best]), label) > 0.85
    flat = topics.fit_lda(docs, words, 3, background=np.full(30, 1 / 30))
    assert all(len(r.theta) == 4 for r in topics.transform(docs, flat).limit(3).collect())


def test_anchor_markers_take_all_features(spark, monkeypatch):
    """More features than any fixed number of rows; a rare one that stands alone is an anchor, one seen once is in the matrix only."""
    from pointloom.plans import modelled

    rows = [(i, "s", 10.0 * (i // 2), 0.0, f"f{i % 260:03d}", 2) for i in range(520)]
    rows += [(1000, "s", -50.0, 0.0, "alone", 2), (1001, "s", -90.0, 0.0, "once", 1)]
    p = spark.createDataFrame(rows, "point_id long, sample_id string, x double, y double, feature string, ct long")
    monkeypatch.setattr(modelled, "points", lambda *_: p)
    got = modelled.anchor_markers(spark, "").toPandas()
    assert set(got.feature) == {f"f{i:03d}" for i in range(260)} | {"alone", "once"}
    assert (abs(got.groupby("factor").weight.sum() - 1) < 1e-9).all()
    allowed = np.array([False, True, True])
    assert mixtures.anchor_features(np.eye(3), 3, allowed) == [1, 2]


def test_negative_binomial_is_fitted(spark):
    """Sparse over-dispersed counts: z of features without an effect is about standard, and rates are where the likelihood's slope is 0."""
    rng = np.random.default_rng(5)
    n, m, alpha = 600, 120, 3.0
    theta, x = rng.dirichlet([0.3, 0.3], n), np.where(np.arange(n) % 2, 1, -1)
    rate = np.array([0.5, 0.2])
    lam = theta @ rate
    y = rng.poisson(rng.gamma(1 / alpha, alpha * lam[:, None], (n, m)))
    y[:, 0] = rng.poisson(rng.gamma(1 / alpha, alpha * (theta[:, 0] * 0.5 * np.exp(x) + theta[:, 1] * 0.2)))
    y[:, 1] = rng.poisson(lam)
    i, j = np.nonzero(y)
    counts = spark.createDataFrame([(int(a), f"f{b:03d}", int(y[a, b])) for a, b in zip(i, j)], "unit int, feature string, y int")
    units = spark.createDataFrame([(a, [float(v) for v in theta[a]], 1.0, int(x[a])) for a in range(n)], "unit int, theta array<double>, size double, x int")
    nb, po = (mixtures.mixture_de(counts, units, 2, negative_binomial=b).toPandas().set_index(["feature", "topic"]).sort_index() for b in (True, False))
    assert len(nb) == 2 * m and list(nb.columns) == ["base", "effect", "se", "z"]
    null = nb.loc["f002":]
    assert 0.8 < null.z.std() < 1.2 and abs(null.z.mean()) < 0.2
    assert abs(nb.effect["f000", 0] - 1.0) < 0.5 and nb.z["f000", 0] > 3
    assert (null.se > po.loc["f002":].se).all() and (nb.se["f001"] < null.se.groupby("topic").mean()).all()
    pr = {f: np.exp(np.stack([po.base[f] - po.effect[f], po.base[f] + po.effect[f]])) for f in ("f002", "f050")}
    g = (x > 0).astype(int)
    for f, r0 in pr.items():
        c = y[:, int(f[1:])]
        fit = (theta * r0[g]).sum(1)
        a = max(0, ((c - fit) ** 2 - c).sum() / (fit**2).sum())
        r = np.exp(np.stack([nb.base[f] - nb.effect[f], nb.base[f] + nb.effect[f]]))
        fit = (theta * r[g]).sum(1)
        for k in range(2):
            for h in range(2):
                e = (g == h) * theta[:, k] * r[h, k]
                slope = (e * (c - fit) / (fit * (1 + a * fit))).sum() + 0.5 - 0.5 * r[h, k] / (c.sum() / n)
                assert abs(slope) < 0.01
