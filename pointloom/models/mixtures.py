"""Regressions and mixtures on top of topics: differential expression, NMF, Gaussian clusters, markers."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.models.counts import Docs, added, read, segments
from pointloom.operators.groups import apply_groups
from pointloom.session import materialize, small


def mixture_de(counts: DataFrame, theta: DataFrame, k: int, negative_binomial: bool = False, rounds: int = 60, least: float = 5.0, shrink: float = 0.5) -> DataFrame:
    """Per feature and topic the log rate and the log ratio between groups: ``feature, topic, base, effect, se, z``.

    ``counts``: ``unit, feature, y``; ``theta``: ``unit, theta array, size, x`` with
    group x of -1 or 1.  The rate of a unit is ``size sum_k theta_k exp(base_k + x
    effect_k)``; EM shares a count out to topics, and given the shares the rates of
    both groups are ratios of sums, so that zeros enter only through the groups'
    exposures and units without the feature are never touched.  ``shrink`` is a
    prior count at the pooled rate.

    With ``negative_binomial`` the variance is ``rate + alpha rate^2``: each feature
    has its ``alpha`` by moments over all units, also those without it, at the
    Poisson rates, and the rates are the most likely ones given ``alpha``, with
    errors from the full Fisher information of the topics.  Each round goes once
    over all units.
    """
    t = theta.select("unit", "theta", "size", "x")
    e = t.select("x", "size", F.posexplode("theta").alias("k", "p")).groupBy("k").pivot("x", [-1, 1]).agg(F.sum(F.col("p") * F.col("size"))).collect()
    exposure = np.zeros((k, 2))
    for r in e:
        exposure[r[0]] = [r[1] or 0.0, r[2] or 0.0]
    rows = counts.where("y > 0").join(t, "unit").select("feature", "y", "theta", "size", "x")
    kind = dict(counts.dtypes)["feature"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.y.to_numpy(float)
        if y.sum() < least:
            return pd.DataFrame()
        p = np.stack(pdf.theta.to_numpy()) * pdf["size"].to_numpy(float)[:, None]
        g = (pdf.x.to_numpy() > 0).astype(int)
        pooled = y.sum() / max(exposure.sum(), 1e-12)
        rate, share = np.full((k, 2), pooled), np.zeros((k, 2))
        for _ in range(rounds):
            w = p * rate[:, g].T
            lam = np.maximum(w.sum(1), 1e-300)
            w *= (y / lam)[:, None]
            share = np.stack([w[g == 0].sum(0), w[g == 1].sum(0)], 1)
            new = (share + shrink * pooled / max(pooled, 1e-12)) / (exposure + shrink / max(pooled, 1e-12))
            done = np.abs(np.log(new / rate)).max() < 1e-5
            rate = new
            if done:
                break
        base = np.log(rate).mean(1)
        effect = (np.log(rate[:, 1]) - np.log(rate[:, 0])) / 2
        se = 0.5 * np.sqrt(1 / (share[:, 0] + shrink) + 1 / (share[:, 1] + shrink))
        return pd.DataFrame({"feature": pdf.feature.iloc[0], "topic": np.arange(k, dtype=np.int32), "base": base, "effect": effect, "se": se, "z": effect / se})

    schema = f"feature {kind}, topic int, base double, effect double, se double, z double"
    poisson = apply_groups(rows, ["feature"], fit, schema)
    return _negative_binomial(counts, t, k, poisson, schema, exposure.sum(), shrink) if negative_binomial else poisson


class Exposed(NamedTuple):
    """Documents of a batch with their topics times size, and their group."""

    docs: Docs
    p: np.ndarray
    group: np.ndarray

    def parts(self, m: int, cells: int = 1_000_000):
        """By group and at most ``cells`` of document by feature: the rows, and of their counts row, feature and amount."""
        for g in (0, 1):
            at = np.flatnonzero(self.group == g)
            step = max(1, cells // max(1, m))
            for i in range(0, len(at), step):
                rows = at[i : i + step]
                place = np.full(len(self.p), -1)
                place[rows] = np.arange(len(rows))
                own = place[self.docs.doc] >= 0
                yield g, self.p[rows], place[self.docs.doc[own]], self.docs.word[own], self.docs.n[own]


def _exposed(b: pa.RecordBatch) -> Exposed:
    size = b.column("size").to_numpy(zero_copy_only=False)
    theta = b.column("theta").flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)
    return Exposed(read(b), theta * size[:, None], (b.column("x").to_numpy(zero_copy_only=False) > 0).astype(int))


def _negative_binomial(counts: DataFrame, t: DataFrame, k: int, poisson: DataFrame, schema: str, exposure: float, shrink: float, rounds: int = 40) -> DataFrame:
    """The rates of ``poisson`` moved to where the negative binomial's likelihood is greatest.

    A step is Fisher's; a feature whose steps grow goes on with half of them, after one
    that can't lose likelihood (``log(1 + alpha rate)`` bounded by its tangent, topics shared out
    as in EM) instead.
    """
    start = poisson.toPandas().sort_values(["feature", "topic"])  # the model's own size
    m = len(start) // k
    if not m:
        return t.sparkSession.createDataFrame([], schema)
    names = start.feature.tolist()[::k]
    base, effect = (start[c].to_numpy().reshape(m, k) for c in ("base", "effect"))
    rate = np.exp(np.stack([base - effect, base + effect], 1))
    known = small(t.sparkSession.createDataFrame(list(enumerate(names)), f"i int, feature {schema.split(',')[0].split(' ', 1)[1]}"))
    y = counts.where("y > 0").join(known, "feature").groupBy("unit", "i").agg(F.sum("y").cast("double").alias("n"))
    y = y.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("l"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    units = t.where("x in (-1, 1)").join(y, "unit", "left").select(F.col("unit").alias("id"), none("l.i", "int").alias("words"), none("l.n", "double").alias("counts"), "theta", F.col("size").cast("double").alias("size"), "x")
    units = materialize(units)

    def moments(u: Exposed) -> np.ndarray:
        out = np.zeros((m, 3))
        for g, p, i, j, n in u.parts(m):
            lam = p @ rate[:, g].T
            out[:, 0] += (lam**2).sum(0)
            out[:, 1] += np.bincount(j, n * n - 2 * n * lam[i, j] - n, m)
            out[:, 2] += np.bincount(j, n, m)
        return out

    s = added(units, moments, (m, 3), _exposed)
    alpha = np.clip((s[:, 0] + s[:, 1]) / np.maximum(s[:, 0], 1e-12), 0, 1e4)
    pooled = np.maximum(s[:, 2] / max(exposure, 1e-12), 1e-300)[:, None, None]

    def scores(rate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By feature, group and topic: counts shared out, exposure, and the information of the logarithms."""

        def part(u: Exposed) -> np.ndarray:
            out = np.zeros((m, 2, 2 * k + k * k))
            for g, p, i, j, n in u.parts(m):
                lam = np.maximum(p @ rate[:, g].T, 1e-300)
                one = 1 / (1 + alpha * lam)
                out[:, g, k : 2 * k] += one.T @ p
                for a in range(k):
                    out[:, g, a] += np.bincount(j, n / lam[i, j] * p[i, a], m) * rate[:, g, a]
                    out[:, g, k + a] += np.bincount(j, n * one[i, j] * p[i, a], m) * alpha
                one /= lam
                out[:, g, 2 * k :] += one.T @ (p[:, :, None] * p[:, None]).reshape(-1, k * k)
            return out

        s = added(units, part, (m, 2, 2 * k + k * k), _exposed)
        return s[..., :k], s[..., k : 2 * k], s[..., 2 * k :].reshape(m, 2, k, k) * rate[..., None] * rate[..., None, :]

    last, damp = np.full(m, np.inf), np.ones(m)
    for n in range(rounds + 1):
        share, den, info = scores(rate)
        grad = share + shrink - rate * (den + shrink / pooled)
        info = info + shrink * np.eye(k) * np.maximum(1, rate / pooled)[..., None]
        step = np.clip(np.linalg.solve(info, grad[..., None])[..., 0], -1, 1)
        far = np.abs(step).reshape(m, -1).max(1)
        if n == rounds or far.max() < 1e-4:
            break
        safe = np.log((share + shrink) / (den + shrink / pooled)) - np.log(rate)
        grown = far > last
        damp = np.where(grown, damp / 2, damp)
        rate = rate * np.exp(np.where(grown[:, None, None], safe, step * damp[:, None, None]))
        last = np.where(grown, np.inf, far)
    base = np.log(rate).mean(1)
    effect = (np.log(rate[:, 1]) - np.log(rate[:, 0])) / 2
    se = 0.5 * np.sqrt(np.linalg.inv(info).diagonal(0, 2, 3).sum(1))
    out = pd.DataFrame({"feature": np.repeat(names, k), "topic": np.tile(np.arange(k, dtype=np.int32), m), "base": base.ravel(), "effect": effect.ravel(), "se": se.ravel(), "z": (effect / se).ravel()})
    return t.sparkSession.createDataFrame(out, schema)


#: Cells of documents by features that NMF works on at a time.
CELLS = 250_000
#: Factors up to ``SLIGHT`` of a feature, with factors up to ``REACH`` in total of a document, have exponents up to 0.001.
SLIGHT, REACH = 1e-4, 10.0
#: Shift and greatest value of NMF's exponents.
SHIFT, MOST = 1e-8, 30.0


def _powers(x: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the exponential series of the inner products of ``x``'s rows, to the third power."""
    out = [np.ones((len(x), 1)), x]
    for i in (2, 3):
        out.append((out[-1][:, :, None] * x[:, None]).reshape(len(x), x.shape[1] ** i) / math.sqrt(i))
    return np.hstack(out)


class _Exponentials:
    """Sums of ``exp(theta beta)`` over all features or documents, zeros included, in blocks of at most ``CELLS`` cells.

    Features with slight factors, as those of a long tail are, take the exponential's
    series instead, which is off by 5e-14 of it at most; documents beyond ``REACH`` take
    the exponential itself there too.
    """

    def __init__(self, beta: np.ndarray):
        k, m = beta.shape
        slight = beta.max(0) <= SLIGHT
        if slight.sum() <= k**3:  # the series has as many terms
            slight[:] = False
        self.far, self.near = np.flatnonzero(~slight), np.flatnonzero(slight)
        self.b, self.slight = beta[:, self.far], beta[:, self.near]
        self.series = _powers(self.slight.T) if len(self.near) else None
        self.step = max(1, min(CELLS // max(1, len(self.far)), 2000))

    @staticmethod
    def of(t: np.ndarray, b: np.ndarray) -> np.ndarray:
        e = t @ b
        if e.size and t.sum(1).max() * b.max() > MOST - SHIFT:
            np.minimum(e, MOST - SHIFT, out=e)
        return np.exp(e, out=e)

    def beyond(self, t: np.ndarray):
        """Of a block's documents those beyond ``REACH``, a few at a time."""
        at = np.flatnonzero(t.sum(1) > REACH)
        step = max(1, CELLS // max(1, len(self.near)))
        return [at[i : i + step] for i in range(0, len(at), step)]

    def weighted(self, w: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """For a block of documents, the sums over features with weights ``w`` (features x any)."""
        w = w * math.exp(SHIFT)
        far, near = w[self.far], w[self.near]
        series = self.series.T @ near if len(self.near) else None

        def sums(t: np.ndarray) -> np.ndarray:
            out = self.of(t, self.b) @ far
            if series is not None:
                rest = _powers(t) @ series
                for i in self.beyond(t):
                    rest[i] = self.of(t[i], self.slight) @ near
                out += rest
            return out

        return sums

    def by_feature(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums over documents with weights ``w`` (documents x any): any x features."""
        out = np.zeros((w.shape[1], len(self.far) + len(self.near)))
        terms = np.zeros((w.shape[1], self.series.shape[1])) if len(self.near) else None
        for i in range(0, len(t), self.step):
            part, v = t[i : i + self.step], w[i : i + self.step]
            out[:, self.far] += v.T @ self.of(part, self.b)
            if terms is not None:
                for j in self.beyond(part):
                    out[:, self.near] += v[j].T @ self.of(part[j], self.slight)
                own = part.sum(1) <= REACH
                terms += v[own].T @ _powers(part[own])
        if terms is not None:
            out[:, self.near] += terms @ self.series.T
        return out * math.exp(SHIFT)


def _merged(d: Docs) -> Docs:
    """``d`` with one count for each word of a document."""
    first = np.ones(len(d.doc), bool)
    first[1:] = (d.doc[1:] != d.doc[:-1]) | (d.word[1:] != d.word[:-1])
    return d if first.all() else Docs(d.ids, d.doc[first], d.word[first], np.add.reduceat(d.n, np.flatnonzero(first)))


def _blocks(d: Docs, step: int):
    """``step`` documents at a time: their places, and those of their counts."""
    at = range(0, len(d.ids), step)
    cuts = np.searchsorted(d.doc, [*at, len(d.ids)])
    for n, i in enumerate(at):
        yield slice(i, i + step), slice(cuts[n], cuts[n + 1])


def _present(eta: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts add to the gradient and the curvature of their exponents; absent ones add nothing but the exponential."""
    rise = np.expm1(np.minimum(eta + SHIFT, MOST))
    return y / np.maximum(size * rise, 1e-12) * size * (rise + 1), y / np.maximum(rise, 1e-12) ** 2 * (rise + 1)


def _local_nmf(d: Docs, beta: np.ndarray, c: float, rounds: int, link: _Exponentials) -> tuple[np.ndarray, np.ndarray]:
    """Projected diagonal Newton for each document's factors, and its size; rates are ``c (exp(eta) - 1)``."""
    k = len(beta)
    size = np.maximum(d.totals(), 1) * c
    by_word = np.ascontiguousarray(beta.T)
    sums = link.weighted(np.hstack([by_word, by_word**2]))
    theta = np.full((len(d.ids), k), 0.1)
    for rows, own in _blocks(d, link.step):
        t, s = theta[rows], size[rows]
        doc, y, b = d.doc[own] - rows.start, d.n[own], by_word[d.word[own]]
        squares, of = b**2, s[doc]
        for _ in range(rounds):
            grad, hess = _present((t[doc] * b).sum(1), y, of)
            here = segments(np.hstack([grad[:, None] * b, hess[:, None] * squares]), doc, len(t))
            all_ = s[:, None] * sums(t)
            t = np.maximum(0, t + 0.7 * (here[:, :k] - all_[:, :k]) / np.maximum((here[:, k:] + all_[:, k:]) * 1.5, 1e-9))
        theta[rows] = t
    return theta, size


def fit_nmf(docs: DataFrame, words: list[str], k: int, c: float = 1e-3, outer: int = 6, inner: int = 15, seed: int = 0) -> np.ndarray:
    """Non-negative factors with log1p link: counts are Poisson of ``c total (exp(theta beta) - 1)``; returns beta.

    Alternates documents (in the tasks) and features (a projected diagonal Newton
    step from gradient and curvature added up over all documents).
    """
    m = len(words)
    beta = np.random.default_rng(seed).uniform(0.1, 1.0, (k, m))
    for _ in range(outer):
        def stats(d: Docs, beta=beta) -> np.ndarray:
            d, link = _merged(d), _Exponentials(beta)
            t, size = _local_nmf(d, beta, c, inner, link)
            every = link.by_feature(t, np.hstack([t, t**2]) * size[:, None])
            every[:k] *= -1
            eta = sum(t[d.doc, f] * beta[f, d.word] for f in range(k))
            for n, part in enumerate(_present(eta, d.n, size[d.doc])):
                for f in range(k):
                    every[n * k + f] += np.bincount(d.word, part * t[d.doc, f] ** (n + 1), m)
            return every.reshape(2, k, m)

        g, h = added(docs, stats, (2, k, m))
        beta = np.maximum(0, beta + 0.7 * g / np.maximum(1.5 * h, 1e-9))
        norm = np.maximum(beta.max(1, keepdims=True), 1e-12)
        beta = beta / norm * max(1.0, float(np.median(norm)))
    return beta


def transform_nmf(docs: DataFrame, beta: np.ndarray, c: float = 1e-3, rounds: int = 40) -> DataFrame:
    """``id, theta, deviance`` of each document."""

    def run(batches):
        link = _Exponentials(beta)
        for b in batches:
            d = _merged(read(b))
            t, size = _local_nmf(d, beta, c, rounds, link)
            rate = lambda eta, size: np.maximum(size * (np.exp(np.minimum(eta, MOST)) - 1), 1e-12)
            dev = np.zeros(len(t))
            for rows, _ in _blocks(d, max(1, CELLS // max(1, beta.shape[1]))):
                dev[rows] = rate(t[rows] @ beta, size[rows][:, None]).sum(1)
            eta = sum(t[d.doc, f] * beta[f, d.word] for f in range(len(beta)))
            y = d.n
            dev += np.bincount(d.doc, np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / rate(eta, size[d.doc])), 0) - y, len(t))
            yield pa.RecordBatch.from_arrays([d.ids, pa.array(list(t), pa.list_(pa.float64())), pa.array(2 * dev)], ["id", "theta", "deviance"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, theta array<double>, deviance double")


def helmert(k: int) -> np.ndarray:
    """Orthonormal rows that sum to 0: the basis of log ratios."""
    h = np.zeros((k - 1, k))
    for i in range(1, k):
        h[i - 1, :i], h[i - 1, i] = 1.0, -i
        h[i - 1] /= math.sqrt(i * (i + 1))
    return h


def gaussian_clusters(theta: DataFrame, k: int, dims: int, rounds: int = 15, seed: int = 0, floor: float = 1e-3) -> tuple[dict, DataFrame]:
    """Mixture of diagonal Gaussians on log ratios of ``theta`` (``id, theta``): the parameters, and ``id, cluster, p``.

    Statistics of each round are added up over all rows.
    """
    basis = helmert(dims)

    def ratios(lists: pa.Array) -> np.ndarray:
        t = np.maximum(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), 1e-6)
        return np.log(t) @ basis.T

    first = theta.orderBy(F.xxhash64("id", F.lit(seed))).limit(k).select("theta").collect()
    mu = np.array([np.log(np.maximum(r[0], 1e-6)) @ basis.T for r in first])
    k = len(mu)
    var, weight = np.ones((k, dims - 1)), np.full(k, 1 / max(k, 1))

    def posterior(z, mu, var, weight):
        ll = np.log(weight) - 0.5 * (((z[:, None] - mu) ** 2 / var) + np.log(var)).sum(2)
        top = ll.max(1, keepdims=True)
        r = np.exp(ll - top)
        return r / r.sum(1, keepdims=True)

    for _ in range(rounds if k else 0):
        def part(batches, mu=mu, var=var, weight=weight):
            total = np.zeros((k, 2 * (dims - 1) + 1))
            for b in batches:
                z = ratios(b.column("theta"))
                if len(z):
                    r = posterior(z, mu, var, weight)
                    total += np.hstack([r.sum(0)[:, None], r.T @ z, r.T @ z**2])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(list(total))], ["c", "s"])

        s = theta.select("theta").mapInArrow(part, "c long, s array<double>").groupBy("c").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 * dims - 1)]).orderBy("c").toPandas().to_numpy()[:, 1:].astype(float)
        n = np.maximum(s[:, :1], 1e-9)
        mu = s[:, 1:dims] / n
        var = np.maximum(s[:, dims:] / n - mu**2, floor)
        weight = n[:, 0] / n.sum()

    def assign(batches):
        for b in batches:
            r = posterior(ratios(b.column("theta")), mu, var, weight) if k else np.zeros((b.num_rows, 1))
            c = r.argmax(1) if len(r) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(c.astype(np.int32)), pa.array(r[np.arange(len(r)), c])], ["id", "cluster", "p"])

    return {"mean": mu, "variance": var, "weight": weight}, theta.select("id", "theta").mapInArrow(assign, f"id {dict(theta.dtypes)['id']}, cluster int, p double")


def anchor_features(q: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[int]:
    """``k`` anchors of a co-occurrence matrix: greedily the row farthest from the span of those chosen, then each once more."""
    rows = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    ok = np.ones(len(q), bool) if allowed is None else allowed

    def farthest(chosen):
        if not chosen:
            return int(np.where(ok, (rows**2).sum(1), -1).argmax())
        base = rows[chosen[0]]
        rest = rows - base
        if len(chosen) > 1:
            o, _ = np.linalg.qr((rows[chosen[1:]] - base).T)
            rest = rest - rest @ o @ o.T
        d = np.where(ok, (rest**2).sum(1), -1)
        d[chosen] = -1
        return int(d.argmax())

    out: list[int] = []
    for _ in range(min(k, int(ok.sum()))):
        out.append(farthest(out))
    for i in range(len(out)):
        others = out[:i] + out[i + 1 :]
        out[i] = farthest(others)
    return out


def recover(q: np.ndarray, anchors: list[int], rounds: int = 200) -> np.ndarray:
    """Features by factors: each feature's row as a mixture of the anchors' rows (multiplicative updates of simplex weights), by Bayes."""
    p = q.sum(1)
    rows = q / np.maximum(p[:, None], 1e-300)
    a = np.maximum(rows[anchors], 1e-12)
    w = np.full((len(q), len(anchors)), 1 / len(anchors))
    for _ in range(rounds):
        w *= (rows / np.maximum(w @ a, 1e-300)) @ a.T
        w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
    b = w * p[:, None]
    return b / np.maximum(b.sum(0, keepdims=True), 1e-300)


def matrix_of(cooc: DataFrame, names: list[str], one: str = "f1", two: str = "f2", value: str = "weight") -> np.ndarray:
    """A dense feature by feature matrix, for as many features as a model has."""
    q = np.zeros((len(names), len(names)))
    known = small(cooc.sparkSession.createDataFrame(list(enumerate(names)), "i int, n string"))
    t = cooc.join(known.withColumnRenamed("i", "__i"), F.col(one) == F.col("n")).drop("n").join(known.withColumnRenamed("i", "__j"), F.col(two) == F.col("n"))

    def packed(batches):
        for b in batches:
            i, j, v = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (i.astype(np.int32), j.astype(np.int32), v.astype(np.float64))], ["i", "j", "v"])

    for r in t.select("__i", "__j", F.col(value).cast("double")).mapInArrow(packed, "i binary, j binary, v binary").toLocalIterator():
        np.add.at(q, (np.frombuffer(r.i, np.int32), np.frombuffer(r.j, np.int32)), np.frombuffer(r.v))
    return q
