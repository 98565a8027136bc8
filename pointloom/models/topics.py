"""Topic models by stochastic variational inference: LDA (with background), HDP, Gamma-Poisson factors.

The driver holds the topics only (topics x features).  A step sends them to the
tasks that hold the step's share of documents, fits each document locally in
vectorised batches, and adds up the expected counts in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.stats import digamma
from pointloom.models.counts import Docs, added, read, segments


@dataclass
class Topics:
    """Pseudo-counts of features by topic, the prior of topics, and how the model was made."""

    words: list[str]
    weights: np.ndarray
    alpha: np.ndarray
    kind: str = "lda"
    rate: np.ndarray | None = None
    extra: dict = field(default_factory=dict)

    @property
    def share(self) -> np.ndarray:
        return self.weights / self.weights.sum(1, keepdims=True)

    def by_abundance(self) -> Topics:
        """Topics in descending order of their weight."""
        o = np.argsort(-self.weights.sum(1), kind="stable")
        return Topics(self.words, self.weights[o], self.alpha[o], self.kind, None if self.rate is None else self.rate[o], self.extra)


def e_log(a: np.ndarray) -> np.ndarray:
    """Expected log of Dirichlet variables, row by row."""
    return digamma(a) - digamma(a.sum(-1, keepdims=True))


def local_lda(d: Docs, exp_beta: np.ndarray, alpha: np.ndarray, rounds: int = 50, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Variational topic counts of each document, and of each count the expected share of topics times its amount."""
    n, k = len(d.ids), len(alpha)
    b = exp_beta[:, d.word].T
    gamma = alpha + d.totals()[:, None] / k
    for _ in range(rounds):
        theta = np.exp(e_log(gamma))
        r = theta[d.doc] * b
        r *= (d.n / np.maximum(r.sum(1), 1e-100))[:, None]
        new = alpha + segments(r, d.doc, n)
        done = np.abs(new - gamma).mean() < tol * max(1.0, d.n.sum() / max(n, 1) / k)
        gamma = new
        if done:
            break
    return gamma, r if len(d.doc) else np.zeros((0, k))


def expected(r: np.ndarray, word: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, r.shape[1]))
    np.add.at(out, word, r)
    return out.T


def fit_lda(docs: DataFrame, words: list[str], k: int, epochs: int = 2, batches: int = 4, alpha: float | None = None, eta: float | None = None, kappa: float = 0.7, tau: float = 10.0, seed: int = 0, start: np.ndarray | None = None, sticks: float | None = None, background: np.ndarray | None = None) -> Topics:
    """Online variational Bayes: step t moves the topics by ``(tau + t)^-kappa`` to what a share of the documents says.

    ``batches`` is into how many shares documents are hashed.  ``sticks`` (the HDP)
    gives topics a stick-breaking prior of that concentration, refitted to their
    mass each step, which empties superfluous ones.  ``background`` is a fixed
    distribution over features added as a last topic.
    """
    m = len(words)
    rng = np.random.default_rng(seed)
    eta = 1.0 / k if eta is None else eta
    lam = start.copy() if start is not None else rng.gamma(100.0, 0.01, (k, m))
    prior = np.full(k, 1.0 / k if alpha is None else alpha)
    if background is not None:
        prior = np.r_[prior, prior.mean() * k]
    total, step = docs.count(), 0
    for _ in range(epochs):
        for b in range(batches):
            part = docs.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b)
            exp_beta = np.exp(e_log(lam))
            if background is not None:
                exp_beta = np.vstack([exp_beta, background])
            a = prior

            def stats(d: Docs, exp_beta=exp_beta, a=a) -> np.ndarray:
                gamma, r = local_lda(d, exp_beta, a)
                out = np.zeros((len(a), m + 1))
                out[:, :m] = expected(r, d.word, m)
                out[0, m] = len(d.ids)
                return out

            s = added(part, stats, (len(a), m + 1))
            n = s[0, m]
            if not n:
                continue
            rho = (tau + step) ** -kappa
            lam = (1 - rho) * lam + rho * (eta + total / n * s[:k, :m])
            step += 1
            if sticks is not None:
                mass = lam.sum(1)
                o = np.argsort(-mass)
                rest = mass[o][::-1].cumsum()[::-1]
                v = (1 + mass[o]) / (1 + sticks + rest)
                weight = np.empty(k)
                weight[o] = v * np.r_[1, np.cumprod(1 - v)[:-1]]
                prior[:k] = np.maximum(weight / weight.sum(), 1e-6)
    return Topics(words, lam, prior, "hdp" if sticks is not None else "lda", extra={} if background is None else {"background": background})


def fit_hdp(docs: DataFrame, words: list[str], most: int = 30, concentration: float = 1.0, **how) -> Topics:
    """Hierarchical Dirichlet process, truncated at ``most`` topics; topics come out by abundance."""
    return fit_lda(docs, words, most, sticks=concentration, **how).by_abundance()


def transform(docs: DataFrame, model: Topics, top: int = 3) -> DataFrame:
    """``id, theta, ks, ps, entropy, residual, cosine, total`` of each document under the model.

    ``residual`` is the share of counts the expected distribution misses (half the
    absolute difference), ``cosine`` that of counts and expectation.
    """
    exp_beta = np.exp(e_log(model.weights))
    share, alpha = model.share, model.alpha
    if "background" in model.extra:
        exp_beta, share = np.vstack([exp_beta, model.extra["background"]]), np.vstack([share, model.extra["background"]])

    def run(batches):
        for b in batches:
            d = read(b)
            gamma, _ = local_lda(d, exp_beta, alpha)
            theta = gamma / gamma.sum(1, keepdims=True)
            out = fit_quality(d, theta, share)
            order = np.argsort(-theta, axis=1, kind="stable")[:, :top]
            yield pa.RecordBatch.from_arrays(
                [d.ids, pa.array(list(theta)), pa.array(list(order.astype(np.int32))), pa.array(list(np.take_along_axis(theta, order, 1))), *[pa.array(x) for x in out]],
                ["id", "theta", "ks", "ps", "entropy", "residual", "cosine", "total"],
            )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, theta array<double>, ks array<int>, ps array<double>, entropy double, residual double, cosine double, total double")


def fit_quality(d: Docs, theta: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(d.ids)
    total = d.totals()
    entropy = -(theta * np.log(np.maximum(theta, 1e-300))).sum(1)
    mean = theta @ share
    at = mean[d.doc, d.word]
    seen = np.bincount(d.doc, at, n)
    x = d.n / np.maximum(total[d.doc], 1e-300)
    residual = 0.5 * (np.bincount(d.doc, np.abs(x - at), n) + (1 - seen))
    cosine = np.bincount(d.doc, x * at, n) / np.maximum(np.sqrt(np.bincount(d.doc, x * x, n)) * np.linalg.norm(mean, axis=1), 1e-300)
    return entropy, residual, cosine, total


def pseudobulk(docs: DataFrame, model: Topics) -> np.ndarray:
    """Features by topics: counts shared out by each document's topics (count times theta)."""
    exp_beta, alpha, m = np.exp(e_log(model.weights)), model.alpha[: len(model.weights)], len(model.words)

    def stats(d: Docs) -> np.ndarray:
        gamma, _ = local_lda(d, exp_beta, alpha)
        theta = gamma / gamma.sum(1, keepdims=True)
        return expected(theta[d.doc] * d.n[:, None], d.word, m).T

    return added(docs, stats, (m, len(model.weights)))


def feature_residuals(docs: DataFrame, model: Topics) -> np.ndarray:
    """By feature: count, expected count, and the sum of absolute differences."""
    exp_beta, alpha, share, m = np.exp(e_log(model.weights)), model.alpha[: len(model.weights)], model.share, len(model.words)

    def stats(d: Docs) -> np.ndarray:
        gamma, _ = local_lda(d, exp_beta, alpha)
        mean = (gamma / gamma.sum(1, keepdims=True)) @ share * d.totals()[:, None]
        out = np.zeros((m, 3))
        out[:, 0] = np.bincount(d.word, d.n, m)
        out[:, 1] = mean.sum(0)
        seen = np.bincount(d.word, mean[d.doc, d.word], m)
        out[:, 2] = np.bincount(d.word, np.abs(d.n - mean[d.doc, d.word]), m) + out[:, 1] - seen
        return out

    return added(docs, stats, (m, 3))


# ---------------------------------------------------------------- Gamma-Poisson


def local_gamma(d: Docs, e_beta: np.ndarray, log_beta: np.ndarray, a: float, b: float, size: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma posteriors of each document's factors: shape and rate, and counts shared out to factors."""
    n, k = len(d.ids), len(e_beta)
    rate = b + size[:, None] * e_beta.sum(1)[None, :]
    shape = a + np.repeat(d.totals()[:, None] / k, k, 1)
    w = np.exp(log_beta)[:, d.word].T
    r = np.zeros((0, k))
    for _ in range(rounds):
        t = np.exp(digamma(shape) - np.log(rate))
        r = t[d.doc] * w
        r *= (d.n / np.maximum(r.sum(1), 1e-100))[:, None]
        new = a + segments(r, d.doc, n)
        done = np.abs(new - shape).mean() < 1e-3 * max(1.0, new.mean())
        shape = new
        if done:
            break
    return shape, rate, r


def fit_gamma_poisson(docs: DataFrame, words: list[str], k: int, epochs: int = 2, batches: int = 4, a: float = 0.3, b: float = 0.3, c: float = 0.3, kappa: float = 0.7, tau: float = 10.0, seed: int = 0) -> Topics:
    """Poisson factors with Gamma priors and a size factor for each document (its total over the mean total)."""
    m = len(words)
    shape, rate = np.random.default_rng(seed).gamma(100.0, 0.01, (k, m)), np.full((k, 1), 1.0)
    row = docs.agg(F.count(F.lit(1)), F.avg(F.aggregate("counts", F.lit(0.0), lambda x, y: x + y))).first()
    total, mean = row[0], row[1] or 1.0
    step = 0
    for _ in range(epochs):
        for i in range(batches):
            part = docs.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i)
            e_beta, log_beta = shape / rate, digamma(shape) - np.log(rate)

            def stats(d: Docs, e_beta=e_beta, log_beta=log_beta) -> np.ndarray:
                size = d.totals() / mean
                s, r, counts = local_gamma(d, e_beta, log_beta, a, b, size)
                out = np.zeros((k, m + 2))
                out[:, :m] = expected(counts, d.word, m)
                out[:, m] = (size[:, None] * s / r).sum(0)
                out[0, m + 1] = len(d.ids)
                return out

            s = added(part, stats, (k, m + 2))
            n = s[0, m + 1]
            if not n:
                continue
            rho = (tau + step) ** -kappa
            shape = (1 - rho) * shape + rho * (c + total / n * s[:, :m])
            rate = (1 - rho) * rate + rho * (c + total / n * s[:, m : m + 1])
            step += 1
    return Topics(words, shape, np.full(k, a), "gamma-poisson", rate, {"mean": mean, "b": b})


def transform_gamma_poisson(docs: DataFrame, model: Topics) -> DataFrame:
    """``id, theta, sd, share``: posterior mean and standard deviation of each factor, and shares of the expected count."""
    e_beta, log_beta = model.weights / model.rate, digamma(model.weights) - np.log(model.rate)
    a, b, mean, mass = float(model.alpha[0]), model.extra["b"], model.extra["mean"], (model.weights / model.rate).sum(1)

    def run(batches):
        for batch in batches:
            d = read(batch)
            s, r, _ = local_gamma(d, e_beta, log_beta, a, b, d.totals() / mean)
            t = s / r
            part = t * mass
            yield pa.RecordBatch.from_arrays([d.ids, pa.array(list(t)), pa.array(list(np.sqrt(s) / r)), pa.array(list(part / np.maximum(part.sum(1, keepdims=True), 1e-300)))], ["id", "theta", "sd", "share"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, theta array<double>, sd array<double>, share array<double>")


# ---------------------------------------------------------------- evaluation


def leave_one_out(docs: DataFrame, model: Topics, least: float = 0.05) -> np.ndarray:
    """By topic: units with a share of at least ``least``, its mass, and the log-likelihood lost without it.

    A unit without the topic is projected anew on the others; both fits are
    compared on the unit's counts.
    """
    share, m = model.share, len(model.words)
    k = len(share)
    beta, alpha = np.exp(e_log(model.weights)), model.alpha[:k]

    def stats(d: Docs) -> np.ndarray:
        gamma, _ = local_lda(d, beta, alpha)
        theta = gamma / gamma.sum(1, keepdims=True)
        base = np.log(np.maximum((theta[d.doc] * share[:, d.word].T).sum(1), 1e-300))
        out = np.zeros((k, 3))
        out[:, 0], out[:, 1] = (theta >= least).sum(0), (theta * d.totals()[:, None]).sum(0)
        for t in range(k):
            others = np.arange(k) != t
            units = np.flatnonzero(theta[:, t] >= least)
            keep = np.isin(d.doc, units)
            if not keep.any():
                continue
            back = np.full(len(d.ids), -1)
            back[units] = np.arange(len(units))
            sub = Docs(pa.array(np.arange(len(units))), back[d.doc[keep]], d.word[keep], d.n[keep])
            g, _ = local_lda(sub, beta[others], alpha[others], 20)
            th = g / g.sum(1, keepdims=True)
            without = np.log(np.maximum((th[sub.doc] * share[others][:, sub.word].T).sum(1), 1e-300))
            out[t, 2] = (sub.n * (base[keep] - without)).sum()
        return out

    return added(docs, stats, (k, 3))


# ---------------------------------------------------------------- joint clusters, collapsed inference


def fit_joint(docs: DataFrame, words: list[str], k: int, clusters: int, epochs: int = 3, seed: int = 0, c: float = 0.5) -> tuple[Topics, np.ndarray, np.ndarray]:
    """Topics and clusters of documents at once: each cluster has its own prior over topics.

    A document's posterior over clusters weighs their priors in its local fit; the
    priors are refitted to the topic counts of the documents they own.  Returns the
    topics, the clusters' priors (clusters x topics) and their weights.
    """
    m = len(words)
    rng = np.random.default_rng(seed)
    lam = fit_lda(docs, words, k, 1, seed=seed).weights
    prior, weight = rng.dirichlet(np.full(k, 0.5), clusters) * k * c + 0.05, np.full(clusters, 1 / clusters)
    for _ in range(epochs):
        beta = np.exp(e_log(lam))

        def stats(d: Docs, beta=beta, prior=prior, weight=weight) -> np.ndarray:
            r, gamma, owner = local_joint(d, beta, prior, weight)
            out = np.zeros((k + clusters, m + k + 1))
            out[:k, :m] = expected(r, d.word, m)
            theta = gamma / gamma.sum(1, keepdims=True)
            out[k:, m : m + k] = owner.T @ theta
            out[k:, m + k] = owner.sum(0)
            return out

        s = added(docs, stats, (k + clusters, m + k + 1))
        lam = 1.0 / k + s[:k, :m]
        n = np.maximum(s[k:, m + k], 1e-9)
        prior = s[k:, m : m + k] / n[:, None] * k * c + 0.05
        weight = n / n.sum()
    return Topics(words, lam, prior.mean(0), "joint"), prior, weight


def local_joint(d: Docs, beta: np.ndarray, prior: np.ndarray, weight: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from pointloom.functions.stats import lgamma

    owner = np.repeat(weight[None], len(d.ids), 0)
    norm = lgamma(prior.sum(1)) - lgamma(prior).sum(1)
    for _ in range(rounds):
        alpha = owner @ prior
        w = beta[:, d.word].T
        gamma = alpha + d.totals()[:, None] / len(beta)
        for _ in range(10):
            r = np.exp(e_log(gamma))[d.doc] * w
            r *= (d.n / np.maximum(r.sum(1), 1e-100))[:, None]
            gamma = alpha + segments(r, d.doc, len(d.ids))
        score = np.log(weight) + norm + e_log(gamma) @ (prior - 1).T
        owner = np.exp(score - score.max(1, keepdims=True))
        owner /= owner.sum(1, keepdims=True)
    return r, gamma, owner


def transform_joint(docs: DataFrame, model: Topics, prior: np.ndarray, weight: np.ndarray) -> DataFrame:
    """``id, theta, cluster, p`` of each document."""
    beta = np.exp(e_log(model.weights))

    def run(batches):
        for b in batches:
            d = read(b)
            _, gamma, owner = local_joint(d, beta, prior, weight)
            c = owner.argmax(1)
            yield pa.RecordBatch.from_arrays([d.ids, pa.array(list(gamma / gamma.sum(1, keepdims=True))), pa.array(c.astype(np.int32)), pa.array(owner[np.arange(len(c)), c])], ["id", "theta", "cluster", "p"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, theta array<double>, cluster int, p double")


def local_collapsed(d: Docs, share: np.ndarray, alpha: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Zeroth-order collapsed inference: the share of topics in a count leaves the count itself out of the document's."""
    n, k = len(d.ids), len(alpha)
    w = share[:, d.word].T
    r = w * (d.n / np.maximum(w.sum(1), 1e-100))[:, None]
    for _ in range(rounds):
        total = segments(r, d.doc, n)
        new = np.maximum(total[d.doc] - r / np.maximum(d.n, 1)[:, None], 0) + alpha
        new = new * w
        new *= (d.n / np.maximum(new.sum(1), 1e-100))[:, None]
        done = np.abs(new - r).sum() < 1e-3 * d.n.sum()
        r = new
        if done:
            break
    return segments(r, d.doc, n) + alpha, r


def fit_collapsed(docs: DataFrame, words: list[str], k: int, epochs: int = 4, batches: int = 2, seed: int = 0, kappa: float = 0.6, tau: float = 1.0) -> Topics:
    """LDA by stochastic zeroth-order collapsed inference (SCVB0), a share of the documents a step."""
    m, rng = len(words), np.random.default_rng(seed)
    lam, total, step = rng.gamma(1.0, 1.0, (k, m)), docs.count(), 0
    alpha = np.full(k, 1.0 / k)
    for _ in range(epochs):
        for b in range(batches):
            part = docs.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(batches)) == b)
            share = (lam + 0.01) / (lam + 0.01).sum(1, keepdims=True)

            def stats(d: Docs, share=share) -> np.ndarray:
                out = np.zeros((k, m + 1))
                out[:, :m] = expected(local_collapsed(d, share, alpha)[1], d.word, m)
                out[0, m] = len(d.ids)
                return out

            s = added(part, stats, (k, m + 1))
            if s[0, m]:
                rho = (tau + step) ** -kappa if step else 1.0
                lam = (1 - rho) * lam + rho * total / s[0, m] * s[:, :m]
                step += 1
    return Topics(words, lam + 0.01, alpha, "scvb0")
