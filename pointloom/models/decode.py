"""Topics of pixels from their surroundings: spatial decoding in tiles with a halo."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.stats import digamma
from pointloom.models.topics import Topics, e_log
from pointloom.operators.groups import apply_groups
from pointloom.session import small


def lattice(x0: float, x1: float, y0: float, y1: float, spacing: float) -> np.ndarray:
    """Points of the triangular lattice of ``spacing`` that cover a box, at places that don't depend on the box."""
    dy = spacing * math.sqrt(3) / 2
    j = np.arange(math.floor(y0 / dy), math.ceil(y1 / dy) + 1)
    out = []
    for r in j:
        shift = 0.5 * (r % 2)
        i = np.arange(math.floor(x0 / spacing - shift), math.ceil(x1 / spacing - shift) + 1)
        out.append(np.stack([(i + shift) * spacing, np.full(len(i), r * dy)], 1))
    return np.vstack(out)


def decode(points: DataFrame, model: Topics, res: float, spacing: float, radius: float, by: list[str] = (), tile: float = 200.0, top: int = 3, least: float = 3.0, rounds: int = 20, half: float = 0.6) -> DataFrame:
    """``px, py, kp, n``: the ``top`` topics of each pixel that has an anchor within ``radius``.

    Anchors stand on a lattice; those whose surroundings count less than ``least``
    are dropped.  Each anchor has a distribution over topics, each pixel one over
    topics and one over the anchors near it; they are updated in turn until topics
    move little.  Tiles see the points around them, so results have no seams but
    for the finite number of rounds.
    """
    k, m = model.weights.shape
    beta = np.exp(e_log(model.weights))
    alpha = model.alpha[:k]
    words = points.sparkSession.createDataFrame([(w, i) for i, w in enumerate(model.words)], "feature string, w int")
    halo = 2 * radius
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    t = points.join(small(words), "feature").select(*by, "x", "y", "w", F.col("ct").cast("double").alias("n"))
    t = t.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    kinds, names = dict(points.dtypes), list(by)
    nu = math.log(0.5) / math.log(half)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf.tx.iloc[0] * tile, pdf.ty.iloc[0] * tile
        px, py = np.floor(pdf.x / res).astype(np.int64).to_numpy(), np.floor(pdf.y / res).astype(np.int64).to_numpy()
        pix, of = np.unique(np.stack([px, py], 1), axis=0, return_inverse=True)
        of = of.ravel()
        cx = (pix + 0.5) * res
        n = np.bincount(of, pdf.n.to_numpy(), len(pix))
        anchors = lattice(x0 - halo, x0 + tile + halo, y0 - halo, y0 + tile + halo, spacing)
        # pairs closer than the radius, by cells of that width
        pi, ai, d = near(cx, anchors, radius)
        w = np.clip(1 - (d / radius) ** nu, 0.05, 0.95)
        mass = np.bincount(ai, w * n[pi], len(anchors))
        good = mass[ai] >= least
        pi, ai, w = pi[good], ai[good], w[good]
        if not len(pi):
            return pd.DataFrame()
        order = np.argsort(pi, kind="stable")
        pi, ai, w = pi[order], ai[order], w[order]
        start = np.flatnonzero(np.r_[True, pi[1:] != pi[:-1]])
        row = np.cumsum(np.r_[False, pi[1:] != pi[:-1]])
        live = pi[start]
        back = np.full(len(pix), -1)
        back[live] = np.arange(len(live))
        keep = back[of] >= 0
        word, amount, owner = pdf.w.to_numpy()[keep], pdf.n.to_numpy()[keep], back[of[keep]]
        log_like = np.zeros((len(live), k))
        np.add.at(log_like, owner, amount[:, None] * np.log(beta[:, word].T))
        count = n[live]
        used, slot = np.unique(ai, return_inverse=True)
        gamma = np.full((len(used), k), 1.0)
        prior_psi = np.log(w)
        psi = np.exp(prior_psi)
        psi /= np.add.reduceat(psi, start)[row]
        phi = np.exp(log_like - log_like.max(1, keepdims=True))
        phi /= phi.sum(1, keepdims=True)
        for _ in range(rounds):
            gamma = np.zeros((len(used), k))
            np.add.at(gamma, slot, (psi * count[row])[:, None] * phi[row])
            gamma += alpha
            log_theta = digamma(gamma) - digamma(gamma.sum(1, keepdims=True))
            lp = log_like + count[:, None] * np.add.reduceat(psi[:, None] * log_theta[slot], start)
            new = np.exp(lp - lp.max(1, keepdims=True))
            new /= new.sum(1, keepdims=True)
            lq = prior_psi + (log_theta[slot] * new[row]).sum(1) * count[row]
            lq -= np.maximum.reduceat(lq, start)[row]
            psi = np.exp(lq)
            psi /= np.add.reduceat(psi, start)[row]
            moved = np.abs(new - phi).max(1).mean()
            phi = new
            if moved < 1e-3:
                break
        c = cx[live]
        own = (c[:, 0] >= x0) & (c[:, 0] < x0 + tile) & (c[:, 1] >= y0) & (c[:, 1] < y0 + tile)
        best = np.argsort(-phi[own], axis=1, kind="stable")[:, :top]
        ps = np.take_along_axis(phi[own], best, 1)
        head = {c_: pdf[c_].iloc[0] for c_ in names}
        return pd.DataFrame({**head, "px": pix[live][own][:, 0], "py": pix[live][own][:, 1], "ks": list(best.astype(np.int32)), "ps": list(ps), "n": count[own]})

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "px bigint, py bigint, ks array<int>, ps array<double>, n double"])
    out = apply_groups(t, [*by, "tx", "ty"], run, schema)
    return out.select(*by, "px", "py", F.transform(F.arrays_zip("ks", "ps"), lambda e: F.struct(e["ks"].alias("k"), e["ps"].alias("p"))).alias("kp"), "n")


def near(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b`` closer than ``radius``, and their distances."""
    cells: dict[tuple[int, int], list[int]] = {}
    for i, (u, v) in enumerate(np.floor(b / radius).astype(int).tolist()):
        cells.setdefault((u, v), []).append(i)
    own: dict[tuple[int, int], list[int]] = {}
    for i, (u, v) in enumerate(np.floor(a / radius).astype(int).tolist()):
        own.setdefault((u, v), []).append(i)
    pi, ai, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for (u, v), rows in own.items():
        cand = [j for du in (-1, 0, 1) for dv in (-1, 0, 1) for j in cells.get((u + du, v + dv), ())]
        if cand:
            rows_, cand_ = np.array(rows), np.array(cand)
            d = np.linalg.norm(a[rows_][:, None] - b[cand_][None], axis=2)
            i, j = np.nonzero(d < radius)
            pi.append(rows_[i])
            ai.append(cand_[j])
            dist.append(d[i, j])
    return np.concatenate(pi), np.concatenate(ai), np.concatenate(dist)
