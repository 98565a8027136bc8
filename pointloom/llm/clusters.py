"""Clusters of mutually similar records by distributed k-means.

Records become unit vectors of hashed weighted features, k-means starts from
parallel oversampled seeding (k-means||) and runs over all records; each record
is then filed under its nearest centre.  ``mutual_clusters`` turns the cells into
exact groups: records that are all similar to each other and to no other record.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.runs import column, expand, sized, slabs
from pointloom.operators.groups import apply_groups
from pointloom.session import materialize, small

#: Odd factor of the multiplicative hash that gives a component its slot; with a power of two as ``dims`` no two of the first ``dims`` collide.
SLOT = 2654435761
#: Odd factor of the hash that gives a component its sign.
SIGN = 2246822519
#: Records to a centre, and the fewest and most centres; beyond the most, cells grow.
CELL, FEWEST, MOST = 1_500, 64, 4_096
#: Rows of a cell that one task holds of either side.
SIDE = 20_000


def hashed_vectors(rows: DataFrame, key: str, values: str, dims: int = 32, length: int | None = None, weights: list[float] | None = None) -> DataFrame:
    """``id, vec``: unit vectors of ``dims`` slots, component j of ``values`` times ``weights[j]`` (1 without) added to slot ``hash(j)`` with a hashed sign.

    Null components are zero.  Null arrays, arrays of another ``length`` if one
    is asked, with NaN or infinite entries or without any other than zero are
    unusable and left out, as are null ids.  Of rows with one id, that are
    supposed equal, the first in order of their values is taken.
    """
    ok = F.col(key).isNotNull() & F.col(values).isNotNull()
    t = rows.where(ok & (F.size(values) == length) if length else ok).select(F.col(key).alias("id"), F.col(values).cast("array<double>").alias("v"))
    t = t.groupBy("id").agg(F.min("v").alias("v"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            owner, place = expand(np.zeros(len(sizes), np.int64), sizes)
            out = np.zeros((len(sizes), dims))
            sign = 1.0 - 2.0 * (((place * SIGN) >> 16) & 1)
            np.add.at(out, (owner, (place * SLOT) % dims), flat * sign * (1.0 if weights is None else np.array([*weights, 1.0])[np.minimum(place, len(weights))]))
            # scaled before squaring, so that neither end of the range of doubles is lost
            with np.errstate(all="ignore"):
                most = np.abs(out).max(1, initial=0)
                fine = np.isfinite(out).all(1) & (most > 0)
                out = out[fine] / most[fine][:, None]
                out /= np.linalg.norm(out, axis=1)[:, None]
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(fine)), vectors(out)], ["id", "vec"])

    return t.mapInArrow(make, f"id {dict(t.dtypes)['id']}, vec array<double>")


def centres_for(n: int) -> int:
    """Centres for ``n`` records, so that cells hold about as many whatever the size."""
    return min(MOST, max(FEWEST, -(-n // CELL)))


def vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def matrix(t: pa.Table, name: str, dims: int) -> np.ndarray:
    return column(t, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row by cosine (the first of equals), and the squared distance of the unit vectors."""
    best, most = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    for at in range(0, len(x), 8192):
        s = x[at : at + 8192] @ centres.T
        best[at : at + 8192] = s.argmax(1)
        most[at : at + 8192] = s.max(1)
    return best, np.maximum(0, 2 - 2 * most)


def seeds(data: DataFrame, k: int, dims: int, rounds: int = 4, oversample: float = 2.0) -> np.ndarray:
    """k centres by k-means||: ``rounds`` times each row is drawn with a chance in proportion to its squared distance.

    Draws come from a hash of id and round, so they never depend on the run.
    About ``oversample k`` rows are drawn a round, weighted by the rows nearest
    to them and reduced to k by weighted k-means++; only these reach the driver.
    """
    first = data.orderBy(F.xxhash64("id")).limit(1).select("vec").collect()
    if not first:
        return np.zeros((0, dims))
    centres = np.array([first[0][0]])
    chance = lambda r: ((F.xxhash64("id", F.lit(r)).bitwiseAND((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("u")

    for r in range(rounds):
        def cost(batches, c=centres):
            total = 0.0
            for t in sized(batches, 10_000):
                total += nearest(matrix(t, "vec", dims), c)[1].sum()
            yield pa.RecordBatch.from_arrays([pa.array([float(total)])], ["cost"])

        phi = data.select("vec").mapInArrow(cost, "cost double").agg(F.sum("cost")).first()[0]
        if not phi:
            break

        def draw(batches, c=centres, phi=phi):
            for t in sized(batches, 10_000):
                x = matrix(t, "vec", dims)
                took = column(t, "u").to_numpy() < oversample * k * nearest(x, c)[1] / phi
                yield pa.RecordBatch.from_arrays([vectors(x[took])], ["vec"])

        drawn = [row[0] for row in data.select("vec", chance(r)).mapInArrow(draw, "vec array<double>").collect()]
        if drawn:
            centres = np.unique(np.vstack([centres, np.array(drawn)]), axis=0)

    weights = assign_stats(data, centres, dims)[1]
    if len(centres) <= k:
        return centres
    rng = np.random.default_rng(len(centres))
    chosen = [int(weights.argmax())]
    gap = np.full(len(centres), np.inf)
    while len(chosen) < k:
        gap = np.minimum(gap, np.maximum(0, 2 - 2 * centres @ centres[chosen[-1]]))
        p = gap * weights
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(p), p=p / p.sum())))
    return centres[chosen]


def assign_stats(data: DataFrame, centres: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors and number of the rows nearest to each centre, added up within tasks first."""
    k = len(centres)

    def part(batches):
        sums, n = np.zeros((k, dims)), np.zeros(k)
        for t in sized(batches, 10_000):
            x = matrix(t, "vec", dims)
            c, _ = nearest(x, centres)
            n += np.bincount(c, minlength=k)
            order = np.argsort(c, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0]) if len(c) else np.zeros(0, int)
            if len(c):
                sums[c[order][starts]] += np.add.reduceat(x[order], starts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), vectors(sums[some])], ["c", "n", "s"])

    out = data.select("vec").mapInArrow(part, "c long, n double, s array<double>")
    out = out.groupBy("c").agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(dims)])
    sums, n = np.zeros((k, dims)), np.zeros(k)
    for row in out.collect():  # k rows
        sums[row[0]], n[row[0]] = row[2:], row[1]
    return sums, n


def kmeans(data: DataFrame, k: int, dims: int, iterations: int = 4) -> np.ndarray:
    """Centres (unit vectors) of spherical k-means over all of ``data`` (``id, vec``); at most k, fewer if rows are."""
    c = seeds(data, k, dims)
    for _ in range(iterations if len(c) else 0):
        sums, n = assign_stats(data, c, dims)
        norm = np.linalg.norm(sums, axis=1)
        moved = np.where((n > 0)[:, None] & (norm > 1e-12)[:, None], sums / np.maximum(norm, 1e-12)[:, None], c)
        if np.abs(moved - c).max() < 1e-9:
            break
        c = moved
    return c


def coalesced(data: DataFrame, centres: np.ndarray, dims: int, within: float) -> np.ndarray:
    """Centres of which those linked by angles below ``within`` are one: the mean of all their rows.

    A group of records that several centres share would be copied to each of
    their cells; with one centre it is a core that needs no comparison.
    """
    if len(centres) < 2:
        return centres
    sums, n = assign_stats(data, centres, dims)
    near = np.clip(centres @ centres.T, -1, 1) > math.cos(within)
    group = np.arange(len(centres))
    while True:  # each takes the least number among its neighbours'
        low = np.where(near, group[None, :], len(centres)).min(1)
        if (low == group).all():
            break
        group = low
    out = []
    for g in np.unique(group):
        total = sums[group == g].sum(0)
        size = np.linalg.norm(total)
        out.append(total / size if n[group == g].sum() and size > 1e-12 else centres[g])
    return np.array(out)


def clusters(data: DataFrame, centres: np.ndarray, dims: int, typical: int = 3) -> DataFrame:
    """``cluster, size, rank, id, cosine``: each cluster's size and its ``typical`` members nearest the centre.

    Members are ranked within tasks first and by id where equally near.
    """
    from pointloom.llm.topn import top_items

    def place(batches):
        for t in sized(batches, 10_000):
            c, d = nearest(matrix(t, "vec", dims), centres)
            yield pa.RecordBatch.from_arrays([column(t, "id"), pa.array(c.astype(np.int32)), pa.array(1 - d / 2)], ["id", "cluster", "cosine"])

    filed = materialize(data.mapInArrow(place, f"id {dict(data.dtypes)['id']}, cluster int, cosine double"))
    sizes = filed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return top_items(filed, ["cluster"], ["cosine"], "id", typical).join(small(sizes), "cluster").select("cluster", "size", "rank", "id", "cosine")


def mutual_clusters(data: DataFrame, centres: np.ndarray, dims: int, cosine: float = 0.9, least: int = 3) -> DataFrame:
    """``cluster_key, id``: members of groups of at least ``least`` rows, all similar to each other and to no row outside.

    Similar is a cosine of at least ``cosine``; the key is the smallest id.  Exact
    for any centres.  A row is filed under its nearest centre (home).  Rows of two
    cells are compared in the home of the one nearer its own centre, so a row only
    visits cells that can hold such a similar row, by its distance from the bisector
    and from the cell's members; rows near their centre visit hardly any.  Two rows
    whose angles to the centre add up to at most the limit are similar without a
    test, so a cell's core (angle up to half the limit) is summed up by plain
    aggregation however large it is; only rows outside it and visitors are compared
    with the cell, in blocks of ``SIDE`` rows.  Each row gets number, smallest id and
    hash sum of the rows similar to it, and a cluster is a set of rows that agree in
    all three, are as many as the number says and whose own hashes have that sum.
    """
    limit = math.acos(cosine)
    k = len(centres)
    kind = dict(data.dtypes)["id"]
    if not k:
        return data.select(F.col("id").alias("cluster_key"), "id").limit(0)

    def widths(batches):
        most = np.zeros(k)
        for t in sized(batches, 10_000):
            x = matrix(t, "vec", dims)
            c, _ = nearest(x, centres)
            np.maximum.at(most, c, angle(x, centres[c]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(most)], ["c", "w"])

    width = np.zeros(k)
    for row in data.select("vec").mapInArrow(widths, "c long, w double").groupBy("c").agg(F.max("w")).collect():  # k rows
        width[row[0]] = row[1]
    reach, between = math.sqrt(2 - 2 * cosine) + 1e-9, np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))

    def file(batches):
        for t in sized(batches, 5_000):
            x = matrix(t, "vec", dims)
            s = np.clip(x @ centres.T, -1, 1)
            home = s.argmax(1)
            d2, a = 2 - 2 * s, np.arccos(s)
            mine = d2[np.arange(len(x)), home][:, None]
            with np.errstate(all="ignore"):
                off = (d2 - mine) / (2 * between[home])
            own = angle(x, centres[home])
            to = (a <= limit + np.minimum(width[None, :], own[:, None]) + 1e-9) & ~(off > reach)
            to[np.arange(len(x)), home] = True
            row, cell = np.nonzero(to)
            at_home = home[row] == cell
            yield pa.RecordBatch.from_arrays(
                [column(t, "id").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(at_home), pa.array(~at_home | (own[row] > limit / 2 - 1e-9)), pa.array(own[row]), vectors(x[row])],
                ["id", "cell", "home", "fringe", "own", "vec"],
            )

    filed = materialize(data.mapInArrow(file, f"id {kind}, cell int, home boolean, fringe boolean, own double, vec array<double>").withColumn("h", F.shiftright(F.xxhash64("id"), 20)))
    core = filed.where("not fringe").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"), F.sum("h").alias("hs"))
    sure = filed.where("not fringe").select("id", "cell").join(F.broadcast(core), "cell").select("id", "n", "m", "hs")  # k rows

    parts = filed.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / SIDE).cast("int").alias("np"), F.ceil(F.sum(F.col("fringe").cast("int")) / SIDE).cast("int").alias("nf")).where("nf > 0 and np > 0")
    cut = filed.join(F.broadcast(parts), "cell")  # k rows
    mark = F.xxhash64("id", F.lit(1))
    left = cut.where("home").withColumns({"i": F.pmod(mark, F.col("np")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("nf") - 1)), "left": F.lit(True)})
    right = cut.where("fringe").withColumns({"j": F.pmod(mark, F.col("nf")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("np") - 1)), "left": F.lit(False)})
    cols = ["cell", "i", "j", "left", "home", "fringe", "own", "id", "h", "vec"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.left].sort_values("id"), pdf[~pdf.left].sort_values("id")
        out = []
        if len(a) and len(b):
            xa, xb = np.stack(a.vec.to_numpy()), np.stack(b.vec.to_numpy())
            ia, ib, ha, hb = a.id.to_numpy(), b.id.to_numpy(), a.h.to_numpy(), b.h.to_numpy()
            oa, ob, inner, guest = a.own.to_numpy(), b.own.to_numpy(), ~a.fringe.to_numpy(), ~b.home.to_numpy()
            for s in slabs(np.full(len(a), len(b)), 2_000_000):
                sim = xa[s] @ xb.T >= cosine
                # of a home row and a guest, this is the home of the one nearer its centre, or of the smaller id
                first = (oa[s][:, None] < ob) | ((oa[s][:, None] == ob) & (ia[s][:, None] < ib))
                mine = sim & (~guest | first)
                out.append(summed(mine, ia[s], ib, hb))
                out.append(summed((mine & (guest | inner[s][:, None])).T, ib, ia[s], ha[s]))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": [], "m": [], "hs": []})

    tested = apply_groups(left.select(cols).unionByName(right.select(cols)), ["cell", "i", "j"], compare, f"id {kind}, n long, m {kind}, hs long")
    per = sure.unionByName(tested).groupBy("id").agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.sum("hs").alias("hs"))
    per = materialize(per.where(F.col("n") >= least))
    own = F.sum(F.shiftright(F.xxhash64("id"), 20))
    groups = per.groupBy("m", "n", "hs").agg(F.count(F.lit(1)).alias("c"), own.alias("own")).where("c = n and own = hs").drop("c", "own")
    return per.join(small(groups), ["m", "n", "hs"]).select(F.col("m").alias("cluster_key"), "id")


def angle(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, row by row; exact for small ones too."""
    return 2 * np.arcsin(np.minimum(1, np.linalg.norm(x - c, axis=1) / 2))


def summed(sim: np.ndarray, own: np.ndarray, other: np.ndarray, h: np.ndarray) -> pd.DataFrame:
    """For each of ``own`` with a similar one among ``other`` (sorted): how many, the smallest, and the sum of hashes."""
    row, col = np.nonzero(sim)
    if not len(row):
        return pd.DataFrame({"id": own[:0], "n": np.zeros(0, np.int64), "m": other[:0], "hs": np.zeros(0, np.int64)})
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return pd.DataFrame({"id": own[row[at]], "n": np.diff(np.r_[at, len(row)]), "m": other[col[at]], "hs": np.add.reduceat(h[col], at)})
