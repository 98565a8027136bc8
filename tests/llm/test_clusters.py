import math

import numpy as np
import pytest

from pointloom.llm import clusters as C

UNITS = "unit_id string, dense array<float>, vec string"


def brute(rows, cos=0.9, length=8):
    vec = {}
    for u, d, *_ in rows:
        if u is None or d is None or len(d) != length:
            continue
        v = np.array([0.0 if x is None else x for x in np.array(d, object)], float)
        if np.isfinite(v).all() and v.any():
            vec[u] = v / np.linalg.norm(v)
    ids = sorted(vec)
    x = np.array([vec[i] for i in ids])
    near = x @ x.T >= cos
    out = set()
    for i in range(len(ids)):
        s = np.flatnonzero(near[i])
        if len(s) >= 3 and all((near[j] == near[i]).all() for j in s):
            out.add((ids[s[0]], ids[i]))
    return out


def planted(seed, spread):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(9):
        centre = np.abs(rng.normal(size=8))
        for _ in range(int(rng.integers(1, 25))):
            v = centre + rng.normal(0, spread * np.linalg.norm(centre), 8)
            rows.append((f"{rng.integers(1e9):09d}", [float(t) for t in v * rng.uniform(0.1, 50)], "clash"))
    return rows


@pytest.mark.parametrize("seed,spread,k,side", [(0, 0.03, 5, C.SIDE), (1, 0.12, 3, 4), (2, 0.08, 30, C.SIDE), (3, 0.3, 1, 4)])
def test_mutual_clusters_are_exact(spark, monkeypatch, side, seed, spread, k):
    monkeypatch.setattr(C, "SIDE", side)
    rows = planted(seed, spread)
    rows += rows[:5]  # sent again
    rows += [("same1", rows[0][1], ""), ("same2", rows[0][1], ""), ("null", None, ""), ("short", [1.0], ""), ("zero", [0.0] * 8, ""), ("nan", [math.nan] + [1.0] * 7, ""), ("inf", [math.inf] + [1.0] * 7, ""), (None, [1.0] * 8, "")]
    rows += [("part", [None, 1.0] + [0.0] * 6, ""), ("tiny", [1e-30, 1e-30] + [0.0] * 6, "")]
    data = C.hashed_vectors(spark.createDataFrame(rows, UNITS), "unit_id", "dense", 8, 8).cache()
    centres = C.kmeans(data, k, 8)
    for c in (centres, C.coalesced(data, centres, 8, 0.15)):
        got = [tuple(r) for r in C.mutual_clusters(data, c, 8).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_hashing_keeps_cosines(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{i}", [float(v) for v in rng.normal(size=32)], "") for i in range(20)]
    got = {r.id: np.array(r.vec) for r in C.hashed_vectors(spark.createDataFrame(rows, UNITS), "unit_id", "dense", 32).collect()}
    for a, b in zip(rows, rows[1:]):
        u, v = np.array(a[1]), np.array(b[1])
        assert abs(got[a[0]] @ got[b[0]] - u @ v / np.linalg.norm(u) / np.linalg.norm(v)) < 1e-5


def test_kmeans_finds_groups_and_members(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{c}-{i}", [float(v) for v in np.eye(8)[c] + rng.normal(0, 0.05, 8)], "") for c in range(5) for i in range(40)]
    data = C.hashed_vectors(spark.createDataFrame(rows, UNITS), "unit_id", "dense", 8).cache()
    centres = C.kmeans(data, 5, 8)
    assert len(centres) == 5
    out = C.clusters(data, centres, 8, typical=4).collect()
    by = {}
    for r in out:
        by.setdefault(r.cluster, []).append(r)
    assert len(by) == 5
    for members in by.values():
        assert len(members) == 4 and {m.size for m in members} == {40} and len({m.id[0] for m in members}) == 1
        assert [m.cosine for m in sorted(members, key=lambda m: m["rank"])] == sorted((m.cosine for m in members), reverse=True)


def test_nothing(spark):
    data = C.hashed_vectors(spark.createDataFrame([], UNITS), "unit_id", "dense", 8)
    assert len(C.kmeans(data, 3, 8)) == 0 and C.mutual_clusters(data, np.zeros((0, 8)), 8).count() == 0
