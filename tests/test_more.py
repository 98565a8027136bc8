import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import pairs, stats
from pointloom.models import kmeans
from pointloom.operators import enrichment as E
from pointloom.operators import filters as X
from pointloom.operators import hotkeys, raster
from pointloom.operators import joins as J
from pointloom.operators import ranks as R

KP = "array<struct<k int, p double>>"


def test_kmeans_separates_groups_whatever_the_partitions(spark):
    at = [(-3.0, -3.0), (-2.8, -3.1), (-3.2, -2.9), (3.0, 3.0), (2.8, 3.1), (3.2, 2.9), (0.0, 0.1), (0.0, -0.1)]
    rows = [(i, list(v)) for i, v in enumerate(at)] + [(90, None), (91, [1.0]), (92, [math.nan, 0.0]), (93, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("cluster", F.lit("clash"))
    one, n, cost = kmeans.fit(df.repartition(1), 3, 2)
    two, _, _ = kmeans.fit(df.repartition(4), 3, 2)
    assert np.allclose(one, two, atol=1e-12) and sorted(n) == [2, 3, 3] and cost < 0.3
    got = {r.id: r.cluster for r in kmeans.assign(df, one, "id").collect()}
    assert set(got) == set(range(8)) and len({got[0], got[3], got[6]}) == 3 and got[0] == got[1] == got[2]
    same = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)], "id long, vec array<double>")
    centres, n, cost = kmeans.fit(same, 3, 2)
    assert len(centres) == 1 and n.tolist() == [5] and cost == 0
    assert len(kmeans.fit(same.limit(0), 3, 2)[0]) == 0 and kmeans.assign(same.limit(0), centres, "id").count() == 0


def test_an_empty_cluster_gets_the_farthest_row(spark):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0, 1, 10, 11, 30])], "id long, vec array<double>")
    sums, n, _, far = kmeans._step(df, np.array([[0.0], [100.0]]), 2)
    assert n.tolist() == [6, 0] and far[0] == (900.0, [30.0])
    centres, n, _ = kmeans.fit(df, 3, 1)
    assert (n > 0).all() and sorted(centres.ravel().tolist()) == pytest.approx([1 / 3, 10.5, 30])


def even_odd(x, y, rings):
    inside = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                inside = not inside
    return inside


def test_repaired_rings_are_simple_and_enclose_the_same():
    rng = np.random.default_rng(3)
    cases = [[(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (2, 0), (2, 3)], [], [(0, 0), (1, 1)], [(0, 0), (2, 0), (4, 0)]]
    cases += [[tuple(map(float, p)) for p in rng.integers(0, 9, (int(rng.integers(3, 11)), 2))] for _ in range(60)]
    for ring in cases:
        out = X.repaired_ring(ring)
        for r in out:
            assert len(r) >= 3 and len(set(r)) == len(r)
            for i, j in combinations(range(len(r)), 2):
                if j - i in (1, len(r) - 1):
                    continue
                (a, b), (c, d) = (r[i], r[(i + 1) % len(r)]), (r[j], r[(j + 1) % len(r)])
                cross = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
                s = [cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)]
                assert not (s[0] * s[1] < -1e-6 and s[2] * s[3] < -1e-6)
        for x, y in rng.uniform(0, 9, (60, 2)):
            assert even_odd(x, y, out) == even_odd(x, y, [ring]) if ring else not out
    assert X.repaired_ring([(0, 0), (1, 1)]) == [] and len(X.repaired_ring(cases[0])) == 2


def test_relations_of_rectangles(spark):
    boxes = [(5.0, 9.0, 0.0, 1.0), (1.0, 2.0, 1.0, 2.0), (-1.0, 9.0, -1.0, 9.0), (2.0, 6.0, 2.0, 6.0), (4.0, 5.0, 0.0, 4.0), (0.0, 4.0, 0.0, 4.0)]
    df = spark.createDataFrame(boxes, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(X.relation(tuple(F.col(c) for c in "abcd"), (0.0, 4.0, 0.0, 4.0))).collect()]
    assert got == [0, 2, 3, 1, 0, 2]


def test_pixel_states_equal_brute_force(spark):
    ring = [(0.0, 0.0), (30.0, 2.0), (24.0, 28.0), (3.0, 22.0)]
    df = spark.createDataFrame([("s", ring), ("s", None), ("s", [])], "sample_id string, ring array<struct<x double, y double>>")
    got = {(r.px, r.py): r.state for r in raster.pixel_states(df, 2.0).collect()}
    inside = lambda x, y: even_odd(x, y, [ring])
    for px in range(-6, 20):
        for py in range(-6, 20):
            around = [inside(2 * (px + dx) + fx, 2 * (py + dy) + fy) for dx in range(-2, 3) for dy in range(-2, 3) for fx in (0.01, 1, 1.99) for fy in (0.01, 1, 1.99)]
            if got.get((px, py)) == "interior":
                assert all(around)
            elif (px, py) not in got:
                assert not any(around)
    assert Counter(got.values()).keys() == {"interior", "boundary"}


def test_molecules_merge_by_name(spark):
    a = spark.createDataFrame([(0, 0, "Ab ", [(1, 0.5)]), (0, 0, "cd", [(2, 0.5)]), (1, 0, "cd", [(3, 0.5)]), (1, 1, None, [(4, 1.0)])], f"px long, py long, feature string, kp {KP}")
    b = spark.createDataFrame([(0, 0, "aB", [(7, 0.25)]), (0, 0, "ef", [(6, 0.25)]), (0, 0, None, [(5, 0.25)])], f"px long, py long, feature string, kp {KP}")
    first = lambda kp: kp[0].k if kp else None
    rows = lambda keep: {(r.px, r.py, r.feature, first(r.kp_0), first(r.kp_1)) for r in J.merge(a, [(b, 2)], keep=keep, feature=True).collect()}
    assert rows("inner") == {(0, 0, "ab", 1, 7)}
    assert rows("main") == {(0, 0, "ab", 1, 7), (0, 0, "cd", 2, None), (1, 0, "cd", 3, None)}
    assert rows("all") == rows("main") | {(0, 0, "ef", None, 6)}


def test_contrasts_and_their_errors(spark):
    assert E.contrasts(["a", "b", "c"]) == [("a_vs_b", "a", 0), ("a_vs_b", "b", 1), ("a_vs_c", "a", 0), ("a_vs_c", "c", 1), ("b_vs_c", "b", 0), ("b_vs_c", "c", 1)]
    assert E.contrasts(["a", "b", "c"], {"x": {"a": -1, "b": 0, "c": 1}}) == [("x", "a", 0), ("x", "c", 1)]
    for bad in ({"a": -1}, {"a": -1, "z": 1}, {"a": -1, "b": 2}):
        with pytest.raises(ValueError):
            E.contrasts(["a", "b"], {"x": bad})
    u = spark.createDataFrame([(s, 0, f"{s}{i}", f, 1 + i % 3) for s in "ab" for i in range(6) for f in "xy"], "sample string, factor int, unit string, feature string, y int")
    got = E.contrast_de(u, E.contrasts(["a", "b"])).collect()
    assert {(r.contrast, r.feature) for r in got} == {("a_vs_b", "x"), ("a_vs_b", "y")} and all(abs(r.beta) < 1e-9 for r in got)
    assert E.contrast_de(u, []).count() == 0


def test_confusion_is_symmetric_and_spreads_the_rest(spark):
    df = spark.createDataFrame([([(0, 0.5), (2, 0.25)],), ([(1, 1.0)],), ([],)], f"kp {KP}")
    got = {(r.k1, r.k2): r.mass for r in E.pixel_confusion(df, 3).collect()}
    rest = (0.25**2 + 1) / 9
    want = {(0, 0): 0.25, (2, 2): 0.0625, (0, 2): 0.125, (2, 0): 0.125, (1, 1): 1.0}
    assert {k: pytest.approx(want.get(k, 0) + rest) for k in got} == got and len(got) == 9


def test_entropies_distances_and_edits(spark):
    sim = [[1.0, 0.5], [0.5, 1.0]]
    df = spark.createDataFrame([([(0, 0.5), (1, 0.5)],), ([(0, 2.0)],), ([],)], f"kp {KP}")
    got = [r[0] for r in df.select(pairs.sensitive_entropy("kp", sim)).collect()]
    assert [(round(r.lcr, 9), round(r.q, 9)) for r in got] == [(round(-math.log(0.75), 9), 0.25), (0.0, 0.0), (0.0, 0.0)]
    b = spark.createDataFrame([([0.25, 0.75], [0.25, 0.75]), ([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5])], "p array<double>, q array<double>")
    assert [round(r[0], 9) for r in b.select(stats.bhattacharyya("p", "q")).collect()] == [1.0, 0.0, 0.5]
    x = stats.to_simplex(np.array([[0.5, 0.5, 0.0], [2.0, 0.0, 0.0], [-1.0, -1.0, -1.0], [0.4, 0.3, 0.9]]))
    assert np.allclose(x.sum(1), 1) and (x >= 0).all() and np.allclose(x[0], [0.5, 0.5, 0]) and np.allclose(x[1], [1, 0, 0]) and np.allclose(x[3], [0.2, 0.1, 0.7])
    assert stats.local_edits("abc", "xxabcxx") == (0, 5) and stats.local_edits("abc", "xxaxcxx") == (1, 5) and stats.local_edits("", "x") == (0, 0) and stats.local_edits("ab", "") == (2, 0)


def test_median_and_similarity(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("c", None), (None, 4.0)], "k string, v double")
    assert {(r.k, r["median"], r["mad"]) for r in hotkeys.median_mad(df, "k", "v").collect()} == {("a", 2.0, 1.0), ("b", 5.0, 0.0), ("c", None, None), (None, 4.0, 0.0)}
    bulk = spark.createDataFrame([(0, "x", 1), (0, "y", 3), (1, "x", 1), (1, "y", 3), (2, "z", 2), (2, "x", 0)], "factor int, feature string, n long")
    assert {(r.a, r.b): round(r.coefficient, 9) for r in R.profile_similarity(bulk).collect()} == {(0, 1): 1.0}
