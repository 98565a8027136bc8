import numpy as np

from pointloom.operators import graph, raster

SCHEMA = "px int, py int, label int, p double"


def table(spark, grid):
    return spark.createDataFrame([(x, y, int(v), 0.5) for (y, x), v in np.ndenumerate(np.array(grid)) if v >= 0], SCHEMA)


def test_odd_centre_flips(spark):
    got = {(r.px, r.py): r.label for r in raster.smooth(table(spark, [[1, 1, 1], [1, 2, 1], [1, 1, 1]])).collect()}
    assert set(got.values()) == {1} and len(got) == 9
    filled = raster.smooth(table(spark, [[1, 1, 1], [1, -1, 1], [1, 1, 1]]), fill=True).where("px = 1 and py = 1").collect()
    assert [r.label for r in filled] == [1]


def test_components_cross_seams(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(-1, 3, (23, 19))
    got = {(r.px, r.py): r.component for r in raster.label_components(table(spark, g), 5).collect()}
    whole = raster.flood(g.astype(np.int64))
    assert len(got) == (g >= 0).sum()
    groups = {}
    for (y, x), v in np.ndenumerate(whole):
        if v >= 0:
            groups.setdefault(v, set()).add(got[x, y])
    assert all(len(s) == 1 for s in groups.values()) and len({next(iter(s)) for s in groups.values()}) == len(groups)


def test_graph_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)] + [(300, i) for i in range(301, 360)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200 and all(got[i] == 300 for i in range(300, 360))


def test_window_sums_and_outline(spark):
    g = np.ones((12, 9), int)
    t = table(spark, g)
    w = {(r.px, r.py): r.window for r in raster.window_sums(t, "label", 2, 4).collect()}
    for (y, x), _ in np.ndenumerate(g):
        assert w[x, y] == (min(11, y + 2) - max(0, y - 2) + 1) * (min(8, x + 2) - max(0, x - 2) + 1)
    hole = [[1, 1, 1], [1, -1, 1], [1, 1, 1]]
    rings = raster.outlines(raster.label_components(table(spark, hole), 8)).collect()
    assert sorted(r.area for r in rings) == [-1.0, 9.0]
    assert sorted(len(r.ring) for r in rings) == [4, 4]


def test_shells(spark):
    rings = {(r.label, r.other, r.d): r.n for r in raster.shells(table(spark, [[1, 2, 2, 3]]), 2).collect()}
    assert rings == {(1, 2, 1): 1, (1, 2, 2): 1, (2, 1, 1): 1, (2, 3, 1): 1, (3, 2, 1): 1, (3, 2, 2): 1}
