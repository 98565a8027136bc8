"""Label rasters: smoothing, contacts, components, shells, masks, outlines.

A raster is a sparse table of pixels ``px, py, label`` (with ``p`` where asked),
by the columns ``by``; pixels that are missing are background.  Neighbourhoods of
one pixel are joins on integer keys; wider windows are dense arrays of one tile
with a halo, worked on in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.graph import components as linked
from pointloom.operators.groups import apply_groups
from pointloom.session import materialize, small

AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
CROSS = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def labels(anno: DataFrame, by: list[str] = ()) -> DataFrame:
    """The most probable factor of each pixel; the smaller one of equals."""
    e = anno.select(*by, "px", "py", F.explode("kp").alias("e"))
    top = e.groupBy(*by, "px", "py").agg(F.max(F.struct(F.col("e.p").alias("p"), (-F.col("e.k")).alias("k"))).alias("m"))
    return top.select(*by, "px", "py", (-F.col("m.k")).cast("int").alias("label"), F.col("m.p").alias("p"))


def _moves(steps: list[tuple[int, int]]):
    """Rows repeated for each step, which is column ``m`` with its number ``i``."""
    return F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(i).alias("i")) for i, (dx, dy) in enumerate(steps)]))


def _tile(c: str, size: int):
    return F.floor(F.col(c) / size)


def smooth(raster: DataFrame, rounds: int = 1, tile: int | None = None, fill: bool = False, by: list[str] = ()) -> DataFrame:
    """Labels after ``rounds`` of voting by the 8 neighbours (of the same ``tile`` if given).

    A pixel takes the label most of its neighbours have if at most one has its own
    and the others are more than three ahead; of equal labels the one met first
    going by rows wins, and the least probability of its votes is the new one.
    With ``fill`` missing pixels get the label of more than three neighbours.
    """
    for _ in range(rounds):
        v = raster.withColumn("m", _moves([(-dx, -dy) for dx, dy in AROUND]))
        q = v.select(*by, (F.col("px") + F.col("m.dx")).alias("qx"), (F.col("py") + F.col("m.dy")).alias("qy"), "px", "py", F.col("label").alias("vote"), F.col("p").alias("vp"), "m.i")
        if tile:
            same = (_tile("qx", tile) == _tile("px", tile)) & (_tile("qy", tile) == _tile("py", tile))
            q = q.where(same)
        votes = q.groupBy(*by, F.col("qx").alias("px"), F.col("qy").alias("py"), "vote").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i"), F.min("vp").alias("vp"))
        best = votes.groupBy(*by, "px", "py").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), "vote", "vp")).alias("b"), F.collect_list(F.struct("vote", "n")).alias("all"))
        t = raster.join(best, [*by, "px", "py"], "full" if fill else "left")
        own = F.coalesce(F.aggregate("all", F.lit(0).cast("long"), lambda a, e: a + F.when(e["vote"] == F.col("label"), e["n"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))
        turn = F.coalesce((own <= 1) & (F.col("b.n") - own > 3) & (F.col("label").isNull() | (F.col("b.vote") != F.col("label"))), F.lit(False))
        t = t.withColumn("turn", turn)
        turn = F.col("turn")
        raster = t.select(*by, "px", "py", F.when(turn, F.col("b.vote")).otherwise(F.col("label")).alias("label"), F.when(turn, F.col("b.vp")).otherwise(F.col("p")).alias("p")).where("label is not null")
        if rounds > 1:
            raster = materialize(raster)
    return raster


def edges(raster: DataFrame, background: int, tile: int | None = None, by: list[str] = ()) -> DataFrame:
    """Sides between two neighbouring pixels of different labels, counted once: ``l1 < l2, n``.

    Missing pixels have the label ``background``; with ``tile`` only sides within a tile count.
    """
    q = raster.withColumn("m", _moves(CROSS)).select(*by, (F.col("px") + F.col("m.dx")).alias("qx"), (F.col("py") + F.col("m.dy")).alias("qy"), "px", "py", "label")
    if tile:
        q = q.where((_tile("qx", tile) == _tile("px", tile)) & (_tile("qy", tile) == _tile("py", tile)))
    o = raster.select(*by, F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("label").alias("other"))
    j = q.join(o, [*by, "qx", "qy"], "left").withColumn("other", F.coalesce("other", F.lit(background))).where("label != other")
    # a side between two pixels is seen from both, one to the background once
    half = F.when(F.col("other") == background, 2).otherwise(1)
    return j.groupBy(*by, F.least("label", "other").alias("l1"), F.greatest("label", "other").alias("l2")).agg((F.sum(half) / 2).cast("long").alias("n"))


def metrics(raster: DataFrame, background: int, tile: int | None = None, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Per label its area and perimeter; per pair of labels the contact, its share of either perimeter and its density."""
    e = edges(raster, background, tile, by)
    area = raster.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("area"))
    side = e.select(*by, F.explode(F.array("l1", "l2")).alias("label"), "n").groupBy(*by, "label").agg(F.sum("n").alias("perimeter"))
    one = area.join(side, [*by, "label"], "full").select(*by, "label", F.coalesce("area", F.lit(0)).alias("area"), F.coalesce("perimeter", F.lit(0)).alias("perimeter"))
    a = one.select(*by, F.col("label").alias("l1"), F.col("area").alias("a1"), F.col("perimeter").alias("p1"))
    b = one.select(*by, F.col("label").alias("l2"), F.col("area").alias("a2"), F.col("perimeter").alias("p2"))
    two = e.join(small(a), [*by, "l1"]).join(small(b), [*by, "l2"])
    most = lambda x: F.greatest(F.lit(1), x)
    two = two.select(*by, "l1", "l2", F.col("n").alias("contact"), (F.col("n") / most(F.col("p1"))).alias("frac1"), (F.col("n") / most(F.col("p2"))).alias("frac2"),
                     (F.col("n") / most(F.col("p1") + F.col("p2") - F.col("n"))).alias("frac0"), (F.col("n") / most(F.least("a1", "a2"))).alias("density"))
    return one, two


def label_components(raster: DataFrame, tile: int = 256, by: list[str] = ()) -> DataFrame:
    """``raster`` with ``component``: 4-connected pixels of one label share the code of their first pixel.

    Each tile is labelled by itself, then components that touch across a seam are
    joined by ``graph.components``.  A tile is at most ``tile`` squared pixels, so no
    task holds more, and only seam links take part in the distributed step.
    """
    names = list(by)
    t = raster.select(*by, "px", "py", "label").withColumns({"tx": _tile("px", tile), "ty": _tile("py", tile)})
    kinds = dict(raster.dtypes)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.tx.iloc[0]) * tile, int(pdf.ty.iloc[0]) * tile
        x, y = pdf.px.to_numpy() - x0, pdf.py.to_numpy() - y0
        grid_ = np.full((tile, tile), -1, np.int64)
        grid_[y, x] = pdf.label.to_numpy()
        first = flood(grid_)
        v = first[y, x]
        pdf["piece"] = ((v // tile + y0) + (1 << 30)) * (1 << 31) + (v % tile + x0) + (1 << 30)
        return pdf

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], f"px {kinds['px']}, py {kinds['py']}, label {kinds['label']}, tx bigint, ty bigint, piece bigint"])
    pieces = materialize(apply_groups(t, [*by, "tx", "ty"], local, schema))
    last = tile - 1
    border = pieces.where((F.pmod("px", F.lit(tile)) == last) | (F.pmod("py", F.lit(tile)) == last))
    seam = border.withColumn("m", _moves([(1, 0), (0, 1)])).select(*by, (F.col("px") + F.col("m.dx")).alias("px"), (F.col("py") + F.col("m.dy")).alias("py"), "label", F.col("piece").alias("a"), F.col("tx").alias("sx"), F.col("ty").alias("sy"))
    links = seam.join(pieces, [*by, "px", "py", "label"]).where("sx != tx or sy != ty")
    node = lambda c: F.concat_ws("|", *[F.col(x).cast("string") for x in names], F.lpad(F.col(c).cast("string"), 20, "0"))
    joined = linked(links.select(node("a").alias("a"), node("piece").alias("b")))
    out = pieces.withColumn("node", node("piece")).join(joined, "node", "left")
    found = F.coalesce(F.substring_index("component", "|", -1).cast("bigint"), F.col("piece"))
    return out.select(*by, "px", "py", "label", found.alias("component"))


def flood(grid_: np.ndarray) -> np.ndarray:
    """For each cell the first cell (row by row) of its 4-connected area of equal values; -1 where negative."""
    n, m = grid_.shape
    first = np.arange(n * m).reshape(n, m)
    first[grid_ < 0] = n * m
    right, down = (grid_[:, 1:] == grid_[:, :-1]) & (grid_[:, 1:] >= 0), (grid_[1:] == grid_[:-1]) & (grid_[1:] >= 0)
    a = np.r_[np.flatnonzero(np.pad(right, ((0, 0), (0, 1)))), np.flatnonzero(np.pad(down, ((0, 1), (0, 0))))]
    b = np.r_[np.flatnonzero(np.pad(right, ((0, 0), (0, 1)))) + 1, np.flatnonzero(np.pad(down, ((0, 1), (0, 0)))) + m]
    root = np.arange(n * m + 1)
    while len(a):  # hook the larger root to the smaller, then shorten all paths
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    out = root[np.arange(n * m)].reshape(n, m)
    out[grid_ < 0] = -1
    return out


def hard_masks(raster: DataFrame, least: int, tile: int = 256, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Components of at least ``least`` pixels, ``label, component, size``, and how many there are of each size."""
    c = label_components(raster, tile, by)
    sizes = c.groupBy(*by, "label", "component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return sizes, sizes.groupBy(*by, "label", "size").agg(F.count(F.lit(1)).alias("n"))


def shells(raster: DataFrame, reach: int, least: int = 1, tile: int = 256, by: list[str] = ()) -> DataFrame:
    """What lies around each label: ``label, other, d, n``, pixels of other labels ``d`` steps (1 to ``reach``) away.

    Steps go to the 4 neighbours, from the components of at least ``least`` pixels,
    and not through the label itself.  One round a step: the frontier joined with
    the raster, without what was reached before.
    """
    key = [*by, "px", "py"]
    c = label_components(raster, tile, by)
    big = c.groupBy(*by, "component", "label").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= least)
    front = c.join(big.select(*by, "component", "label"), [*by, "component", "label"], "left_semi").select(*key, F.col("label").alias("seed"))
    seen = raster.select(*key, F.col("label").alias("seed"))
    cells = raster.select(*key, F.col("label").alias("other"))
    rings = None
    for d in range(1, reach + 1):
        step = front.withColumn("m", _moves(CROSS)).select(*by, (F.col("px") + F.col("m.dx")).alias("px"), (F.col("py") + F.col("m.dy")).alias("py"), "seed").distinct()
        new = step.join(cells, key).join(seen, [*key, "seed"], "left_anti")
        new = materialize(new.select(*key, "seed", "other", F.lit(d).alias("d")))
        rings = new if rings is None else rings.unionByName(new)
        seen = seen.unionByName(new.select(*key, "seed"))
        front = new.select(*key, "seed")
    return rings.groupBy(*by, F.col("seed").alias("label"), "other", "d").agg(F.count(F.lit(1)).alias("n"))


def window_sums(pixels: DataFrame, value: str, radius: int, tile: int = 256, by: list[str] = ()) -> DataFrame:
    """Sum of ``value`` over the (2 r + 1)^2 window of every pixel given, by running sums on tiles with a halo."""
    names = list(by)
    edge = (F.pmod("px", F.lit(tile)) < radius) | (F.pmod("px", F.lit(tile)) >= tile - radius) | (F.pmod("py", F.lit(tile)) < radius) | (F.pmod("py", F.lit(tile)) >= tile - radius)
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile))
    to = F.when(edge, F.flatten(F.transform(span("px"), lambda a: F.transform(span("py"), lambda b: F.struct(a.alias("tx"), b.alias("ty")))))).otherwise(F.array(F.struct(_tile("px", tile).alias("tx"), _tile("py", tile).alias("ty"))))
    t = pixels.select(*by, "px", "py", F.col(value).cast("double").alias("v"), F.explode(to).alias("t")).select(*by, "px", "py", "v", "t.tx", "t.ty")
    kinds = dict(pixels.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.tx.iloc[0]) * tile, int(pdf.ty.iloc[0]) * tile
        x, y, side = pdf.px.to_numpy() - x0 + radius, pdf.py.to_numpy() - y0 + radius, tile + 2 * radius
        g = np.zeros((side + 1, side + 1))
        np.add.at(g, (y + 1, x + 1), pdf.v.to_numpy())
        s = g.cumsum(0).cumsum(1)
        own = (x >= radius) & (x < tile + radius) & (y >= radius) & (y < tile + radius)
        x, y = x[own], y[own]
        w = s[y + radius + 1, x + radius + 1] - s[y - radius, x + radius + 1] - s[y + radius + 1, x - radius] + s[y - radius, x - radius]
        return pdf[own][[*names, "px", "py", "v"]].assign(window=w)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], f"px {kinds['px']}, py {kinds['py']}, v double, window double"])
    return apply_groups(t, [*by, "tx", "ty"], run, schema)


def soft_mask(anno: DataFrame, focal: int, radius: int, share: float, least_mass: float = 1.0, least_p: float = 0.0, tile: int = 256, by: list[str] = ()) -> DataFrame:
    """Pixels of the soft mask of factor ``focal``: its share of all mass in the window around is at least ``share``.

    Windows with less than ``least_mass`` in all are left out; probabilities below
    ``least_p`` don't count for the factor.
    """
    own = F.aggregate("kp", F.lit(0.0), lambda a, e: a + F.when((e["k"] == focal) & (e["p"] >= least_p), e["p"]).otherwise(F.lit(0.0)))
    all_ = F.aggregate("kp", F.lit(0.0), lambda a, e: a + e["p"])
    base = anno.select(*by, "px", "py", own.alias("own"), all_.alias("all"))
    a = window_sums(base, "own", radius, tile, by).select(*by, "px", "py", F.col("window").alias("w"))
    b = window_sums(base, "all", radius, tile, by).select(*by, "px", "py", F.col("window").alias("t"))
    return a.join(b, [*by, "px", "py"]).where((F.col("t") >= least_mass) & (F.col("w") >= share * F.col("t"))).select(*by, "px", "py", "w", "t")


def grown(mask: DataFrame, steps: int, by: list[str] = ()) -> DataFrame:
    """The mask dilated (``steps`` > 0) or eroded (< 0) by single steps to the 8 neighbours; erosion keeps pixels with all nine."""
    mask = mask.select(*by, "px", "py")
    for _ in range(abs(steps)):
        n = mask.withColumn("m", _moves([*AROUND, (0, 0)])).select(*by, (F.col("px") + F.col("m.dx")).alias("px"), (F.col("py") + F.col("m.dy")).alias("py"))
        n = n.groupBy(*by, "px", "py").agg(F.count(F.lit(1)).alias("n"))
        mask = (n if steps > 0 else n.where("n = 9")).select(*by, "px", "py")
    return mask


def mask_composition(anno: DataFrame, masks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mass of each factor within each mask (``focal, px, py``; masks may overlap), and in all pixels as focal -1."""
    e = anno.select(*by, "px", "py", F.explode("kp").alias("e"))
    inside = e.join(masks.select(*by, "px", "py", "focal"), [*by, "px", "py"]).select("focal", F.col("e.k").alias("k"), F.col("e.p").alias("p"))
    whole = e.select(F.lit(-1).alias("focal"), F.col("e.k").alias("k"), F.col("e.p").alias("p"))
    return inside.unionByName(whole).groupBy("focal", "k").agg(F.sum("p").alias("mass"))


def mask_profile(anno: DataFrame, focal: int, radius: int, threshold: float, others: list[int] = (), tile: int = 256, by: list[str] = ()) -> DataFrame:
    """``k, inside, overall, overlap`` of the mask of one factor: pixels whose window holds at least ``threshold`` of it a pixel.

    ``inside`` and ``overall`` are a factor's mass in the mask and in all pixels;
    ``overlap`` counts the pixels of the mask that also lie in the mask of each of
    ``others`` (null for other factors).
    """
    least = threshold * (2 * radius + 1) ** 2

    def mask(k: int) -> DataFrame:
        own = anno.select(*by, "px", "py", F.aggregate("kp", F.lit(0.0), lambda a, e: a + F.when(e["k"] == k, e["p"]).otherwise(0.0)).alias("own"))
        return window_sums(own, "own", radius, tile, by).where(F.col("window") >= least).select(*by, "px", "py")

    key = [*by, "px", "py"]
    m = materialize(mask(focal))
    e = anno.join(m.withColumn("held", F.lit(1)), key, "left").select("held", F.explode("kp").alias("e"))
    sums = e.groupBy(F.col("e.k").alias("k")).agg(F.sum(F.when(F.col("held") == 1, F.col("e.p")).otherwise(0.0)).alias("inside"), F.sum("e.p").alias("overall"))
    shared = None
    for k in others:
        n = mask(k).join(m, key, "left_semi").agg(F.count(F.lit(1)).alias("overlap")).select(F.lit(k).cast("int").alias("k"), "overlap")
        shared = n if shared is None else shared.unionByName(n)
    if shared is None:
        return sums.withColumn("overlap", F.lit(None).cast("long"))
    return sums.join(F.broadcast(shared), "k", "left")  # a row for each of ``others``


def pixel_states(rings: DataFrame, res: float, margin: int = 2, group: str = "sample_id") -> DataFrame:
    """``px, py, state`` of the pixels near or in the union of rings: 'interior' if it and all pixels ``margin`` around lie inside, else 'boundary'.

    'boundary' pixels are all others within ``margin`` of a pixel a ring touches; every pixel that has no row is outside for certain.
    """
    from pointloom.operators.filters import tile_states

    s = materialize(tile_states(rings, res, group).select(group, F.col("tile_col").alias("px"), F.col("tile_row").alias("py"), "state"))
    inner = grown(s.where("state = 'inside'"), -margin, [group]).withColumn("in", F.lit(True))
    return grown(s, margin, [group]).join(inner, [group, "px", "py"], "left").select(group, "px", "py", F.when(F.col("in"), "interior").otherwise("boundary").alias("state"))


def outlines(components: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rings around each component, counter-clockwise with holes clockwise: ``component, label, ring, area``.

    Only the sides between a component and anything else are gathered, by component.
    """
    names = list(by)
    key = [*by, "component", "label"]
    q = components.withColumn("m", _moves(CROSS)).select(*key, "px", "py", F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"))
    o = components.select(*by, "component", (F.col("px")).alias("qx"), F.col("py").alias("qy"))
    q = q.withColumns({"qx": F.col("px") + F.col("dx"), "qy": F.col("py") + F.col("dy")})
    sides = q.join(o, [*by, "component", "qx", "qy"], "left_anti").select(*key, "px", "py", "dx", "dy")
    kinds = dict(components.dtypes)

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: pdf[c].iloc[0] for c in [*names, "component", "label"]}
        starts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for x, y, dx, dy in zip(*(pdf[c].tolist() for c in ("px", "py", "dx", "dy"))):
            # sides run so that the component lies to the left
            a, b = {(0, -1): ((x, y), (x + 1, y)), (1, 0): ((x + 1, y), (x + 1, y + 1)), (0, 1): ((x + 1, y + 1), (x, y + 1)), (-1, 0): ((x, y + 1), (x, y))}[dx, dy]
            starts.setdefault(a, []).append(b)
        rings = []
        while starts:
            at = first = min(starts)
            ring, way = [], (0, 0)
            while True:
                nexts = starts[at]
                # where two corners touch, the left turn keeps 4-connected areas apart
                nexts.sort(key=lambda b: (b[0] - at[0]) * way[1] - (b[1] - at[1]) * way[0])
                to = nexts.pop(0)
                if not nexts:
                    del starts[at]
                step = (to[0] - at[0], to[1] - at[1])
                if step != way:
                    ring.append(at)
                at, way = to, step
                if at == first:
                    break
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
            rings.append({**head, "ring": [[float(x), float(y)] for x, y in ring], "area": float(area)})
        return pd.DataFrame(rings)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], f"component bigint, label {kinds['label']}, ring array<array<double>>, area double"])
    return apply_groups(sides, key, trace, schema)
