"""Points near points and points inside regions, through sorted space-filling-curve codes.

Space is cut into square cells whose Morton (Z-order) code is the interleaving
of their integer coordinates.  Cells are grouped into blocks; a block is the
shuffle key, so work follows area rather than samples.  Within a partition the
points of many blocks are sorted by ``block, code`` at once, discs and regions
are covered with ranges of codes, ranges are looked up by binary search, and
every candidate is then tested exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along the side of a block of the distance join; with its halo of one cell this needs 6 bits.
BLOCK = 32
#: Points in a block beyond which it is cut into smaller ones of ``SUB`` cells, and these are divided over tasks.
HOT_BLOCK, SUB = 50_000, 4
#: Hot blocks that are broadcast at most: with more of them the bound on their points is raised until there are so few.
HOT_LIST = 500_000
#: What a block, a part of it and a task's share of that are known by.
KEYS = ["grp", "bx", "by", "sx", "sy", "salt"]
#: Points that are processed together, and candidate pairs expanded at once.
CHUNK, PAIRS = 200_000, 2_000_000


def spread_bits(v: np.ndarray) -> np.ndarray:
    """Put a zero before each of the low 16 bits of ``v``."""
    v = v.astype(np.int64) & 0xFFFF
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | (v << shift)) & mask
    return v


def morton(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    return spread_bits(cx) | (spread_bits(cy) << 1)


def expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, end): the range each element belongs to, and the element."""
    n = np.maximum(ends - starts, 0)
    which = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return which, np.arange(n.sum()) - first[which] + starts[which]


def slabs(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Cut a list of pieces with ``counts`` elements into slices of about ``most`` elements."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = CHUNK) -> Iterator[pa.Table]:
    """Join batches that are sorted by ``keys`` into tables of at least ``least`` rows that never divide a key."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= least:
            t = pa.Table.from_batches(held).combine_chunks()
            cut = changes([t.column(k) for k in keys])
            last = int(cut[-1])
            if last:
                yield t.slice(0, last)
            held, rows = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
            least_now = max(least, 2 * rows)
            least = least_now if rows > least // 2 else least
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def changes(columns: list) -> np.ndarray:
    """Rows at which any of the sorted ``columns`` takes a new value, the first row included."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            v = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        else:
            v = c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def usable(points: DataFrame, key: str, x: str, y: str, group: str, extra: list[str] = ()) -> DataFrame:
    """id, group, finite coordinates and ``extra`` columns; rows without one of the first take no part."""
    ok = F.col(key).isNotNull() & F.col(group).isNotNull()
    for c in (x, y):
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(1e12))
    return points.where(ok).select(F.col(key).alias("id"), F.col(group).cast("string").alias("grp"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *extra)


def near_pairs(points: DataFrame, radius: float, key: str = "point_id", x: str = "x", y: str = "y", group: str = "sample_id") -> DataFrame:
    """Pairs of different points of one group less than ``radius`` apart: ``(a bigint, b bigint)`` with a < b.

    Several rows of one id count as one point if their coordinates are equal, so
    repeated rows add nothing.  Null, NaN or infinite coordinates, null ids and
    null groups take no part; an empty table gives no rows.  Distance 0 is near.
    A block with more than ``HOT_BLOCK`` points is cut into blocks of ``SUB`` cells
    with a halo of their own; the probing points of one that still has more are
    divided over tasks, each with that small block to look up.
    """
    r2 = radius * radius

    def search(batches):
        for t in chunks(batches, KEYS):
            ids = t.column("id").combine_chunks().to_numpy()
            for a, b, _ in close(t, r2):
                ok = ids[a] < ids[b]
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[ok]]), pa.array(ids[b[ok]])], ["a", "b"])

    return filed(points, radius, key, x, y, group).mapInArrow(search, "a long, b long")


def filed(points: DataFrame, radius: float, key: str, x: str, y: str, group: str, extra: list[str] = ()) -> DataFrame:
    """Points in the blocks that look them up, partitioned and sorted by ``KEYS``; ``home`` is set in the one block that probes for them."""
    side = radius * 1.0001  # points closer than the radius are then at most one cell apart, whatever the rounding
    p = usable(points, key, x, y, group, extra)
    p = p.withColumns({"cx": F.floor(F.col("x") / F.lit(side)), "cy": F.floor(F.col("y") / F.lit(side))})
    p = p.withColumns({"bx": F.floor(F.col("cx") / BLOCK), "by": F.floor(F.col("cy") / BLOCK)})
    p = p.withColumns({"lx": (F.col("cx") - F.col("bx") * BLOCK).cast("int"), "ly": (F.col("cy") - F.col("by") * BLOCK).cast("int")})
    hot = hot_blocks(p, ["grp", "bx", "by"])
    parts = None
    if hot is not None:
        parts = hot_blocks(p.join(hot, ["grp", "bx", "by"]).withColumns({"sx": F.floor(F.col("lx") / SUB).cast("int"), "sy": F.floor(F.col("ly") / SUB).cast("int")}), ["grp", "bx", "by", "sx", "sy"])
    home = F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"))

    def steps(c):
        return F.concat(F.array(F.lit(0)), F.when(F.col(c) == 0, F.array(F.lit(-1))).when(F.col(c) == BLOCK - 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))

    edge = (F.col("lx") == 0) | (F.col("lx") == BLOCK - 1) | (F.col("ly") == 0) | (F.col("ly") == BLOCK - 1)
    around = F.flatten(F.transform(steps("lx"), lambda dx: F.transform(steps("ly"), lambda dy: F.struct(dx.alias("dx"), dy.alias("dy")))))
    p = p.withColumn("to", F.explode(F.when(edge, around).otherwise(F.array(home))))
    p = p.select(
        "grp", (F.col("bx") + F.col("to.dx")).alias("bx"), (F.col("by") + F.col("to.dy")).alias("by"),
        (F.col("lx") - F.col("to.dx") * BLOCK + 1).cast("short").alias("lx"), (F.col("ly") - F.col("to.dy") * BLOCK + 1).cast("short").alias("ly"),
        ((F.col("to.dx") == 0) & (F.col("to.dy") == 0)).alias("home"), F.col("id").cast("long").alias("id"), "x", "y", *extra,
    )
    p = _divided(p, hot, parts)
    return p.select(*KEYS, "lx", "ly", "home", "id", "x", "y", *extra).repartition(*KEYS).sortWithinPartitions(*KEYS)


def hot_blocks(p: DataFrame, keys: list[str]) -> DataFrame | None:
    """``keys, parts`` of the blocks with more than ``HOT_BLOCK`` points, at most ``HOT_LIST`` rows marked for broadcast; None if there are none."""
    counts, most = p.groupBy(*keys).count(), HOT_BLOCK
    while True:
        listed = counts.where(F.col("count") > most).limit(HOT_LIST + 1).collect()
        if len(listed) <= HOT_LIST:
            break
        most *= 2
    if not listed:
        return None
    rows = [(*r[:-1], -(-r[-1] // most)) for r in listed]
    return F.broadcast(p.sparkSession.createDataFrame(rows, counts.withColumnRenamed("count", "parts").schema).withColumn("parts", F.col("parts").cast("int")))


def _divided(p: DataFrame, hot: DataFrame | None, parts: DataFrame | None) -> DataFrame:
    """Small block ``sx, sy`` and task ``salt`` of each point; points go to the small blocks of a hot block that their neighbourhood touches."""
    if hot is None:
        return p.withColumns({"sx": F.lit(0), "sy": F.lit(0), "salt": F.lit(0)})
    p = p.join(hot, ["grp", "bx", "by"], "left")

    def touched(c):
        first, last = (F.floor((F.least(F.greatest(F.col(c) + d, F.lit(1)), F.lit(BLOCK)) - 1) / SUB).cast("int") for d in (-1, 1))
        return F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last)))

    p = p.withColumn("sx", touched("lx")).withColumn("sy", touched("ly"))
    own = (F.floor((F.col("lx") - 1) / SUB) == F.col("sx")) & (F.floor((F.col("ly") - 1) / SUB) == F.col("sy"))
    p = p.withColumn("home", F.col("home") & (F.col("parts").isNull() | own)).drop("parts")
    if parts is None:
        return p.withColumn("salt", F.lit(0))
    p = p.join(parts, ["grp", "bx", "by", "sx", "sy"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    p = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine = F.pmod(F.xxhash64("id"), F.col("parts")) == F.col("salt")
    return p.withColumn("home", F.col("home") & mine).drop("parts")


def close(t: pa.Table, r2: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``t``, whole blocks as ``filed`` makes them: each home row with each row of squared distance below ``r2`` (itself too), and that.

    Of rows with one id and place only the first counts.
    """
    col = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    cut = changes([t.column(c) for c in KEYS])
    block = np.zeros(t.num_rows, np.int64)
    block[cut] = 1
    block = np.cumsum(block) - 1
    lx, ly = col("lx").astype(np.int64), col("ly").astype(np.int64)
    code = (block << 12) | morton(lx, ly)
    ids, x, y, home = col("id"), col("x"), col("y"), col("home")
    order = np.lexsort((y, x, ids, code))
    code, ids, x, y, home = code[order], ids[order], x[order], y[order], home[order]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    if again.any():
        code, x, y, home, order = code[~again], x[~again], y[~again], home[~again], order[~again]
    # one disc cover for each occupied home cell: the cell and its neighbours, as ranges of codes
    probe = np.flatnonzero(home)
    if not len(probe):
        return
    first = np.flatnonzero(np.r_[True, code[probe][1:] != code[probe][:-1]])
    cells, ends = code[probe][first], np.r_[first[1:], len(probe)]
    low = cells & 0xFFF
    cx, cy = _gather_bits(low), _gather_bits(low >> 1)
    cover = np.stack([(cells - low) | morton(cx + dx, cy + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)], 1)
    cover.sort(axis=1)
    opens = np.ones(cover.shape, bool)
    opens[:, 1:] = cover[:, 1:] != cover[:, :-1] + 1
    closes = np.ones(cover.shape, bool)
    closes[:, :-1] = opens[:, 1:]
    owner = np.nonzero(opens)[0]
    lo = np.searchsorted(code, cover[opens])
    hi = np.searchsorted(code, cover[closes] + 1)
    work = (hi - lo) * (ends - first)[owner]
    for s in slabs(work, PAIRS):
        rng, other = expand(lo[s], hi[s])
        cell = owner[s][rng]
        which, probing = expand(first[cell], ends[cell])
        a, b = probe[probing], other[which]
        d2 = (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2
        ok = d2 < r2
        if ok.any():
            yield order[a[ok]], order[b[ok]], d2[ok]


def _gather_bits(v: np.ndarray) -> np.ndarray:
    """The even bits of ``v``, moved together."""
    out = np.zeros_like(v)
    for i in range(8):
        out |= ((v >> (2 * i)) & 1) << i
    return out


# ---------------------------------------------------------------- regions

#: Cells along the side of a region block.
REGION_BLOCK = 16
_COVER = "grp string, bx long, by long, lo int, hi int, inner boolean, region string, edges array<double>"


def ring_edges(ring: np.ndarray) -> np.ndarray:
    """Edges (x0, y0, x1, y1) of a closed ring of which the last vertex joins the first; repeated vertices vanish."""
    ring = ring[np.isfinite(ring).all(1)]
    if not len(ring):
        return np.zeros((0, 4))
    ring = ring[np.r_[True, (ring[1:] != ring[:-1]).any(1)]]
    e = np.hstack([ring, np.roll(ring, -1, 0)])
    return e[(e[:, :2] != e[:, 2:]).any(1)]


def inside(px: np.ndarray, py: np.ndarray, edges: np.ndarray, of: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """Whether points lie in a ring by non-zero winding, its boundary included.

    With one ring, ``edges`` is tested against every point.  With ``of`` and
    ``starts`` row ``i`` of ``edges`` belongs to point ``of[i]`` and the edges of
    one point are contiguous from ``starts``.
    """
    if of is None:
        if not len(edges) or not len(px):
            return np.zeros(len(px), bool)
        px, py = px[:, None], py[:, None]
        x0, y0, x1, y1 = edges.T
    else:
        px, py = px[of], py[of]
        x0, y0, x1, y1 = edges.T
    cross = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
    on = (cross == 0) & (px >= np.minimum(x0, x1)) & (px <= np.maximum(x0, x1)) & (py >= np.minimum(y0, y1)) & (py <= np.maximum(y0, y1))
    turn = ((y0 <= py) & (y1 > py) & (cross > 0)).astype(np.int32) - ((y0 > py) & (y1 <= py) & (cross < 0))
    if of is None:
        return on.any(1) | (turn.sum(1) != 0)
    return np.logical_or.reduceat(on, starts) | (np.add.reduceat(turn, starts) != 0)


def cover_ring(edges: np.ndarray, side: float) -> Iterator[tuple[int, int, int, int, bool, list[float]]]:
    """Cover a ring with ranges of cell codes: (block x, block y, first code, end code, inner, edges).

    Cells an edge may touch form the border, other cells with their centre
    inside are inner: all their points are in the ring.  Border ranges carry the
    edges that matter for a point of the block.  Blocks without a border cell are
    found by quartering the ring's square down to quads that no edge touches;
    one test decides such a quad, and each of its blocks is one whole range.
    """
    lo, hi = edges.reshape(-1, 2).min(0), edges.reshape(-1, 2).max(0)
    c0, c1 = np.floor(lo / side).astype(np.int64), np.floor(hi / side).astype(np.int64)
    n = np.maximum(1, np.ceil(np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]) / side)).astype(np.int64)
    which, k = expand(np.zeros(len(n), np.int64), n)
    e, steps = edges[which], n[which]
    ends = [np.stack([e[:, 0] + (e[:, 2] - e[:, 0]) * f, e[:, 1] + (e[:, 3] - e[:, 1]) * f], 1) for f in (k / steps, (k + 1) / steps)]
    near = side * 1e-6
    a = np.floor((np.minimum(*ends) - near) / side).astype(np.int64)
    b = np.floor((np.maximum(*ends) + near) / side).astype(np.int64)
    size = b - a + 1
    of, at = expand(np.zeros(len(a), np.int64), size[:, 0] * size[:, 1])
    border = np.unique(a[of] + np.stack([at % size[of, 0], at // size[of, 0]], 1), axis=0)
    block = border // REGION_BLOCK
    order = np.lexsort((block[:, 1], block[:, 0]))
    border, block = border[order], block[order]
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]).any(1)])
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
        bx, by = block[i].tolist()
        y0, y1, x0 = (by * REGION_BLOCK) * side - near, ((by + 1) * REGION_BLOCK) * side + near, bx * REGION_BLOCK * side - near
        kept = edges[(np.minimum(edges[:, 1], edges[:, 3]) <= y1) & (np.maximum(edges[:, 1], edges[:, 3]) >= y0) & (np.maximum(edges[:, 0], edges[:, 2]) >= x0)]
        local = border[i:j] - np.array([bx, by]) * REGION_BLOCK
        kind = np.zeros(REGION_BLOCK * REGION_BLOCK, np.int8)  # 1 inner, 2 border
        kind[morton(local[:, 0], local[:, 1])] = 2
        xs = np.arange(max(0, c0[0] - bx * REGION_BLOCK), min(REGION_BLOCK, c1[0] - bx * REGION_BLOCK + 1))
        ys = np.arange(max(0, c0[1] - by * REGION_BLOCK), min(REGION_BLOCK, c1[1] - by * REGION_BLOCK + 1))
        cx, cy = (v.ravel() for v in np.meshgrid(xs, ys))
        code = morton(cx, cy)
        free = kind[code] == 0
        if free.any():
            hit = inside((cx[free] + bx * REGION_BLOCK + 0.5) * side, (cy[free] + by * REGION_BLOCK + 0.5) * side, kept)
            kind[code[free][hit]] = 1
        cut = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1, len(kind)]
        flat = kept.ravel().tolist()
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if kind[x]:
                yield bx, by, x, y, bool(kind[x] == 1), [] if kind[x] == 1 else flat
    yield from _inner_blocks(edges, side, np.unique(block, axis=0), c0 // REGION_BLOCK, c1 // REGION_BLOCK)


def _inner_blocks(edges: np.ndarray, side: float, border: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[int, int, int, int, bool, list[float]]]:
    """Blocks from ``b0`` to ``b1`` that lie in the ring as a whole."""
    width = 1 << max(0, int((b1 - b0).max())).bit_length()
    quads, open_ = [], [(int(b0[0]), int(b0[1]), width, border)]
    while open_:
        x, y, w, some = open_.pop()
        if not len(some):
            quads.append((x, y, w))
        elif w > 1:
            h = w // 2
            for qx in (x, x + h):
                for qy in (y, y + h):
                    if qx <= b1[0] and qy <= b1[1]:
                        mine = (some[:, 0] >= qx) & (some[:, 0] < qx + h) & (some[:, 1] >= qy) & (some[:, 1] < qy + h)
                        open_.append((qx, qy, h, some[mine]))
    if not quads:
        return
    q = np.array(quads)
    step = max(1, PAIRS // len(edges))
    for s in range(0, len(q), step):
        part = q[s : s + step]
        hit = inside((part[:, 0] + 0.5) * REGION_BLOCK * side, (part[:, 1] + 0.5) * REGION_BLOCK * side, edges)
        for x, y, w in part[hit].tolist():
            for bx in range(x, min(x + w, int(b1[0]) + 1)):
                for by in range(y, min(y + w, int(b1[1]) + 1)):
                    yield bx, by, 0, REGION_BLOCK * REGION_BLOCK, True, []


def points_in_rings(points: DataFrame, rings: DataFrame, side: float = 4.0, key: str = "point_id", x: str = "x", y: str = "y", group: str = "sample_id", region: str = "polygon_id", ring: str = "ring") -> DataFrame:
    """Regions of the point's group that hold it: distinct ``(id bigint, region string)``.

    A region holds a point if one of its rings does, by non-zero winding and with
    the boundary.  Vertices run either way, closed or not; null or non-finite
    vertices are dropped.  Rings with a null region, group or ring or fewer than
    three vertices take no part, nor do points without id, group or finite
    coordinates; repeated points and rings add nothing.  Points are never moved
    by region: a region is copied to the blocks it covers, as code ranges, and to
    each part of a block whose points are divided because they are many.
    """
    cut = rings.where(F.col(region).isNotNull() & F.col(group).isNotNull() & (F.size(F.col(ring)) >= 3))
    cut = cut.select(F.col(group).cast("string").alias("grp"), F.col(region).cast("string").alias("region"), F.col(ring).alias("ring"))

    def cover(batches):
        for b in batches:
            out = []
            for g, name, vertices in zip(b.column("grp").to_pylist(), b.column("region").to_pylist(), b.column("ring").to_pylist()):
                v = [(p["x"], p["y"]) for p in vertices if p is not None and p["x"] is not None and p["y"] is not None]
                if len(v) >= 3 and len(e := ring_edges(np.array(v, float))):
                    out += [(g, bx, by, lo, hi, inner, name, es) for bx, by, lo, hi, inner, es in cover_ring(e, side)]
            if out:
                types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["grp", "bx", "by", "lo", "hi", "inner", "region", "edges"])

    covers = cut.mapInArrow(cover, _COVER)
    p = usable(points, key, x, y, group)
    p = p.withColumns({"cx": F.floor(F.col("x") / F.lit(side)), "cy": F.floor(F.col("y") / F.lit(side))})
    p = p.withColumns({"bx": F.floor(F.col("cx") / REGION_BLOCK), "by": F.floor(F.col("cy") / REGION_BLOCK)})
    p = p.select(
        "grp", "bx", "by", F.col("id").cast("long").alias("id"), "x", "y",
        (F.col("cx") - F.col("bx") * REGION_BLOCK).cast("int").alias("lo"), (F.col("cy") - F.col("by") * REGION_BLOCK).cast("int").alias("hi"),
        F.lit(None).cast("boolean").alias("inner"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("array<double>").alias("edges"),
    )
    hot = hot_blocks(p, ["grp", "bx", "by"])
    p = p.withColumn("salt", F.lit(0)) if hot is None else p.join(hot, ["grp", "bx", "by"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    c = covers.withColumn("salt", F.lit(0)) if hot is None else covers.join(hot, ["grp", "bx", "by"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    keys = ["grp", "bx", "by", "salt"]
    c = c.select(*keys, F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "lo", "hi", "inner", "region", "edges")
    both = p.unionByName(c).repartition(*keys).sortWithinPartitions(*keys)

    def search(batches):
        for t in chunks(batches, keys):
            yield from _held(t, keys)

    return both.mapInArrow(search, "id long, region string").distinct()


def _held(t: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    cut = changes([t.column(c) for c in keys])
    block = np.zeros(t.num_rows, np.int64)
    block[cut] = 1
    block = np.cumsum(block) - 1
    whole = lambda c: t.column(c).combine_chunks()
    is_point = whole("id").is_valid().to_numpy(zero_copy_only=False)
    lo, hi = whole("lo").to_numpy(zero_copy_only=False), whole("hi").to_numpy(zero_copy_only=False)
    pts, rgs = np.flatnonzero(is_point), np.flatnonzero(~is_point)
    if not len(pts) or not len(rgs):
        return
    code = (block[pts] << 8) | morton(lo[pts], hi[pts])
    order = np.argsort(code, kind="stable")
    pts, code = pts[order], code[order]
    x, y = (whole(c).take(pa.array(pts)).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    ids = whole("id").take(pa.array(pts)).to_numpy(zero_copy_only=False)
    names = whole("region").take(pa.array(rgs))
    inner = whole("inner").take(pa.array(rgs)).to_numpy(zero_copy_only=False)
    edges = whole("edges").take(pa.array(rgs))
    flat, at = edges.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), edges.value_lengths().to_numpy(zero_copy_only=False) // 4
    first = np.cumsum(at) - at
    a = np.searchsorted(code, (block[rgs] << 8) | lo[rgs])
    b = np.searchsorted(code, (block[rgs] << 8) + hi[rgs])
    for s in slabs((b - a) * np.maximum(1, at), PAIRS):
        rng, p = expand(a[s], b[s])
        r = rng + s.start
        ok = inner[r].astype(bool)
        test = np.flatnonzero(~ok & (at[r] > 0))
        if len(test):
            of, e = expand(first[r[test]], first[r[test]] + at[r[test]])
            starts = np.cumsum(at[r[test]]) - at[r[test]]
            ok[test] = inside(x[p[test]], y[p[test]], flat[e], of, starts)
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[p[ok]]), names.take(pa.array(r[ok]))], ["id", "region"])
