"""Grids as column expressions: tiles, pixels, hexagons, body-centred cubic cells, map tiles.

All are built from multiplications and ``floor``/``round`` so that they stay in
generated code and give the same cells in any engine with IEEE doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 20037508.342789244  # half the circumference of the Web Mercator square, in metres


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pixel(x, res: float) -> Column:
    """Index of the cell of width ``res`` that holds ``x``, rounding down for negative values too."""
    return F.floor(_c(x) / F.lit(float(res)))


def tile(x, y, size: float) -> dict[str, Column]:
    return {"tile_row": pixel(y, size), "tile_col": pixel(x, size)}


def scaled(x, factor: float) -> Column:
    return _c(x) * F.lit(float(factor))


def hexagon(x, y, size: float) -> dict[str, Column]:
    """Axial coordinates of the pointy-top hexagon with circumradius ``size``.

    Fractional axial coordinates are rounded; the one that was moved further is
    then corrected by the other two axes.
    """
    x, y = _c(x), _c(y)
    q = (F.lit(math.sqrt(3) / 3) * x - y / F.lit(3.0)) / F.lit(float(size))
    r = (F.lit(2.0 / 3.0) * y) / F.lit(float(size))
    rq, rr = F.round(q), F.round(r)
    dq, dr = q - rq, r - rr
    hx = F.when(F.abs(dq) < F.abs(dr), rq).otherwise(rq + F.round(dq + dr / F.lit(2.0)))
    hy = F.when(F.abs(dq) < F.abs(dr), rr + F.round(dr + dq / F.lit(2.0))).otherwise(rr)
    return {"hx": hx.cast("long"), "hy": hy.cast("long")}


def hexagon_sql(x: str, y: str, size: float) -> tuple[str, str]:
    """``hexagon`` in plain SQL, for checks in another engine."""
    q = f"(({math.sqrt(3) / 3!r}::DOUBLE * {x} - {y} / 3.0::DOUBLE) / {float(size)!r}::DOUBLE)"
    r = f"(({2.0 / 3.0!r}::DOUBLE * {y}) / {float(size)!r}::DOUBLE)"
    dq, dr = f"({q} - round({q}))", f"({r} - round({r}))"
    less = f"abs({dq}) < abs({dr})"
    return (
        f"CAST(CASE WHEN {less} THEN round({q}) ELSE round({q}) + round({dq} + {dr} / 2.0::DOUBLE) END AS BIGINT)",
        f"CAST(CASE WHEN {less} THEN round({r}) + round({dr} + {dq} / 2.0::DOUBLE) ELSE round({r}) END AS BIGINT)",
    )


def hexagon_centre(hx, hy, size: float) -> dict[str, Column]:
    hx, hy = _c(hx), _c(hy)
    return {"x": F.lit(float(size) * math.sqrt(3)) * (hx + hy / F.lit(2.0)), "y": F.lit(float(size) * 1.5) * hy}


def hexagon_size(distance: float) -> float:
    """Circumradius of hexagons whose centres are ``distance`` apart."""
    return distance / math.sqrt(3)


def bcc(x, y, z, size: float) -> dict[str, Column]:
    """Cell of the body-centred cubic lattice with cubes of side ``size``: doubled coordinates of its centre.

    Corner points have three even, centres three odd coordinates; of equally near
    ones the corner is taken.
    """
    x, y, z = (_c(v) / F.lit(float(size)) for v in (x, y, z))
    corner = [F.round(v) for v in (x, y, z)]
    centre = [F.floor(v).cast("double") + F.lit(0.5) for v in (x, y, z)]
    far = lambda c: sum(((v - w) * (v - w) for v, w in zip((x, y, z), c)), F.lit(0.0))
    near = far(corner) <= far(centre)
    return {n: F.when(near, a * 2).otherwise(b * 2).cast("long") for n, a, b in zip(("bx", "by", "bz"), corner, centre)}


def bcc_centre(bx, by, bz, size: float) -> dict[str, Column]:
    return {n: _c(v) * F.lit(size / 2.0) for n, v in (("x", bx), ("y", by), ("z", bz))}


def mercator(x, y, zoom: int, pixels: int = 256) -> dict[str, Column]:
    """Map tile and pixel in it of a point in Web Mercator metres; points beyond the square go to its edge."""
    side = F.lit(float(pixels << zoom))
    most = (pixels << zoom) - 1
    gx = F.floor((_c(x) + F.lit(EARTH)) / F.lit(2 * EARTH) * side)
    gy = F.floor((F.lit(EARTH) - _c(y)) / F.lit(2 * EARTH) * side)
    gx, gy = (F.greatest(F.lit(0), F.least(F.lit(most), g)).cast("long") for g in (gx, gy))
    shift = pixels.bit_length() - 1
    return {"tx": F.shiftright(gx, shift), "ty": F.shiftright(gy, shift), "px": gx.bitwiseAND(pixels - 1), "py": gy.bitwiseAND(pixels - 1)}


def decay(d, radius: float, half: float) -> Column:
    """Weight of a point ``d`` away from an anchor: one half at ``half`` times ``radius``, within [0.05, 0.95]."""
    nu = math.log(0.5) / math.log(half)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.lit(1.0) - F.pow(_c(d) / F.lit(float(radius)), F.lit(nu))))


def unit_key(seed: int, *parts) -> Column:
    """Random key of a unit, as 8 hexadecimal digits that depend on the seed and the unit only."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), *[_c(p) for p in parts]).bitwiseAND(0xFFFFFFFF)), 8, "0"))
