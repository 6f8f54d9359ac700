"""Packed point ids, tiles and small scalar functions, as column expressions.

An id has 64 bits, most significant first: grid (12), x (24, signed), y (24, signed), seq (4, signed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_BITS, XY_BITS, SEQ_BITS = 12, 24, 4
NULL_ID = -1


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def pack(grid, x, y, seq=0) -> Column:
    """(grid, x, y, seq) to an id."""
    g, x, y, s = (_col(c).cast("long") for c in (grid, x, y, seq))
    return F.shiftleft(g.bitwiseAND(0xFFF), 52).bitwiseOR(F.shiftleft(x.bitwiseAND(0xFFFFFF), 28)).bitwiseOR(F.shiftleft(y.bitwiseAND(0xFFFFFF), 4)).bitwiseOR(s.bitwiseAND(0xF))


def _signed(c: Column, high: int, bits: int) -> Column:
    return F.shiftright(F.shiftleft(c, high), 64 - bits).cast("int")


def unpack(ix) -> dict[str, Column]:
    """the parts of an id, sign-extended."""
    c = _col(ix).cast("long")
    return {"grid": F.shiftrightunsigned(c, 52).cast("int"), "x": _signed(c, 12, 24), "y": _signed(c, 36, 24), "seq": _signed(c, 60, 4)}


def with_seq(ix, seq) -> Column:
    """the id with another seq."""
    return F.shiftleft(F.shiftright(_col(ix).cast("long"), 4), 4).bitwiseOR(_col(seq).cast("long").bitwiseAND(0xF))


def tile(c, res: int) -> Column:
    """The 2**res tile that a coordinate lies in; floors negative ones."""
    return F.shiftright(_col(c), res)


def tile_id(grid, x, y, res: int) -> Column:
    """The id of a tile: the point id with the low res bits of x and y cleared."""
    return pack(grid, F.shiftleft(tile(x, res), res), F.shiftleft(tile(y, res), res), 0)


def chunk_tile(c, level: int, base: int = 11) -> Column:
    """Tile of a coordinate at a coalescing level, moved by half a tile more per level so that seams never line up."""
    halves = sum(4**k for k in range(level))  # in half base tiles
    return F.shiftright(_col(c) - (halves << (base - 1)), base + 2 * level)


def bit_reversed(c) -> Column:
    """the 64 bits in reverse order, as a signed long; the pseudo-random order of a geocode."""
    bits = F.lpad(F.bin(_col(c).cast("long")), 64, "0")
    return F.conv(F.reverse(bits), 2, -10).cast("long")


def hex_id(c) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(_col(c).cast("long")), 16, "0"))


def hex_to_id(c) -> Column:
    """up to 16 hex digits to a signed long."""
    return F.conv(_col(c), 16, -10).cast("long")


def hex_limit(prefix: str, upper: bool) -> int:
    """The smallest or largest id whose hex form begins with prefix."""
    if not prefix:
        return 2**63 - 1 if upper else -(2**63)
    v = int((prefix + ("f" if upper else "0") * 16)[:16], 16)
    return v - 2**64 if v >= 2**63 else v


def floor_mod(a, n) -> Column:
    """F10."""
    return F.pmod(_col(a), _col(n))


def wrapped_x(x, width: int) -> Column:
    """x moved into [-width/2, width - width/2) on a cylindrical grid."""
    low = -(width // 2)
    return F.pmod(_col(x) - low, F.lit(width)) + low


def isodist(x, y) -> Column:
    """the second sort key of a point."""
    return _col(x) - _col(y)


def millimetres(v) -> Column:
    """metres to whole millimetres, truncated."""
    return (_col(v).cast("double") * 1000.0).cast("int")


def feet(mm) -> Column:
    """F16: millimetres to feet."""
    return _col(mm) / 1000.0 / 0.3048


#: Limits in feet above which the viewer's classes of summits begin.
FEET_CLASSES = [500, 1000, 1500, 2000, 3000, 4000, 6000, 9000]


def feet_class(ft) -> Column:
    """which class a height in feet falls in, from 0."""
    out = F.lit(0)
    for i, low in enumerate(FEET_CLASSES, 1):
        out = F.when(_col(ft) > low, F.lit(i)).otherwise(out)
    return out


def unit_factor(unit) -> Column:
    """metres per unit, for m and ft; null otherwise."""
    return F.when(_col(unit) == "m", 1.0).when(_col(unit) == "ft", 0.3048)


def lon_normal(lon) -> Column:
    """longitude in [-180, 180)."""
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0


def lon_epoch(lon) -> Column:
    """how often a longitude has gone round."""
    return F.floor((_col(lon) + 180.0) / 360.0).cast("int")


def lat_lon(x, y, spacing: float, x_stretch: float = 1.0, seq=0) -> tuple[Column, Column]:
    """latitude and longitude of a point of a geographic grid; split saddles lie 3e-6 degrees apart."""
    return _col(y) * spacing + _col(seq) * 3e-6, _col(x) * (spacing * x_stretch)
