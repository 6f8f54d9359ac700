"""Hilbert-curve cell ids of latitude and longitude on the cube's six faces, and geometry encodings."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the curve: position of a quadrant by orientation, and the turn each position makes.
IJ_TO_POS = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])
POS_TURN = np.array([1, 0, 0, 3])


def _face_uv(face, x, y, z):
    on = [face == k for k in range(5)]
    return np.select(on, [y / x, -x / y, -x / z, z / x, z / y], -y / z), np.select(on, [z / x, z / y, -y / z, y / x, -x / y], -x / z)


def cell_ids(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Leaf cell ids as signed 64-bit integers."""
    la, lo = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    axis = np.abs(p).argmax(axis=0)
    at = np.take_along_axis(p, axis[None], 0)[0]
    face = np.where(at < 0, axis + 3, axis)
    x, y, z = p
    with np.errstate(divide="ignore", invalid="ignore"):  # of the faces that are not chosen
        u, v = _face_uv(face, x, y, z)
    to_st = lambda t: np.where(t >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(t)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(t)))
    i, j = (np.clip(np.floor(to_st(t) * (1 << 30)), 0, (1 << 30) - 1).astype("i8") for t in (u, v))
    turn, pos = face & 1, np.zeros(len(face), "u8")
    for k in range(29, -1, -1):
        q = IJ_TO_POS[turn, 2 * (i >> k & 1) + (j >> k & 1)]
        pos = pos * np.uint64(4) + q.astype("u8")
        turn = turn ^ POS_TURN[q]
    return ((face.astype("u8") << np.uint64(61)) | (pos << np.uint64(1)) | np.uint64(1)).view("i8")


@F.pandas_udf(T.LongType())
def geocode(lat: pd.Series, lon: pd.Series) -> pd.Series:
    return pd.Series(cell_ids(lat.to_numpy(), lon.to_numpy()))


def line_wkb(points) -> bytes | None:
    """a LINESTRING in little-endian well-known binary; None without points, one point counts twice."""
    pts = [(float(p["x"]), float(p["y"])) for p in points if p is not None and p["x"] is not None] if points is not None else []
    if not pts:
        return None
    pts = pts * 2 if len(pts) == 1 else pts
    return struct.pack("<BII", 1, 2, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts)


@F.pandas_udf(T.BinaryType())
def wkb_line(paths: pd.Series) -> pd.Series:
    return paths.map(line_wkb)


@F.pandas_udf(T.BinaryType())
def wkb_point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])


@F.pandas_udf(T.BinaryType())
def wkb_lines(paths: pd.Series) -> pd.Series:
    """MULTILINESTRING of the lists that hold points; None without any."""

    def one(lists):
        parts = [w for w in map(line_wkb, lists if lists is not None else []) if w]
        return struct.pack("<BII", 1, 5, len(parts)) + b"".join(parts) if parts else None

    return paths.map(one)


def _number(c) -> Column:
    """A coordinate with six decimals at most."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("double").cast("decimal(18,6)").cast("string"), r"\.?0+$", "")


def wkt_point(x, y) -> Column:
    return F.concat(F.lit("POINT ("), _number(x), F.lit(" "), _number(y), F.lit(")"))


def wkt_line(path) -> Column:
    """LINESTRING of array<struct<x, y>>; null elements are skipped and a single point counts twice."""
    pts = F.filter(path, lambda p: p.isNotNull() & p["x"].isNotNull())
    pts = F.when(F.size(pts) == 1, F.concat(pts, pts)).otherwise(pts)
    return F.when(F.size(pts) > 0, F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(pts, lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"]))), ", "), F.lit(")")))
