"""outlines in longitude and latitude of rectangles of other projections, on the driver.

The projection is given by two functions, to and from longitude and latitude, since no library of
projections is at hand.
"""

from __future__ import annotations

from collections.abc import Callable

Point = tuple[float, float]


def lon_near(lon: float, to: float) -> float:
    """The longitude equal to lon modulo 360 that is nearest to `to`."""
    return to + (lon - to + 180.0) % 360.0 - 180.0


def unwrapped(ring: list[Point]) -> list[Point]:
    """The points with longitudes that go on from one to the next without a jump at the date line."""
    out: list[Point] = []
    for lon, lat in ring:
        out.append((lon_near(lon, out[-1][0]) if out else lon, lat))
    return out


def outline(corners: list[Point], to_lon_lat: Callable[[Point], Point], from_lon_lat: Callable[[Point], Point], tolerance: float, depth: int = 16) -> list[Point]:
    """Longitudes and latitudes of a polygon's border.

    Each side is halved until the middle of its ends, taken in longitude and latitude, lies within
    tolerance of the side's own middle, or depth is reached. A border that goes once around a pole is
    closed over it.
    """

    def middle(a: Point, b: Point) -> Point:
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2

    def far(a: Point, b: Point) -> float:
        return ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5

    def side(a: Point, b: Point, n: int) -> list[Point]:
        p, q = to_lon_lat(a), to_lon_lat(b)
        q = (lon_near(q[0], p[0]), q[1])
        m = middle(a, b)
        if n == 0 or far(a, b) < tolerance or far(m, from_lon_lat(middle(p, q))) < tolerance:
            return [p]
        return side(a, m, n - 1) + side(m, b, n - 1)

    ring = unwrapped([p for a, b in zip(corners, [*corners[1:], corners[0]], strict=True) for p in side(a, b, depth)])
    turn = lon_near(ring[0][0], ring[-1][0]) - ring[0][0]
    if abs(turn) > 180.0:  # the border goes around a pole
        pole = 90.0 if sum(lat for _, lat in ring) > 0 else -90.0
        end = (ring[0][0] + turn, ring[0][1])
        ring = [*ring, end, (end[0], pole), (ring[0][0], pole)]
    return ring
