"""Grids and distances as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_A_DEGREE = 111.32


@dataclass(frozen=True)
class Grid:
    """A north-up affine grid: x = c + col * a, y = f + row * e with e < 0."""

    a: float
    c: float
    e: float
    f: float
    height: int
    width: int

    def row(self, lat: Column) -> Column:
        return F.floor((lat - self.f) / self.e).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - self.c) / self.a).cast("int")

    def x(self, col: Column) -> Column:
        return self.c + (col + 0.5) * self.a

    def y(self, row: Column) -> Column:
        return self.f + (row + 0.5) * self.e

    def window(self, west: float, south: float, east: float, north: float) -> tuple[int, int, int, int]:
        """(row0, row1, col0, col1) of an area, half open and clipped to the grid."""
        import math

        c0, c1 = max(math.floor((west - self.c) / self.a), 0), min(math.ceil((east - self.c) / self.a), self.width)
        r0, r1 = max(math.floor((north - self.f) / self.e), 0), min(math.ceil((south - self.f) / self.e), self.height)
        if r0 >= r1 or c0 >= c1:
            raise ValueError("the area lies outside the grid")
        return r0, r1, c0, c1

    def cell_km(self) -> float:
        import math

        mid = self.f + self.e * self.height / 2
        return (abs(self.a) * KM_A_DEGREE * math.cos(math.radians(mid)) + abs(self.e) * KM_A_DEGREE) / 2


#: The national 2-minute mosaic: 0.01 degree from 130 W, 55 N.
CONUS = Grid(0.01, -130.0, -0.01, 55.0, 3500, 7000)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def bbox_distance_km(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Degrees to the nearest point of (W, S, E, N), in km; 0 inside."""
    w, s, e, n = box
    dx = F.greatest(w - lon, F.lit(0.0), lon - e)
    dy = F.greatest(s - lat, F.lit(0.0), lat - n)
    return F.sqrt(dx * dx + dy * dy) * KM_A_DEGREE


def cell_km(lat: Column, width: float, height: float) -> Column:
    """Mean side of a cell of so many degrees at a latitude."""
    return (width * KM_A_DEGREE * F.cos(F.radians(lat)) + height * KM_A_DEGREE) / 2


def local_metres(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    import math

    return (lon - lon0) * (111320.0 * math.cos(math.radians(lat0))), (lat - lat0) * 111320.0


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1 + F.when(lat >= 0, 32600).otherwise(32700)).cast("int")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.radians(lat) / 2 + 0.7853981633974483)) * r


def albers_conus(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area metres (standard parallels 29.5 and 45.5, origin 96 W 23 N, GRS80)."""
    import math

    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q_num(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m_num(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    p1, p2, p0 = (math.radians(x) for x in (29.5, 45.5, 23.0))
    n = (m_num(p1) ** 2 - m_num(p2) ** 2) / (q_num(p2) - q_num(p1))
    c = m_num(p1) ** 2 + n * q_num(p1)
    rho0 = a * math.sqrt(c - n * q_num(p0)) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * q) / n, n * F.radians(lon + 96.0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether (x, y) lies in a closed ring: array of (x, y) structs, first repeated last; crossings of a ray."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.element_at(ring, i), F.element_at(ring, i + 1)
        spans = (p["y"] > y) != (q["y"] > y)
        return F.when(spans & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, i: a + crosses(i)) % 2 == 1
