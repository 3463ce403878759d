"""Geometry as column expressions: projection, boxes, grids, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the mean Earth radius.
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
EARTH_RADIUS_M = 6_371_008.8
_E2 = WGS84_F * (2 - WGS84_F)


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geodesic_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres along the ellipsoid by Andoyer's formula, first order in the flattening: right to some 1e-5 but for nearly antipodal points."""
    f, g, half = F.radians((lat1 + lat2) / 2), F.radians((lat1 - lat2) / 2), F.radians((lng1 - lng2) / 2)
    sq = lambda x: x * x
    s = sq(F.sin(g)) * sq(F.cos(half)) + sq(F.cos(f)) * sq(F.sin(half))
    c = sq(F.cos(g)) * sq(F.cos(half)) + sq(F.sin(f)) * sq(F.sin(half))
    w = F.atan2(F.sqrt(s), F.sqrt(c))
    r = F.sqrt(s * c) / w
    up, down = (3 * r - 1) / (2 * c), (3 * r + 1) / (2 * s)
    bent = 1 + WGS84_F * up * sq(F.sin(f)) * sq(F.cos(g)) - WGS84_F * down * sq(F.cos(f)) * sq(F.sin(g))
    return F.when((s == 0) | (w == 0), 0.0).otherwise(2 * w * WGS84_A * bent)


def geocentric(lat: Column, lng: Column, height: float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a point on the ellipsoid."""
    p, q = F.radians(lat), F.radians(lng)
    n = WGS84_A / F.sqrt(1 - _E2 * F.pow(F.sin(p), 2))
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - _E2) + height) * F.sin(p)


def local_xy(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin in the tangent plane there."""
    x, y, z = geocentric(lat, lng)
    x0, y0, z0 = geocentric(lat0, lng0)
    p, q = F.radians(lat0), F.radians(lng0)
    dx, dy, dz = x - x0, y - y0, z - z0
    east = -F.sin(q) * dx + F.cos(q) * dy
    north = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    return east, north


def local_to_geo(east: Column, north: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point given in the tangent plane (closed-form inverse, millimetres within 50 km)."""
    x0, y0, z0 = geocentric(lat0, lng0)
    p, q = F.radians(lat0), F.radians(lng0)
    x = x0 - F.sin(q) * east - F.sin(p) * F.cos(q) * north
    y = y0 + F.cos(q) * east - F.sin(p) * F.sin(q) * north
    z = z0 + F.cos(p) * north
    b = WGS84_A * (1 - WGS84_F)
    r = F.sqrt(x * x + y * y)
    t = F.atan2(z * WGS84_A, r * b)
    lat = F.atan2(z + _E2 / (1 - _E2) * b * F.pow(F.sin(t), 3), r - _E2 * WGS84_A * F.pow(F.cos(t), 3))
    return F.degrees(lat), F.degrees(F.atan2(y, x))


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside the closed box (south, west, north, east); a range predicate that parquet can use."""
    south, west, north, east = box
    return lat.between(south, north) & lng.between(west, east)


def box_ring(box: tuple[float, float, float, float], lat_first: bool = False, closed: bool = True) -> list[tuple[float, float]]:
    """The corners of (north, west, south, east) from the north-west one, clockwise."""
    north, west, south, east = box
    ring = [(west, north), (east, north), (east, south), (west, south)]
    ring += ring[:1] if closed else []
    return [(y, x) for x, y in ring] if lat_first else ring


def quarters(box: tuple[tuple[float, float], tuple[float, float]]) -> list:
    """The four equal parts of ((x0, y0), (x1, y1)): west below, west above, east below, east above."""
    (x0, y0), (x1, y1) = box
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    return [((x0, y0), (xm, ym)), ((x0, ym), (xm, y1)), ((xm, y0), (x1, ym)), ((xm, ym), (x1, y1))]


def grid_cell(lat: Column, lng: Column, south: Column, west: Column, north: Column, east: Column, k: int) -> tuple[Column, Column]:
    """(ix, iy) of a point in a k x k grid; null outside the closed box. The last row and column are closed."""
    inside = lat.between(south, north) & lng.between(west, east)
    ix = F.least(F.lit(k - 1), F.floor((lng - west) / (east - west) * k))
    iy = F.least(F.lit(k - 1), F.floor((lat - south) / (north - south) * k))
    return F.when(inside, ix.cast("int")), F.when(inside, iy.cast("int"))


# The scale of the weights of neighbours.
NEIGHBOUR_SCALE = 112_000.0


def gaussian_weight(metres: Column, scale: float = NEIGHBOUR_SCALE) -> Column:
    """exp(-d^2 / scale): the weight of a neighbour at a distance."""
    return F.exp(-(metres * metres) / scale)


def convex_contains(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside a convex ring of (x, y) structs: all edges have the point on one side; the border fails."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    side = F.zip_with(ring, nxt, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return F.forall(side, lambda s: s > 0) | F.forall(side, lambda s: s < 0)


def circle_ring(lat: Column, lng: Column, radius_m: Column, resolution: int = 4) -> Column:
    """An array of (lng, lat) structs around a circle, 4 * resolution corners."""
    angles = F.array(*[F.lit(2 * math.pi * i / (4 * resolution)) for i in range(4 * resolution)])

    def corner(t: Column) -> Column:
        la, lo = local_to_geo(radius_m * F.cos(t), radius_m * F.sin(t), lat, lng)
        return F.struct(lo.alias("lng"), la.alias("lat"))

    return F.transform(angles, corner)


def canvas_pixel(lat: Column, lng: Column, box: tuple[float, float, float, float], width: int, height: int) -> tuple[Column, Column]:
    """Pixel of a point on a canvas over (south, west, north, east), y downwards."""
    south, west, north, east = box
    return F.floor((lng - west) / (east - west) * width).cast("int"), F.floor((north - lat) / (north - south) * height).cast("int")


def css_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb from shares between 0 and 1."""
    return F.format_string("#%02x%02x%02x", *[F.floor(c * 255).cast("int") for c in (r, g, b)])
