"""Geometry as column arithmetic: great circles, the equal-area projection of Europe, polygons, the sun."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0  # metres; equatorial radius
MEAN_EARTH = 6371008.8
# EPSG:3035, fixed values: GRS80 ellipsoid, origin 52 N 10 E, false easting and northing.
_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LON0, _FE, _FN = math.radians(52), math.radians(10), 4321000.0, 3210000.0
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def rhumb(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH) -> Column:
    """Distance in metres along the line of constant bearing, the shorter way round."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    turn = F.radians(F.pmod(lon2 - lon1 + 540, F.lit(360.0)) - 180)
    stretch = F.log(F.tan(p2 / 2 + math.pi / 4) / F.tan(p1 / 2 + math.pi / 4))
    q = F.when(F.abs(stretch) > 1e-12, (p2 - p1) / stretch).otherwise(F.cos(p1))
    return radius * F.sqrt(F.pow(p2 - p1, 2) + q * q * turn * turn)


def bearing_degrees(dlon: Column, dlat: Column) -> Column:
    """atan2 of the coordinate differences, from 0 (north) clockwise."""
    return F.degrees(F.atan2(dlon, dlat)) + F.when(dlon < 0, 360.0).otherwise(0.0)


def _q(sin_lat, log):
    return (1 - _E2) * (sin_lat / (1 - _E2 * sin_lat * sin_lat) - log((1 - _E * sin_lat) / (1 + _E * sin_lat)) / (2 * _E))


_QP = _q(1.0, math.log)
_B0 = math.asin(_q(math.sin(_LAT0), math.log) / _QP)
_RQ = _A * math.sqrt(_QP / 2)
_D = _A * math.cos(_LAT0) / math.sqrt(1 - _E2 * math.sin(_LAT0) ** 2) / (_RQ * math.cos(_B0))


def project(lon: Column, lat: Column, let=lambda values, f: f(**values)) -> tuple[Column, Column]:
    """(X, Y) in EPSG:3035: Lambert azimuthal equal area, by authalic latitude.

    Null just where a coordinate is, and written so that Spark knows: "X is not null" before a scan then looks at the
    coordinates instead of working X out by a formula too long to be compiled. ``let`` may make columns of values used often.
    """
    known = lambda v: F.when(lon.isNotNull() & lat.isNotNull(), F.coalesce(v, F.lit(math.nan)))

    def scaled(b: Column, d: Column) -> tuple[Column, Column]:
        k = F.sqrt(2 / (1 + math.sin(_B0) * F.sin(b) + math.cos(_B0) * F.cos(b) * F.cos(d))) * _RQ
        return let({"b": b, "d": d, "k": k}, placed)

    def placed(b: Column, d: Column, k: Column) -> tuple[Column, Column]:
        return known(_FE + k * _D * F.cos(b) * F.sin(d)), known(_FN + k / _D * (math.cos(_B0) * F.sin(b) - math.sin(_B0) * F.cos(b) * F.cos(d)))

    return let({"b": F.asin(_q(F.sin(F.radians(lat)), F.log) / _QP), "d": F.radians(lon) - _LON0}, scaled)


def project_point(lon: float, lat: float) -> tuple[float, float]:
    b = math.asin(_q(math.sin(math.radians(lat)), math.log) / _QP)
    d = math.radians(lon) - _LON0
    k = math.sqrt(2 / (1 + math.sin(_B0) * math.sin(b) + math.cos(_B0) * math.cos(b) * math.cos(d))) * _RQ
    return _FE + k * _D * math.cos(b) * math.sin(d), _FN + k / _D * (math.cos(_B0) * math.sin(b) - math.sin(_B0) * math.cos(b) * math.cos(d))


Ring = list[tuple[float, float]]


def edges(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    """Segments of closed rings."""
    return [(*a, *b) for r in rings for a, b in zip(r, [*r[1:], r[0]]) if a != b]


def edge_array(rings: list[Ring]) -> Column:
    """The segments as one literal; a shape is a parameter, its size doesn't follow the data."""
    text = ";".join(",".join(repr(float(v)) for v in e) for e in edges(rings))
    return F.transform(F.split(F.lit(text), ";"), lambda e: F.split(e, ",").cast("array<double>"))


def in_polygon(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Ray casting: an odd number of edges to the right of the point."""
    hit = lambda e: ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / F.nullif(e[3] - e[1], F.lit(0.0)) + e[0])
    box = [f([v for r in rings for v, *_ in [p[::s] for p in r]]) for f, s in ((min, 1), (max, 1), (min, -1), (max, -1))]
    inside = F.size(F.filter(edge_array(rings), lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1
    return F.when(x.isNull() | y.isNull(), None).when(x.between(box[0], box[1]) & y.between(box[2], box[3]), inside).otherwise(False)


def distance_to_edges(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Least planar distance to any segment."""

    def one(e: Column) -> Column:
        dx, dy = e[2] - e[0], e[3] - e[1]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e[0]) * dx + (y - e[1]) * dy) / (dx * dx + dy * dy)))
        return F.hypot(x - (e[0] + t * dx), y - (e[1] + t * dy))

    return F.when(x.isNotNull() & y.isNotNull(), F.array_min(F.transform(edge_array(rings), one)))


def _holds(outer: Ring, x: float, y: float) -> bool:
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in edges([outer])) % 2 == 1


def polygons(shape: list) -> list[list[Ring]]:
    """A shape as polygons, each a list of rings. Polygons stay as they are; in a flat list of rings one that lies within
    another is a hole of it (or land again in a hole), and rings that only overlap or touch are polygons of their own."""
    if not shape or isinstance(shape[0][0][0], (list, tuple)):
        return shape
    within = lambda i, j: i != j and all(_holds(shape[j], *p) for p in shape[i])
    around = [[j for j in range(len(shape)) if within(i, j)] for i in range(len(shape))]
    out = {i: [shape[i]] for i in range(len(shape)) if len(around[i]) % 2 == 0}
    for i in range(len(shape)):
        if i not in out:
            out[next(j for j in around[i] if len(around[j]) == len(around[i]) - 1)].append(shape[i])
    return list(out.values())


def area_centroid(shape: list) -> tuple[float, float]:
    """Centre of mass of a shape's area; of a shape without area, the mean of its corners."""
    total = mx = my = 0.0
    for rings in polygons(shape):
        for i, r in enumerate(rings):
            x0, y0 = r[0]  # coordinates from the first corner, lest large ones cancel
            cross = [((ax - x0) * (by - y0) - (bx - x0) * (ay - y0), ax + bx - 2 * x0, ay + by - 2 * y0) for ax, ay, bx, by in edges([r])]
            area = sum(c for c, _, _ in cross)
            sign = (1 if area > 0 else -1) * (1 if i == 0 else -1)
            total += sign * area
            mx += sign * (sum(c * sx for c, sx, _ in cross) / 3 + area * x0)
            my += sign * (sum(c * sy for c, _, sy in cross) / 3 + area * y0)
    if not total:
        points = [p for rings in polygons(shape) for r in rings for p in r]
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    return mx / total, my / total


def crop(rings: list[Ring], box: tuple[float, float, float, float], buffer: float) -> list[Ring]:
    """Rings whose own box meets the buffered one (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = box[0] - buffer, box[1] - buffer, box[2] + buffer, box[3] + buffer
    return [r for r in rings if min(p[0] for p in r) <= x1 and max(p[0] for p in r) >= x0 and min(p[1] for p in r) <= y1 and max(p[1] for p in r) >= y0]


def rectangle(lon0: float, lat0: float, lon1: float, lat1: float, point=project_point) -> Ring:
    """The box's corners, projected; its sides are straight on the plane."""
    return [point(*p) for p in ((lon0, lat0), (lon1, lat0), (lon1, lat1), (lon0, lat1))]


def circle(lon: float, lat: float, radius: float, points: int = 120, point=project_point) -> Ring:
    x, y = point(lon, lat)
    return [(x + radius * math.cos(2 * math.pi * i / points), y + radius * math.sin(2 * math.pi * i / points)) for i in range(points)]


# The widely published low-precision solar constants, here and in sun_times.
#: Sun altitude in degrees at which each pair of times is reached, rising and setting.
SUN_ALTITUDES = {
    ("sunrise", "sunset"): -0.833,
    ("sunriseEnd", "sunsetStart"): -0.3,
    ("dawn", "dusk"): -6.0,
    ("nauticalDawn", "nauticalDusk"): -12.0,
    ("nightEnd", "night"): -18.0,
    ("goldenHourEnd", "goldenHour"): 6.0,
}


def sun_times(date: Column, lon: Column, lat: Column) -> dict[str, Column]:
    """The sun's times on a date at a place, as unix seconds; null where the sun doesn't reach the altitude.

    Low-precision solar equations: mean anomaly, equation of centre, declination, hour angle.
    """
    j2000, obliquity = 2451545, math.radians(23.4397)
    day = F.unix_date(date) + 0.5 - 0.5 + 2440588 - j2000
    lw = -F.radians(lon)
    n = F.round(day - 0.0009 - lw / (2 * math.pi))
    transit0 = 0.0009 + lw / (2 * math.pi) + n
    m = F.radians(F.lit(357.5291) + 0.98560028 * transit0)
    centre = F.radians(1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m))
    ecliptic = m + centre + math.radians(102.9372) + math.pi
    dec = F.asin(F.sin(ecliptic) * math.sin(obliquity))
    transit = j2000 + transit0 + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * ecliptic)
    seconds = lambda j: (j + 0.5 - 2440588) * 86400
    out = {"solarNoon": seconds(transit), "nadir": seconds(transit - 0.5)}
    for (rise, set_), altitude in SUN_ALTITUDES.items():
        cos = (math.sin(math.radians(altitude)) - F.sin(F.radians(lat)) * F.sin(dec)) / (F.cos(F.radians(lat)) * F.cos(dec))
        w = F.when(cos.between(-1, 1), F.acos(cos))
        down = j2000 + 0.0009 + (w + lw) / (2 * math.pi) + n + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * ecliptic)
        out[set_], out[rise] = seconds(down), seconds(transit - (down - transit))
    return out
