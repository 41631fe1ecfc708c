"""Coordinate systems by EPSG code, forwards and back: degrees, European equal area, UTM, spherical Mercator.

Every formula is written once over a set of functions, so that it serves columns and plain numbers alike. Known codes:
4326 (degrees, unchanged), 3035, 3857, 326zz and 327zz (UTM on WGS84, north and south), 258zz (UTM on ETRS89).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.functions import geo

_NAMES = "sin cos tan asin atan2 sinh cosh atanh sqrt log exp hypot radians degrees atan".split()


def _let_columns(values: dict[str, Column], f):
    """``f`` of values that are worked out once: as the fields of a one-element array's variable, since a column that is
    written down twice is worked out twice, and the series would make plans too long to compile."""

    def body(v: Column) -> Column:
        r = f(SimpleNamespace(**{n: v[n] for n in values}))
        return F.struct(r[0].alias("x"), r[1].alias("y")) if isinstance(r, tuple) else r

    return F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), body), F.lit(0))


COLUMNS = SimpleNamespace(**{n: getattr(F, n) for n in _NAMES}, pick=lambda c, a, b: F.when(c, a).otherwise(b), let=_let_columns)
NUMBERS = SimpleNamespace(**{n: getattr(math, n) for n in _NAMES}, pick=lambda c, a, b: a if c else b, let=lambda values, f: f(SimpleNamespace(**values)))


class _Stages:
    """The functions over columns of a table, where values that are worked out once become columns of it for a while: those
    are compiled, unlike an array's variable."""

    def __init__(self, df: DataFrame):
        self.df, self.names = df, []
        self.functions = SimpleNamespace(**{**vars(COLUMNS), "let": self.let})

    def let(self, values: dict[str, Column], f):
        names = {n: f"__crs_{len(self.names)}_{n}" for n in values}
        self.df = self.df.withColumns({names[n]: c for n, c in values.items()})
        self.names += names.values()
        return f(SimpleNamespace(**{n: F.col(c) for n, c in names.items()}))


#: Semi-major axis and flattening, fixed values: GRS80 and WGS84.
GRS80, WGS84 = (6378137.0, 1 / 298.257222101), (6378137.0, 1 / 298.257223563)


class Degrees:
    def forward(self, m, lon, lat):
        return lon, lat

    def back(self, m, x, y):
        return x, y


@dataclass(frozen=True)
class Mercator:
    """Spherical Mercator."""

    a: float = WGS84[0]

    def forward(self, m, lon, lat):
        return m.radians(lon) * self.a, m.log(m.tan(m.radians(lat) / 2 + math.pi / 4)) * self.a

    def back(self, m, x, y):
        return m.degrees(x / self.a), m.degrees(m.atan(m.exp(y / self.a)) * 2 - math.pi / 2)


class EqualArea:
    """EPSG:3035; the way back is by the authalic latitude's series and one step of Newton's, good to a micrometre."""

    def forward(self, m, lon, lat):
        if m is NUMBERS:
            return geo.project_point(lon, lat)
        return geo.project(lon, lat) if m is COLUMNS else geo.project(lon, lat, lambda values, f: m.let(values, lambda v: f(**vars(v))))

    def back(self, m, x, y):
        e2, e, rq, d, b0 = geo._E2, geo._E, geo._RQ, geo._D, geo._B0

        def angle(v):
            return m.let({"dx": v.dx, "dy": v.dy, "rho": v.rho, "c": m.asin(v.rho / (2 * rq)) * 2}, authalic)

        def authalic(v):
            b = m.asin(m.cos(v.c) * math.sin(b0) + v.dy * m.sin(v.c) * math.cos(b0) / m.pick(v.rho > 0, v.rho, 1.0))
            lon = m.atan2(v.dx * m.sin(v.c), v.rho * math.cos(b0) * m.cos(v.c) - v.dy * math.sin(b0) * m.sin(v.c)) + geo._LON0
            return m.let({"b": b, "lon": lon}, series)

        def series(v):
            lat = v.b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * m.sin(v.b * 2) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * m.sin(v.b * 4) + 761 * e2**3 / 45360 * m.sin(v.b * 6)
            return m.let({"b": v.b, "lon": v.lon, "lat": lat, "s": m.sin(lat)}, newton)

        def newton(v):
            off = geo._QP * m.sin(v.b) / (1 - e2) - v.s / (1 - v.s * v.s * e2) + m.log((1 - v.s * e) / (1 + v.s * e)) / (2 * e)
            return m.degrees(v.lon), m.degrees(v.lat + (1 - v.s * v.s * e2) * (1 - v.s * v.s * e2) / (m.cos(v.lat) * 2) * off)

        dx, dy = (x - geo._FE) / d, (y - geo._FN) * d
        return m.let({"dx": dx, "dy": dy, "rho": m.hypot(dx, dy)}, angle)


@dataclass(frozen=True)
class TransverseMercator:
    """Transverse Mercator by the series in the third flattening, to its fourth power (under a micrometre within a zone)."""

    lon0: float
    north0: float
    ellipsoid: tuple[float, float] = WGS84
    scale: float = 0.9996
    east0: float = 500_000.0

    def _parts(self):
        a, f = self.ellipsoid
        n = f / (2 - f)
        radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # The published coefficients, for the way forwards, back, and from conformal to geodetic latitude.
        forth = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        lat = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        return math.sqrt(f * (2 - f)), radius * self.scale, forth, back, lat

    def forward(self, m, lon, lat):
        e, radius, forth, _, _ = self._parts()

        def conformal(v):
            t = m.sinh(m.atanh(v.s) - m.atanh(v.s * e) * e)
            return m.let({"t": t, "d": v.d}, sphere)

        def sphere(v):
            return m.let({"xi": m.atan2(v.t, m.cos(v.d)), "eta": m.atanh(m.sin(v.d) / m.sqrt(v.t * v.t + 1))}, plane)

        def plane(v):
            north, east = v.xi, v.eta
            for j, c in enumerate(forth, 1):
                north = north + m.sin(v.xi * (2 * j)) * m.cosh(v.eta * (2 * j)) * c
                east = east + m.cos(v.xi * (2 * j)) * m.sinh(v.eta * (2 * j)) * c
            return east * radius + self.east0, north * radius + self.north0

        return m.let({"s": m.sin(m.radians(lat)), "d": m.radians(lon) - math.radians(self.lon0)}, conformal)

    def back(self, m, x, y):
        _, radius, _, back, lat = self._parts()

        def sphere(v):
            xi, eta = v.north, v.east
            for j, c in enumerate(back, 1):
                xi = xi - m.sin(v.north * (2 * j)) * m.cosh(v.east * (2 * j)) * c
                eta = eta - m.cos(v.north * (2 * j)) * m.sinh(v.east * (2 * j)) * c
            return m.let({"xi": xi, "eta": eta}, conformal)

        def conformal(v):
            return m.let({"chi": m.asin(m.sin(v.xi) / m.cosh(v.eta)), "lon": m.degrees(m.atan2(m.sinh(v.eta), m.cos(v.xi))) + self.lon0}, geodetic)

        def geodetic(v):
            phi = v.chi
            for j, c in enumerate(lat, 1):
                phi = phi + m.sin(v.chi * (2 * j)) * c
            return v.lon, m.degrees(phi)

        return m.let({"north": (y - self.north0) / radius, "east": (x - self.east0) / radius}, sphere)


def _pair(r) -> tuple[Column, Column]:
    return r if isinstance(r, tuple) else (r["x"], r["y"])


@dataclass(frozen=True)
class Crs:
    code: int

    @property
    def system(self):
        zone = self.code % 100
        if self.code == 4326:
            return Degrees()
        if self.code == 3035:
            return EqualArea()
        if self.code == 3857:
            return Mercator()
        if self.code // 100 in (326, 327, 258) and 1 <= zone <= 60:
            return TransverseMercator(6 * zone - 183, 10_000_000.0 if self.code // 100 == 327 else 0.0, GRS80 if self.code // 100 == 258 else WGS84)
        raise ValueError(f"unknown system {self.code}; known are 4326, 3035, 3857, 326zz, 327zz and 258zz")

    def project(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return _pair(self.system.forward(COLUMNS, lon, lat))

    def unproject(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(longitude, latitude) in degrees."""
        return _pair(self.system.back(COLUMNS, x, y))

    def add(self, df: DataFrame, pairs: list[tuple[str, str, str, str]], back: bool = False) -> DataFrame:
        """``df`` with columns on the plane, or in degrees on the way ``back``: each of ``pairs`` names those of two
        coordinates and of the two worked out."""
        s, out = _Stages(df), {}
        for a, b, x, y in pairs:
            r = (self.system.back if back else self.system.forward)(s.functions, F.col(a), F.col(b))
            out |= {x: r[0], y: r[1]}
        return s.df.withColumns(out).drop(*s.names)

    def point(self, lon: float, lat: float) -> tuple[float, float]:
        return self.system.forward(NUMBERS, lon, lat)

    def degrees(self, x: float, y: float) -> tuple[float, float]:
        return self.system.back(NUMBERS, x, y)
