"""Coordinate systems that have a closed form: lon/lat, Web Mercator, UTM-like zones, Lambert conformal conic, Albers
equal area, polar stereographic.

The formulas take a math namespace, so the same text serves Spark columns
(whole-stage codegen, points) and numpy arrays (inside Arrow UDFs, any
geometry).  Axis order is always x = longitude/easting, y = latitude/northing.
GDA94 and GDA2020 are taken as equal to WGS84.
"""

from __future__ import annotations

import math
import re
from functools import cache
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadRequest

NUMPY = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, exp=np.exp, log=np.log, sqrt=np.sqrt, sinh=np.sinh,
    cosh=np.cosh, atan=np.arctan, atan2=np.arctan2, asin=np.arcsin, asinh=np.arcsinh, atanh=np.arctanh, floor=np.floor)
SPARK = SimpleNamespace(
    sin=F.sin, cos=F.cos, tan=F.tan, exp=F.exp, log=F.log, sqrt=F.sqrt, sinh=F.sinh,
    cosh=F.cosh, atan=F.atan, atan2=F.atan2, asin=F.asin, asinh=F.asinh, atanh=F.atanh, floor=F.floor)

# Ellipsoids (semi-major axis, inverse flattening) and the
# coefficients of the transverse Mercator series in powers of the third flattening.
SPHERE_RADIUS = 6378137.0
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
ALPHA = [
    {1: 1 / 2, 2: -2 / 3, 3: 5 / 16, 4: 41 / 180, 5: -127 / 288, 6: 7891 / 37800},
    {2: 13 / 48, 3: -3 / 5, 4: 557 / 1440, 5: 281 / 630, 6: -1983433 / 1935360},
    {3: 61 / 240, 4: -103 / 140, 5: 15061 / 26880, 6: 167603 / 181440},
    {4: 49561 / 161280, 5: -179 / 168, 6: 6601661 / 7257600},
    {5: 34729 / 80640, 6: -3418889 / 1995840},
    {6: 212378941 / 319334400},
]
BETA = [
    {1: 1 / 2, 2: -2 / 3, 3: 37 / 96, 4: -1 / 360, 5: -81 / 512, 6: 96199 / 604800},
    {2: 1 / 48, 3: 1 / 15, 4: -437 / 1440, 5: 46 / 105, 6: -1118711 / 3870720},
    {3: 17 / 480, 4: -37 / 840, 5: -209 / 4480, 6: 5569 / 90720},
    {4: 4397 / 161280, 5: -11 / 504, 6: -830251 / 7257600},
    {5: 4583 / 161280, 6: -108847 / 3991680},
    {6: 20648693 / 638668800},
]
DELTA = [
    {1: 2, 2: -2 / 3, 3: -2, 4: 116 / 45, 5: 26 / 45, 6: -2854 / 675},
    {2: 7 / 3, 3: -8 / 5, 4: -227 / 45, 5: 2704 / 315, 6: 2323 / 945},
    {3: 56 / 15, 4: -136 / 35, 5: -1262 / 105, 6: 73814 / 2835},
    {4: 4279 / 630, 5: -332 / 35, 6: -399572 / 14175},
    {5: 4174 / 315, 6: -144838 / 6237},
    {6: 601676 / 22275},
]

# The same for the way from authalic to geographic latitude.
XI = [
    {1: 4 / 3, 2: 4 / 45, 3: -16 / 35, 4: -2582 / 14175, 5: 60136 / 467775, 6: 28112932 / 212837625},
    {2: 46 / 45, 3: 152 / 945, 4: -11966 / 14175, 5: -21016 / 51975, 6: 251310128 / 638512875},
    {3: 3044 / 2835, 4: 3802 / 14175, 5: -94388 / 66825, 6: -8797648 / 10945935},
    {4: 6059 / 4725, 5: 41072 / 93555, 6: -1472637812 / 638512875},
    {5: 768272 / 467775, 6: 455935736 / 638512875},
    {6: 4210684958 / 1915538625},
]
# Published parameters. Conics: origin latitude and longitude, two standard parallels, false easting and
# northing. Polar: pole (1 north, -1 south), longitude of origin, latitude of true scale or scale at the pole, false
# easting and northing.
LAMBERT = {
    2154: (46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0, GRS80),
    3034: (52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0, GRS80),
    3111: (-37.0, 145.0, -36.0, -38.0, 2500000.0, 2500000.0, GRS80),
    3112: (0.0, 134.0, -18.0, -36.0, 0.0, 0.0, GRS80),
    3308: (-33.25, 147.0, -30.75, -35.75, 9300000.0, 4500000.0, GRS80),
    7899: (-37.0, 145.0, -36.0, -38.0, 2500000.0, 2500000.0, GRS80),
    7845: (0.0, 134.0, -18.0, -36.0, 0.0, 0.0, GRS80),
    8058: (-33.25, 147.0, -30.75, -35.75, 9300000.0, 4500000.0, GRS80),
}
ALBERS = {
    3005: (45.0, -126.0, 50.0, 58.5, 1000000.0, 0.0, GRS80),
    3577: (0.0, 132.0, -18.0, -36.0, 0.0, 0.0, GRS80),
    5070: (23.0, -96.0, 29.5, 45.5, 0.0, 0.0, GRS80),
    9473: (0.0, 132.0, -18.0, -36.0, 0.0, 0.0, GRS80),
}
POLAR = {
    3031: (-1, 0.0, -71.0, 0.0, 0.0, WGS84),
    3413: (1, -45.0, 70.0, 0.0, 0.0, WGS84),
    3976: (-1, 0.0, -70.0, 0.0, 0.0, WGS84),
    3995: (1, 0.0, 71.0, 0.0, 0.0, WGS84),
    32661: (1, 0.0, 0.994, 2000000.0, 2000000.0, WGS84),
    32761: (-1, 0.0, 0.994, 2000000.0, 2000000.0, WGS84),
}


def srid_of(text) -> int:
    """``4326`` from ``4326``, ``'EPSG:4326'`` or ``'OGC:CRS84'``."""
    found = re.fullmatch(r"\s*(?:EPSG:{1,2})?(\d+)\s*", str(text), re.IGNORECASE)
    if found:
        return int(found.group(1))
    if "CRS84" in str(text).upper():
        return 4326
    raise BadRequest(f"Unknown coordinate system: {text}")


def zone_of(srid: int):
    """(central meridian, false northing, ellipsoid) of a UTM-like zone, or None."""
    if 32601 <= srid <= 32660:
        return 6 * (srid - 32600) - 183, 0.0, WGS84
    if 32701 <= srid <= 32760:
        return 6 * (srid - 32700) - 183, 10000000.0, WGS84
    if 28348 <= srid <= 28358:
        return 6 * (srid - 28300) - 183, 10000000.0, GRS80
    if 7846 <= srid <= 7859:
        return 6 * (srid - 7800) - 183, 10000000.0, GRS80
    return None


def supported(srid: int) -> bool:
    return srid in (4326, 4283, 7844, 3857, 900913) or zone_of(srid) is not None or _map(srid) is not None


# --- conic and polar maps --------------------------------------------------------------------------------------------

RAD = math.pi / 180


class _Ellipsoid:
    def __init__(self, shape):
        self.axis, inverse = shape
        f = 1 / inverse
        self.e, self.n = math.sqrt(f * (2 - f)), f / (2 - f)

    def isometric(self, phi, m):
        s = m.sin(phi)
        return m.atanh(s) - self.e * m.atanh(self.e * s)

    def parallel(self, phi):
        """Radius of a parallel, in semi-major axes."""
        return math.cos(phi) / math.sqrt(1 - (self.e * math.sin(phi)) ** 2)

    def authalic(self, phi, m):
        s = m.sin(phi)
        return (1 - self.e ** 2) * (s / (1 - self.e ** 2 * s * s) + m.atanh(self.e * s) / self.e)

    def geographic(self, auxiliary, rows, m):
        phi = auxiliary
        for j, c in enumerate(_series(rows, self.n), 1):
            phi = phi + c * m.sin(2 * j * auxiliary)
        return phi

    def from_isometric(self, psi, m):
        return self.geographic(m.atan(m.sinh(psi)), DELTA, m)


def _turned(lam, m):
    """Difference of longitudes from -180 up to 180 degrees."""
    return lam - 360.0 * m.floor((lam + 180.0) / 360.0)


class _Conic:
    """What both conic maps share: places are turned around the apex of the cone."""

    def __init__(self, lat0, lon0, first, second, east0, north0, shape):
        self.ball, self.lon0, self.east0, self.north0 = _Ellipsoid(shape), lon0, east0, north0
        self.parameters(*[v * RAD for v in (lat0, first, second)])

    def forward(self, lon, lat, m):
        rho, theta = self.radius(lat * RAD, m), _turned(lon - self.lon0, m) * RAD * self.cone
        return self.east0 + rho * m.sin(theta), self.north0 + self.top - rho * m.cos(theta)

    def inverse(self, x, y, m):
        side = 1.0 if self.cone > 0 else -1.0
        east, down = side * (x - self.east0), side * (self.top - (y - self.north0))
        rho = side * m.sqrt(east * east + down * down)
        lon = self.lon0 + m.atan2(east, down) / (self.cone * RAD)
        return _turned(lon, m), self.latitude(rho, m) / RAD


class _Lambert(_Conic):
    def parameters(self, lat0, first, second):
        one, two = (self.ball.isometric(v, _MATH) for v in (first, second))
        m1, m2 = self.ball.parallel(first), self.ball.parallel(second)
        self.cone = math.sin(first) if first == second else (math.log(m1) - math.log(m2)) / (two - one)
        self.scale = self.ball.axis * m1 * math.exp(self.cone * one) / self.cone
        self.top = self.radius(lat0, _MATH)

    def radius(self, phi, m):
        return self.scale * m.exp(-self.cone * self.ball.isometric(phi, m))

    def latitude(self, rho, m):
        return self.ball.from_isometric(-m.log(rho / self.scale) / self.cone, m)


class _Albers(_Conic):
    def parameters(self, lat0, first, second):
        q1, q2 = (self.ball.authalic(v, _MATH) for v in (first, second))
        m1, m2 = self.ball.parallel(first), self.ball.parallel(second)
        self.cone = math.sin(first) if first == second else (m1 * m1 - m2 * m2) / (q2 - q1)
        self.constant, self.pole = m1 * m1 + self.cone * q1, self.ball.authalic(math.pi / 2, _MATH)
        self.top = self.radius(lat0, _MATH)

    def radius(self, phi, m):
        return self.ball.axis * m.sqrt(self.constant - self.cone * self.ball.authalic(phi, m)) / self.cone

    def latitude(self, rho, m):
        q = (self.constant - (rho * self.cone / self.ball.axis) * (rho * self.cone / self.ball.axis)) / self.cone
        return self.ball.geographic(m.asin(q / self.pole), XI, m)


class _Polar:
    def __init__(self, pole, lon0, scale, east0, north0, shape):
        self.ball, self.pole, self.lon0, self.east0, self.north0 = _Ellipsoid(shape), pole, lon0, east0, north0
        if abs(scale) < 2:  # a factor, else the latitude of true scale
            e = self.ball.e
            self.scale = 2 * self.ball.axis * scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        else:
            true = abs(scale) * RAD
            self.scale = self.ball.axis * self.ball.parallel(true) * math.exp(self.ball.isometric(true, _MATH))

    def forward(self, lon, lat, m):
        rho, theta = self.scale * m.exp(-self.ball.isometric(self.pole * lat * RAD, m)), (lon - self.lon0) * RAD
        return self.east0 + rho * m.sin(theta), self.north0 - self.pole * rho * m.cos(theta)

    def inverse(self, x, y, m):
        east, out = x - self.east0, self.pole * (self.north0 - y)
        psi = -m.log(m.sqrt(east * east + out * out) / self.scale)
        return _turned(self.lon0 + m.atan2(east, out) / RAD, m), self.pole * self.ball.from_isometric(psi, m) / RAD


_MATH = SimpleNamespace(sin=math.sin, cos=math.cos, exp=math.exp, log=math.log, sqrt=math.sqrt,
                        atanh=lambda v: math.inf if v >= 1 else math.atanh(v))


@cache
def _map(srid: int):
    """The conic or polar map of a code, or None."""
    for table, kind in ((LAMBERT, _Lambert), (ALBERS, _Albers), (POLAR, _Polar)):
        if srid in table:
            return kind(*table[srid])
    return None


def _series(rows, n):
    return [sum(c * n ** power for power, c in row.items()) for row in rows]


def _zone_constants(zone):
    lon0, north0, (axis, inverse) = zone
    f = 1 / inverse
    n = f / (2 - f)
    radius = axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    return lon0, north0, n, 0.9996 * radius, math.sqrt(f * (2 - f))


def _to_lonlat(srid, x, y, m):
    if srid in (3857, 900913):
        lon = x / SPHERE_RADIUS * (180 / math.pi)
        lat = m.atan(m.sinh(y / SPHERE_RADIUS)) * (180 / math.pi)
        return lon, lat
    if _map(srid):
        return _map(srid).inverse(x, y, m)
    zone = zone_of(srid)
    if zone is None:
        return x, y
    lon0, north0, n, scale, _ = _zone_constants(zone)
    xi, eta = (y - north0) / scale, (x - 500000.0) / scale
    xi1, eta1 = xi, eta
    for j, b in enumerate(_series(BETA, n), 1):
        xi1 = xi1 - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        eta1 = eta1 - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    lat = chi
    for j, d in enumerate(_series(DELTA, n), 1):
        lat = lat + d * m.sin(2 * j * chi)
    lon = m.atan2(m.sinh(eta1), m.cos(xi1))
    return lon * (180 / math.pi) + lon0, lat * (180 / math.pi)


def _from_lonlat(srid, lon, lat, m):
    if srid in (3857, 900913):
        x = lon * (math.pi / 180) * SPHERE_RADIUS
        y = m.asinh(m.tan(lat * (math.pi / 180))) * SPHERE_RADIUS
        return x, y
    if _map(srid):
        return _map(srid).forward(lon, lat, m)
    zone = zone_of(srid)
    if zone is None:
        return lon, lat
    lon0, north0, n, scale, e = _zone_constants(zone)
    phi, lam = lat * (math.pi / 180), (lon - lon0) * (math.pi / 180)
    # conformal latitude
    t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
    xi1 = m.atan2(t, m.cos(lam))
    eta1 = m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
    xi, eta = xi1, eta1
    for j, a in enumerate(_series(ALPHA, n), 1):
        xi = xi + a * m.sin(2 * j * xi1) * m.cosh(2 * j * eta1)
        eta = eta + a * m.cos(2 * j * xi1) * m.sinh(2 * j * eta1)
    return eta * scale + 500000.0, xi * scale + north0


def convert(x, y, source, target, m=NUMPY):
    """Coordinates from one system to another; raises for systems without a closed form."""
    source, target = srid_of(source), srid_of(target)
    for srid in (source, target):
        if not supported(srid):
            raise BadRequest(f"No closed form for EPSG:{srid}; supported: 4326, 3857, UTM and MGA zones, {', '.join(map(str, [*LAMBERT, *ALBERS, *POLAR]))}")
    if source == target:
        return x, y
    return _from_lonlat(target, *_to_lonlat(source, x, y, m), m)


def transform_xy(x: Column, y: Column, source, target) -> tuple[Column, Column]:
    """Point reprojection as plain column expressions."""
    return convert(x, y, source, target, SPARK)
