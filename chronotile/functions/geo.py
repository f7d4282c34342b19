"""Projections between longitude and latitude and plane coordinates, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
SINUSOIDAL = 6371007.181


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857."""
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def to_sinusoidal(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.cos(F.radians(lat)) * SINUSOIDAL, F.radians(lat) * SINUSOIDAL


def from_sinusoidal(x: Column, y: Column) -> tuple[Column, Column]:
    lat = y / SINUSOIDAL
    return F.degrees(x / (SINUSOIDAL * F.cos(lat))), F.degrees(lat)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Transverse Mercator of a zone, by the series in the third flattening to its third power."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * _A * x, F.when(south, 10000000.0).otherwise(0.0) + 0.9996 * _A * y


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    xi0 = (y - F.when(south, 10000000.0).otherwise(0.0)) / (0.9996 * _A)
    eta0 = (x - 500000) / (0.9996 * _A)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def _eccentricity(flattening: float) -> float:
    return math.sqrt(flattening * (2 - flattening))


def _q(s, e: float):
    """Snyder's q of a sine of latitude, a number or a column, from which equal-area projections start."""
    log = math.log if isinstance(s, float) else F.log
    return (1 - e * e) * (s / (1 - e * e * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def _authalic(beta: Column, e: float) -> Column:
    """Latitude, in radians, of an authalic latitude."""
    return beta + (e**2 / 3 + 31 * e**4 / 180 + 517 * e**6 / 5040) * F.sin(2 * beta) + (23 * e**4 / 360 + 251 * e**6 / 3780) * F.sin(4 * beta) + (761 * e**6 / 45360) * F.sin(6 * beta)


class Albers:
    """Equal-area conic projection with two standard parallels."""

    def __init__(self, lat0: float, lon0: float, lat1: float, lat2: float, x0: float = 0.0, y0: float = 0.0, radius: float = RADIUS, flattening: float = FLATTENING):
        e = self.e = _eccentricity(flattening)
        m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
        q = lambda p: _q(math.sin(p), e)
        p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
        self.n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1)) if abs(p1 - p2) > 1e-10 else math.sin(p1)
        self.c = m(p1) ** 2 + self.n * q(p1)
        self.rho0 = radius * math.sqrt(self.c - self.n * q(p0)) / self.n
        self.lon0, self.x0, self.y0, self.radius = lon0, x0, y0, radius

    def to(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = self.radius * F.sqrt(self.c - self.n * _q(F.sin(F.radians(lat)), self.e)) / self.n
        theta = self.n * F.radians(lon - self.lon0)
        return self.x0 + rho * F.sin(theta), self.y0 + self.rho0 - rho * F.cos(theta)

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign = math.copysign(1.0, self.n)
        dx, dy = x - self.x0, self.rho0 - (y - self.y0)
        rho, theta = F.sqrt(dx * dx + dy * dy), F.atan2(sign * dx, sign * dy)
        q = (self.c - F.pow(rho * self.n / self.radius, F.lit(2.0))) / self.n
        return self.lon0 + F.degrees(theta / self.n), F.degrees(_authalic(F.asin(q / _q(1.0, self.e)), self.e))


class Azimuthal:
    """Lambert's equal-area azimuthal projection about a point that is no pole."""

    def __init__(self, lat0: float, lon0: float, x0: float = 0.0, y0: float = 0.0, radius: float = RADIUS, flattening: float = FLATTENING):
        e = self.e = _eccentricity(flattening)
        p0 = math.radians(lat0)
        self.qp = _q(1.0, e)
        self.beta0 = math.asin(_q(math.sin(p0), e) / self.qp)
        self.rq = radius * math.sqrt(self.qp / 2)
        self.d = radius * math.cos(p0) / math.sqrt(1 - e * e * math.sin(p0) ** 2) / (self.rq * math.cos(self.beta0))
        self.lon0, self.x0, self.y0 = lon0, x0, y0

    def to(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        beta, dl = F.asin(_q(F.sin(F.radians(lat)), self.e) / self.qp), F.radians(lon - self.lon0)
        s, c = math.sin(self.beta0), math.cos(self.beta0)
        b = self.rq * F.sqrt(2 / (1 + s * F.sin(beta) + c * F.cos(beta) * F.cos(dl)))
        return self.x0 + b * self.d * F.cos(beta) * F.sin(dl), self.y0 + b / self.d * (c * F.sin(beta) - s * F.cos(beta) * F.cos(dl))

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        s, c = math.sin(self.beta0), math.cos(self.beta0)
        dx, dy = (x - self.x0) / self.d, (y - self.y0) * self.d
        rho = F.sqrt(dx * dx + dy * dy)
        angle = 2 * F.asin(rho / (2 * self.rq))
        beta = F.when(rho == 0, F.lit(self.beta0)).otherwise(F.asin(F.cos(angle) * s + F.try_divide(dy * F.sin(angle), rho) * c))
        lon = F.atan2(dx * F.sin(angle), rho * c * F.cos(angle) - dy * s * F.sin(angle))
        return self.lon0 + F.degrees(lon), F.degrees(_authalic(beta, self.e))


class Conformal:
    """Lambert's conformal conic projection with two standard parallels."""

    def __init__(self, lat0: float, lon0: float, lat1: float, lat2: float, x0: float = 0.0, y0: float = 0.0, radius: float = RADIUS, flattening: float = FLATTENING):
        e = self.e = _eccentricity(flattening)
        m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
        self.n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2))) if abs(p1 - p2) > 1e-10 else math.sin(p1)
        self.f = radius * m(p1) / (self.n * t(p1) ** self.n)
        self.rho0, self.lon0, self.x0, self.y0 = self.f * t(p0) ** self.n, lon0, x0, y0

    def to(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        p = F.radians(lat)
        s = F.sin(p)
        t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - self.e * s) / (1 + self.e * s), F.lit(self.e / 2))
        rho, theta = self.f * F.pow(t, F.lit(self.n)), self.n * F.radians(lon - self.lon0)
        return self.x0 + rho * F.sin(theta), self.y0 + self.rho0 - rho * F.cos(theta)

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign = math.copysign(1.0, self.n)
        dx, dy = x - self.x0, self.rho0 - (y - self.y0)
        t = F.pow(F.sqrt(dx * dx + dy * dy) / abs(self.f), F.lit(1 / self.n))
        chi, e2 = math.pi / 2 - 2 * F.atan(t), self.e**2
        p = chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12) * F.sin(2 * chi) + (7 * e2**2 / 48 + 29 * e2**3 / 240) * F.sin(4 * chi) + (7 * e2**3 / 120) * F.sin(6 * chi)
        return self.lon0 + F.degrees(F.atan2(sign * dx, sign * dy) / self.n), F.degrees(p)
