"""Distances, local projections and bearings as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The great-circle radius, the flat-earth scale and the bounding-box
# scale are three separate constants on purpose; results depend on each.
EARTH_R_KM = 6371.0088
M_PER_DEG_LAT = 110_540.0
M_PER_DEG_LON_EQ = 111_320.0
BOX_KM_PER_DEG_LAT = 110.574
BOX_KM_PER_DEG_LON_EQ = 111.320


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the arcsine argument is clipped to [0, 1]."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    sin_lat = F.sin((p2 - p1) / 2)
    sin_lon = F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2)
    h = sin_lat * sin_lat + F.cos(p1) * F.cos(p2) * sin_lon * sin_lon
    clipped = F.greatest(F.least(h, F.lit(1.0)), F.lit(0.0))
    return F.lit(2.0 * EARTH_R_KM) * F.asin(F.sqrt(clipped))


def east_m(lon, lat0, lon0) -> Column:
    return (_c(lon) - _c(lon0)) * M_PER_DEG_LON_EQ * F.cos(F.radians(_c(lat0)))


def north_m(lat, lat0) -> Column:
    return (_c(lat) - _c(lat0)) * M_PER_DEG_LAT


def lat_of(north, lat0) -> Column:
    return _c(lat0) + _c(north) / M_PER_DEG_LAT


def lon_of(east, lat0, lon0) -> Column:
    return _c(lon0) + _c(east) / (F.lit(M_PER_DEG_LON_EQ) * F.cos(F.radians(_c(lat0))))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance with the cosine taken at the first point (not symmetric)."""
    return F.hypot(east_m(lon2, lat1, lon1), north_m(lat2, lat1)) / 1000.0


def bearing_deg(lat0, lon0, lat, lon) -> Column:
    """Compass bearing 0 = north, clockwise, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(east_m(lon, lat0, lon0), north_m(lat, lat0))), F.lit(360.0))


def pan_deg(bearing, offset) -> Column:
    """Camera pan for a compass bearing and a mounting offset."""
    return F.pmod(_c(bearing) + _c(offset), F.lit(360.0))


def circular_diff_deg(a, b) -> Column:
    """Smallest angle between two bearings, in [0, 180]."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def box_half_lat_deg(radius_km) -> Column:
    return _c(radius_km) / BOX_KM_PER_DEG_LAT


def box_half_lon_deg(lat, radius_km) -> Column:
    scale = F.lit(BOX_KM_PER_DEG_LON_EQ) * F.cos(F.radians(_c(lat)))
    return _c(radius_km) / F.greatest(scale, F.lit(1e-6))


# Albers equal-area parameters for the contiguous United States
# (GRS80 ellipsoid, standard parallels 29.5 and 45.5, origin 23 N 96 W; EPSG:5070).
ALBERS_A = 6378137.0
ALBERS_INV_F = 298.257222101
ALBERS_SP1, ALBERS_SP2, ALBERS_LAT0, ALBERS_LON0 = 29.5, 45.5, 23.0, -96.0

_E2 = 2 / ALBERS_INV_F - 1 / ALBERS_INV_F**2
_E = math.sqrt(_E2)


def _q_num(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m_num(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_M1, _M2 = _m_num(math.radians(ALBERS_SP1)), _m_num(math.radians(ALBERS_SP2))
_Q1, _Q2 = _q_num(math.radians(ALBERS_SP1)), _q_num(math.radians(ALBERS_SP2))
_N = (_M1**2 - _M2**2) / (_Q2 - _Q1)
_CC = _M1**2 + _N * _Q1
_RHO0 = ALBERS_A * math.sqrt(_CC - _N * _q_num(math.radians(ALBERS_LAT0))) / _N


def albers_xy(lat, lon) -> tuple[Column, Column]:
    """Equal-area (x, y) in metres for the contiguous United States."""
    s = F.sin(F.radians(_c(lat)))
    q = F.lit(1 - _E2) * (
        s / (F.lit(1.0) - _E2 * s * s)
        - F.log((F.lit(1.0) - _E * s) / (F.lit(1.0) + _E * s)) / (2 * _E)
    )
    rho = F.lit(ALBERS_A) * F.sqrt(F.lit(_CC) - F.lit(_N) * q) / _N
    theta = F.lit(_N) * F.radians(_c(lon) - ALBERS_LON0)
    return rho * F.sin(theta), F.lit(_RHO0) - rho * F.cos(theta)


def ring_points(lat, lon, radius_m, n: int = 120) -> Column:
    """Closed circle as array<struct<lon,lat>> with n + 1 vertices."""
    def vertex(k):
        a = k * (2 * math.pi / n)
        return F.struct(
            lon_of(_c(radius_m) * F.cos(a), lat, lon).alias("lon"),
            lat_of(_c(radius_m) * F.sin(a), lat).alias("lat"),
        )
    return F.transform(F.sequence(F.lit(0), F.lit(n)), vertex)


def ellipse_points(lat, lon, major_m, minor_m, angle_deg, n: int = 72) -> Column:
    """Closed ellipse; the angle is the major axis from east, counter-clockwise."""
    ca, sa = F.cos(F.radians(_c(angle_deg))), F.sin(F.radians(_c(angle_deg)))

    def vertex(k):
        t = k * (2 * math.pi / n)
        u, v = _c(major_m) * F.cos(t), _c(minor_m) * F.sin(t)
        return F.struct(
            lon_of(u * ca - v * sa, lat, lon).alias("lon"),
            lat_of(u * sa + v * ca, lat).alias("lat"),
        )
    return F.transform(F.sequence(F.lit(0), F.lit(n)), vertex)
