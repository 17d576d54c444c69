"""Map projections as column expressions (and scalar twins for plan-time
bounds).  Public closed forms on the sphere:

* sinusoidal (MODIS grid sphere):  X = R lon cos(lat), Y = R lat
* Web Mercator:                    X = R lon, Y = R ln(tan(pi/4 + lat/2))

Angles in degrees at the interface, radians inside.  Points that a
projection cannot represent give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridfold.model import SINUSOIDAL, WEB_MERCATOR, WGS84

# Sphere radii of the two projections (metres).
R_SINUSOIDAL = 6371007.181
R_WEB_MERCATOR = 6378137.0

SUPPORTED = (WGS84, SINUSOIDAL, WEB_MERCATOR)
# Points exactly on the antimeridian or a pole come back a few ulps outside
# after a round trip; they stay valid.
EDGE_EPS = 1e-12


def _check(crs: str) -> None:
    if crs not in SUPPORTED:
        raise ValueError(f"CRS {crs} not supported; supported: {', '.join(SUPPORTED)}")


def _from_lonlat(crs: str, lon: Column, lat: Column) -> tuple[Column, Column]:
    if crs == WGS84:
        return lon, lat
    lam, phi = F.radians(lon), F.radians(lat)
    ok = (F.abs(lon) <= 180.0 + EDGE_EPS) & (F.abs(lat) <= 90.0 + EDGE_EPS)
    if crs == SINUSOIDAL:
        x, y = F.lit(R_SINUSOIDAL) * lam * F.cos(phi), F.lit(R_SINUSOIDAL) * phi
    else:  # Web Mercator, undefined at the poles
        ok = ok & (F.abs(lat) < 90.0)
        x = F.lit(R_WEB_MERCATOR) * lam
        y = F.lit(R_WEB_MERCATOR) * F.ln(F.tan(F.lit(math.pi / 4) + phi / 2))
    return F.when(ok, x), F.when(ok, y)


def _to_lonlat(crs: str, x: Column, y: Column) -> tuple[Column, Column]:
    if crs == WGS84:
        return x, y
    if crs == SINUSOIDAL:
        phi = y / F.lit(R_SINUSOIDAL)
        lam = F.try_divide(x, F.lit(R_SINUSOIDAL) * F.cos(phi))
        ok = (F.abs(phi) <= math.pi / 2 + EDGE_EPS) & (F.abs(lam) <= math.pi + EDGE_EPS)
    else:
        lam = x / F.lit(R_WEB_MERCATOR)
        phi = F.lit(2.0) * F.atan(F.exp(y / F.lit(R_WEB_MERCATOR))) - F.lit(math.pi / 2)
        ok = F.abs(lam) <= math.pi + EDGE_EPS
    return F.when(ok, F.degrees(lam)), F.when(ok, F.degrees(phi))


def transform(src: str, dst: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Columns (x, y) in ``src`` -> columns in ``dst``."""
    _check(src)
    _check(dst)
    if src == dst:
        return x, y
    lon, lat = _to_lonlat(src, x, y)
    return _from_lonlat(dst, lon, lat)


def latitude(crs: str, y: Column) -> Column:
    """Latitude of a y coordinate, cut to the poles."""
    _check(crs)
    lat = y
    if crs == SINUSOIDAL:
        lat = F.degrees(y / F.lit(R_SINUSOIDAL))
    elif crs == WEB_MERCATOR:
        lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(R_WEB_MERCATOR))) - F.lit(math.pi / 2))
    return F.least(F.greatest(lat, F.lit(-90.0)), F.lit(90.0))


def longitude(crs: str, x: Column, lat: Column) -> Column:
    """Longitude of an x coordinate on the parallel ``lat``, cut to +-180 (on a
    lon/lat grid as it is)."""
    _check(crs)
    if crs == WGS84:
        return x
    if crs == SINUSOIDAL:
        lon = F.degrees(x / F.greatest(F.lit(R_SINUSOIDAL) * F.cos(F.radians(lat)), F.lit(1e-9)))
    else:
        lon = F.degrees(x / F.lit(R_WEB_MERCATOR))
    return F.least(F.greatest(lon, F.lit(-180.0)), F.lit(180.0))


# -- scalar twins for plan-time geometry (bounds of a GridSpec) ----------------
def _from_lonlat_s(crs, lon, lat):
    if crs == WGS84:
        return lon, lat
    lam, phi = math.radians(lon), math.radians(lat)
    if crs == SINUSOIDAL:
        return R_SINUSOIDAL * lam * math.cos(phi), R_SINUSOIDAL * phi
    if abs(lat) >= 90:
        return None
    return R_WEB_MERCATOR * lam, R_WEB_MERCATOR * math.log(math.tan(math.pi / 4 + phi / 2))


def _to_lonlat_s(crs, x, y):
    if crs == WGS84:
        return x, y
    if crs == SINUSOIDAL:
        phi = y / R_SINUSOIDAL
        c = math.cos(phi)
        if abs(phi) > math.pi / 2 + EDGE_EPS or c <= 0:
            return None
        lam = x / (R_SINUSOIDAL * c)
        if abs(lam) > math.pi + EDGE_EPS:
            return None
        return math.degrees(lam), math.degrees(phi)
    lam = x / R_WEB_MERCATOR
    phi = 2 * math.atan(math.exp(y / R_WEB_MERCATOR)) - math.pi / 2
    return math.degrees(lam), math.degrees(phi)


def transform_point(src: str, dst: str, x: float, y: float):
    _check(src)
    _check(dst)
    if src == dst:
        return x, y
    ll = _to_lonlat_s(src, x, y)
    return None if ll is None else _from_lonlat_s(dst, *ll)


def transform_bounds(src: str, dst: str, bounds, densify: int = 21):
    """(west, south, east, north) of a box in ``src`` as seen in ``dst``:
    the box edges are sampled (``densify`` points each, plus the equator and
    the central meridian when crossed) and the extremes of the transformed
    samples are taken."""
    w, s, e, n = bounds
    if src == dst:
        return bounds
    xs = [w + (e - w) * i / (densify - 1) for i in range(densify)]
    ys = [s + (n - s) * i / (densify - 1) for i in range(densify)]
    if w < 0 < e:
        xs.append(0.0)
    if s < 0 < n:
        ys.append(0.0)
    pts = [(x, s) for x in xs] + [(x, n) for x in xs] + [(w, y) for y in ys] + [(e, y) for y in ys]
    out = [p for p in (transform_point(src, dst, x, y) for x, y in pts) if p is not None]
    if not out:
        raise ValueError("bounds cannot be transformed")
    return (min(p[0] for p in out), min(p[1] for p in out),
            max(p[0] for p in out), max(p[1] for p in out))
