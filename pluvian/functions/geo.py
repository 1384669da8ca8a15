"""Map projection and terrain geometry as column expressions (no Python in the tasks)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvian.functions import constants as K
from pluvian.functions.scalars import col

# --- fixed values: WGS84 ellipsoid and the transverse-Mercator zone (central meridian 99 E) ---
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING_M = 500000.0
CENTRAL_MERIDIAN = 99.0


def krueger_series() -> dict[str, object]:
    """Third-order Krueger coefficients from the flattening."""
    n = FLATTENING / (2.0 - FLATTENING)
    return {
        "radius": SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "ecc": 2 * math.sqrt(n) / (1 + n),
        "alpha": (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240),
        "beta": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480),
        "delta": (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15),
    }


def conformal(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Transverse-Mercator coordinates on the sphere (xi north, eta east)."""
    ecc = F.lit(krueger_series()["ecc"])
    sin_lat = F.sin(F.radians(lat))
    dlon = F.radians(lon - F.lit(CENTRAL_MERIDIAN))
    t = F.sinh(F.atanh(sin_lat) - ecc * F.atanh(ecc * sin_lat))
    return F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))


def onto_ellipsoid(xi: Column, eta: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres from the spherical coordinates."""
    s = krueger_series()
    x, y = eta, xi
    for j, a in enumerate(s["alpha"], start=1):
        x = x + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        y = y + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    k = F.lit(SCALE * s["radius"])
    return F.lit(FALSE_EASTING_M) + k * x, k * y


def utm_forward(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """(easting, northing) in metres, northern hemisphere."""
    return onto_ellipsoid(*conformal(col(lat), col(lon)))


def project(df: DataFrame, lat: str, lon: str, x: str, y: str, unit_m: float = 1000.0) -> DataFrame:
    """Adds projected coordinates. In two steps, so the spherical part is written, and computed, once per row."""
    xi, eta = conformal(F.col(lat), F.col(lon))
    px, py = onto_ellipsoid(F.col("_xi"), F.col("_eta"))
    return df.withColumns({"_xi": xi, "_eta": eta}).withColumns(
        {x: px / F.lit(unit_m), y: py / F.lit(unit_m)}).drop("_xi", "_eta")


def utm_inverse(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    s = krueger_series()
    k = SCALE * s["radius"]
    xi, eta = col(y) / F.lit(k), (col(x) - F.lit(FALSE_EASTING_M)) / F.lit(k)
    xi0, eta0 = xi, eta
    for j, b in enumerate(s["beta"], start=1):
        xi0 = xi0 - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta0 = eta0 - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(s["delta"], start=1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.degrees(lat), F.lit(CENTRAL_MERIDIAN) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))


def bearing(dx: Column | str, dy: Column | str) -> Column:
    """Clockwise from north."""
    return F.atan2(col(dx), col(dy))


def coriolis(lat: Column | str) -> Column:
    return F.lit(2.0 * K.EARTH_ROTATION) * F.sin(F.radians(col(lat)))


def coast_distance_km(lat: Column | str, lon: Column | str) -> Column:
    """Local equirectangular distance to the nearest coast vertex; the vertex list is a literal, so this is a projection."""
    la, lo = col(lat), col(lon)
    per_deg = F.lit(K.COAST_KM_PER_DEGREE)
    dists = []
    for vlat, vlon in K.COAST_VERTICES:
        dy = (la - F.lit(vlat)) * per_deg
        dx = (lo - F.lit(vlon)) * per_deg * F.cos(F.radians((la + F.lit(vlat)) * F.lit(0.5)))
        dists.append(F.sqrt(dx * dx + dy * dy))
    lo_km, hi_km = K.COAST_CLIP_KM
    return F.greatest(F.lit(lo_km), F.least(F.lit(hi_km), F.least(*dists)))


def tile_of(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """South-west corner of the 1-degree terrain tile."""
    return F.floor(col(lat)).cast("int"), F.floor(col(lon)).cast("int")


def in_station_box(lat: Column | str, lon: Column | str) -> Column:
    s, n, w, e = K.STATION_BOX
    return F.coalesce(col(lat).between(s, n) & col(lon).between(w, e), F.lit(False))


def in_land_mask(lat: Column | str, lon: Column | str) -> Column:
    s, n, w, e = K.LAND_OUTER_BOX
    split, pw, pe = K.PENINSULA_BOX
    la, lo = col(lat), col(lon)
    return la.between(s, n) & lo.between(w, e) & ((la >= split) | lo.between(pw, pe))


def in_satellite_crop(lat: Column | str, lon: Column | str) -> Column:
    g = K.SATELLITE_GRID
    m = g["margin"]
    return (col(lat).between(g["lat0"] - m, g["lat0"] + (g["nlat"] - 1) * g["step"] + m)
            & col(lon).between(g["lon0"] - m, g["lon0"] + (g["nlon"] - 1) * g["step"] + m))


def slope_aspect(gx: Column, gy_north: Column) -> tuple[Column, Column, Column]:
    """(slope in degrees, sin and cos of the downslope azimuth) from the eastward and northward height gradient."""
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy_north * gy_north)))
    azimuth = F.pmod(F.atan2(-gx, -gy_north), F.lit(2.0 * math.pi))
    return slope, F.sin(azimuth), F.cos(azimuth)
