"""Coordinate transforms as column expressions; angles are radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def xyz_at_latitude(x: Column, y: Column, z: Column, lat: Column | float) -> Triple:
    """Local (east, north, up) to celestial axes at a latitude."""
    lat = F.lit(lat) if not isinstance(lat, Column) else lat
    return x, -y * F.sin(lat) + z * F.cos(lat), y * F.cos(lat) + z * F.sin(lat)


def geocentric(lon: Column, lat: Column, height: float = 0.0) -> Triple:
    """Position from the Earth's centre, in metres. Semi-axis and flattening of the WGS84 ellipsoid."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)


def xyz_to_uvw(x: Column, y: Column, z: Column, ha: Column, dec: Column) -> Triple:
    v0 = x * F.sin(ha) + y * F.cos(ha)
    return x * F.cos(ha) - y * F.sin(ha), z * F.cos(dec) + v0 * F.sin(dec), z * F.sin(dec) - v0 * F.cos(dec)


def uvw_to_xyz(u: Column, v: Column, w: Column, ha: Column, dec: Column) -> Triple:
    v0 = v * F.sin(dec) - w * F.cos(dec)
    return u * F.cos(ha) + v0 * F.sin(ha), -u * F.sin(ha) + v0 * F.cos(ha), v * F.cos(dec) + w * F.sin(dec)


def sky_to_lmn(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Triple:
    """Direction cosines about a phase centre; n is less 1."""
    d = ra - ra0
    l = F.cos(dec) * F.sin(d)  # noqa: E741
    m = F.sin(dec) * F.cos(dec0) - F.cos(dec) * F.sin(dec0) * F.cos(d)
    return l, m, F.sin(dec) * F.sin(dec0) + F.cos(dec) * F.cos(dec0) * F.cos(d) - 1


def lmn_to_sky(l: Column, m: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:  # noqa: E741
    n = F.sqrt(F.greatest(1 - l * l - m * m, F.lit(0.0)))
    return ra0 + F.atan2(l, n * F.cos(dec0) - m * F.sin(dec0)), F.asin(m * F.cos(dec0) + n * F.sin(dec0))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    h = F.pow(F.sin((dec2 - dec1) / 2), 2) + F.cos(dec1) * F.cos(dec2) * F.pow(F.sin((ra2 - ra1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def hadec_to_azel(ha: Column, dec: Column, lat: Column) -> tuple[Column, Column]:
    el = F.asin(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(ha))
    az = F.atan2(-F.cos(dec) * F.sin(ha), F.sin(dec) * F.cos(lat) - F.cos(dec) * F.cos(ha) * F.sin(lat))
    return az, el


def azel_to_hadec(az: Column, el: Column, lat: Column) -> tuple[Column, Column]:
    dec = F.asin(F.sin(lat) * F.sin(el) + F.cos(lat) * F.cos(el) * F.cos(az))
    ha = F.atan2(-F.cos(el) * F.sin(az), F.sin(el) * F.cos(lat) - F.cos(el) * F.cos(az) * F.sin(lat))
    return ha, dec


def parallactic_angle(ha: Column, dec: Column, lat: Column) -> Column:
    return F.atan2(F.cos(lat) * F.sin(ha), F.sin(lat) * F.cos(dec) - F.cos(lat) * F.sin(dec) * F.cos(ha))


def compass_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, in degrees from 0 to 360."""
    d = lon2 - lon1
    y, x = F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
