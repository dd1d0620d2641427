"""Tiles, cell keys and cell areas. All keys are integers; doubles are never joined."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M, SQM_PER_HA
from .nulls import clip


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180, with the floor modulus."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def column_key(lon: Column, west: float, step: float) -> Column:
    return F.floor(F.round((lon - west) / step, 6)).cast("int")


def row_key(lat: Column, north: float, step: float) -> Column:
    return F.floor(F.round((F.lit(north) - lat) / step, 6)).cast("int")


def nearest_key(v: Column, first: float, step: float, n: int) -> Column:
    """Number of the nearest of n regular points from `first`; values beyond the ends get the end, ties the higher point."""
    return clip(F.floor((v - first) / step + 0.5), 0, n - 1).cast("int")


def nearest_year(year: Column, low: int, high: int) -> Column:
    return clip(year, low, high).cast("int")


def cell_area_ha(lat: Column, dlat: float, dlon: float) -> Column:
    """Area in hectares of a cell with the given centre latitude and spacing in degrees."""
    scale = EARTH_RADIUS_M**2 * abs(math.radians(dlat) * math.radians(dlon)) / SQM_PER_HA
    return F.lit(scale) * F.cos(F.radians(lat))


def tile_tag(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Tags such as 50N and 120W of an upper-left corner."""
    south, west = lat < 0, lon < 0
    return (
        F.concat(F.lpad(F.abs(lat).cast("int").cast("string"), 2, "0"), F.when(south, "S").otherwise("N")),
        F.concat(F.lpad(F.abs(lon).cast("int").cast("string"), 3, "0"), F.when(west, "W").otherwise("E")),
    )


def tags_from_box(max_lat: Column, min_lon: Column) -> tuple[Column, Column]:
    """Tags of a bounding box: its upper edge rounded up and its left edge rounded down."""
    return tile_tag(F.ceil(max_lat), F.floor(min_lon))


def tags_from_path(path: Column) -> tuple[Column, Column]:
    """Latitude and longitude tags of a tile file's name."""
    base = F.regexp_extract(path, r"([^/]+?)(?:\.[^/.]*)?$", 1)
    parts = F.split(base, "_")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def signed_degrees(tag: Column) -> Column:
    """The signed degrees of a tag such as 50N or 120W; NULL for anything else."""
    number = F.regexp_extract(tag, r"^(\d{2,3})[NSEW]$", 1)
    value = F.when(number != "", number.cast("int"))
    return F.when(F.right(tag, F.lit(1)).isin("S", "W"), -value).otherwise(value)


def box_from_tags(lat_tag: Column, lon_tag: Column, size: int = 10) -> tuple[Column, Column, Column, Column]:
    """(min_lat, max_lat, min_lon, max_lon) of the tile whose north-west corner has these tags."""
    north, west = signed_degrees(lat_tag), signed_degrees(lon_tag)
    return north - size, north, west, west + size


def tile_of(lat: Column, lon: Column, size: int = 10) -> Column:
    """Id of the tile that holds a point; its upper and left edges belong to it."""
    north = F.ceil(lat / size) * size
    west = F.floor(lon / size) * size
    a, b = tile_tag(north, west)
    return F.concat_ws("_", a, b)


def srtm_box(name: Column) -> tuple[Column, Column]:
    """South-west corner of a 1-degree elevation tile such as N47W122."""
    part = lambda i: F.regexp_extract(name, r"^([NS])(\d{2})([EW])(\d{3})", i)
    lat = F.when(part(1) == "S", -part(2).cast("int")).otherwise(part(2).cast("int"))
    lon = F.when(part(3) == "W", -part(4).cast("int")).otherwise(part(4).cast("int"))
    return lat, lon


def year_doy(tag: Column) -> tuple[Column, Column]:
    """Year and day of an acquisition tag AYYYYDDD."""
    return F.substring(tag, 2, 4).cast("int"), F.substring(tag, 6, 3).cast("int")


def utm_band(lat: Column) -> Column:
    """The letter of the 8-degree UTM latitude band; the last band reaches to 84."""
    letters = "CDEFGHJKLMNPQRSTUVWX"
    index = clip(F.floor((lat + 80) / 8), 0, 19).cast("int")
    return F.when((lat >= -80) & (lat <= 84), F.substring(F.lit(letters), index + 1, F.lit(1)))


#: Southern edges of the UTM latitude bands, and the northern edge of the last.
BAND_EDGES = [*range(-80, 80, 8), 84]
FALSE_NORTHING = 10_000_000.0
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SCALE = 0.9996


def spans_band_edge(min_lat: Column, max_lat: Column) -> Column:
    """Whether latitudes reach over an edge of the bands; touching one with an end is not over it, lying on one as a whole is."""
    edges = F.array(*[F.lit(float(e)) for e in BAND_EDGES])
    return F.exists(edges, lambda e: ((e < max_lat) & (e > min_lat)) | ((e == max_lat) & (e == min_lat)))


def utm_zone(lon: Column) -> Column:
    """Number of the regular 6-degree zone."""
    return (F.floor((wrap_longitude(lon) + 180) / 6) + 1).cast("int")


def utm_forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing (WGS84, series to the fourth power of the third flattening) without the southern false northing."""
    n = _N
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _SCALE * _RADIUS * east, _SCALE * _RADIUS * north


def utm_inverse(east: Column, north: Column, zone: Column) -> tuple[Column, Column]:
    """Latitude and longitude (WGS84) of an easting and a northing without the southern false northing.

    Longitudes go on beyond 180 degrees from the zone's meridian; wrap_longitude brings them back.
    """
    n = _N
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi, eta = north / (_SCALE * _RADIUS), (east - 500000) / (_SCALE * _RADIUS)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)
