"""Distances and grid cells on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_KM / 180.0


def _hav(radians: Column) -> Column:
    return F.pow(F.sin(radians / 2), 2)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    h = (_hav(F.radians(lat2 - lat1))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * _hav(F.radians(lng2 - lng1)))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def box_distance_floor_km(lat: Column, lng: Column, south: Column, north: Column,
                          west: Column, east: Column) -> Column:
    """A distance no point of the box can undercut.

    Each haversine term is minimised on its own: the latitude gap, the longitude gap and the
    smallest cosine inside the box. The longitude gap counts both ways round the globe.
    """
    lat_gap = F.greatest(south - lat, lat - north, F.lit(0.0))
    direct = F.greatest(west - lng, lng - east, F.lit(0.0))
    around = F.greatest(F.lit(0.0), 360.0 - F.greatest(F.abs(lng - west), F.abs(lng - east)))
    lng_gap = F.when((lng >= west) & (lng <= east), F.lit(0.0)).otherwise(F.least(direct, around))
    cos_box = F.least(F.cos(F.radians(south)), F.cos(F.radians(north)))
    h = _hav(F.radians(lat_gap)) + F.cos(F.radians(lat)) * cos_box * _hav(F.radians(lng_gap))
    # the small factor absorbs rounding, so that equal distances are never cut off
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (1 - 1e-9)


def box_distance_ceiling_km(lat: Column, lng: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """A distance no point of the box exceeds: each haversine term is as large as the box allows."""
    lat_gap = F.greatest(F.abs(lat - south), F.abs(lat - north))
    lng_gap = F.least(F.greatest(F.abs(lng - west), F.abs(lng - east)), F.lit(180.0))
    cos_box = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(F.cos(F.radians(south)), F.cos(F.radians(north))))
    h = _hav(F.radians(lat_gap)) + F.cos(F.radians(lat)) * cos_box * _hav(F.radians(lng_gap))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (1 + 1e-9)


def band_of(lat: Column, step_km: float) -> Column:
    """Index of the latitude band of the given height."""
    return F.floor(lat / F.lit(step_km / KM_PER_DEGREE)).cast("long")


def cells_in_band(band: Column, step_km: float) -> Column:
    """How many equal longitude cells circle the globe in a band."""
    middle = (band + F.lit(0.5)) * F.lit(step_km / KM_PER_DEGREE)
    around = F.lit(360.0) * F.cos(F.radians(F.least(F.lit(90.0), F.abs(middle)))) / F.lit(step_km / KM_PER_DEGREE)
    return F.greatest(F.lit(1), F.floor(around)).cast("long")


def cell_of(lng: Column, band: Column, step_km: float) -> Column:
    """Index of the longitude cell inside a band; wraps at the antimeridian."""
    n = cells_in_band(band, step_km)
    return F.pmod(F.floor((lng + 180.0) / 360.0 * n).cast("long"), n)


def longitude_reach(lat: Column, radius_km: float) -> Column:
    """Largest longitude difference, in degrees, of a point within the radius."""
    ratio = F.sin(F.lit(radius_km / EARTH_KM)) / F.cos(F.radians(lat))
    # a radius that covers a pole covers every longitude
    return F.when((F.abs(lat) + radius_km / KM_PER_DEGREE) >= 90.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 1e-9)
