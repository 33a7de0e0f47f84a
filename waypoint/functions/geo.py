"""Great-circle expressions in miles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MI = 3958.7613  # fixed value


def haversine_mi(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lon), F.lit(2))
    return _chord_mi(chord)


def _chord_mi(chord: Column) -> Column:
    # Rounding may carry the chord past 1. ``least`` would turn a null into 1.
    return 2 * EARTH_RADIUS_MI * F.asin(F.sqrt(F.when(chord > 1, F.lit(1.0)).otherwise(chord)))


def box_distance_floor_mi(
    lat: Column, lon: Column, lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column
) -> Column:
    """A distance no point of the box can undercut.

    Both terms of the haversine are bounded on their own: the latitude and longitude gaps to the
    box, and the smallest cosine of a latitude inside it. The longitude gap is the shorter way round
    to either edge, so a box beyond 180 degrees is as near as it is.
    """
    zero = F.lit(0.0)

    def around(a: Column, b: Column) -> Column:
        gap = F.abs(a - b)
        return F.least(gap, 360 - gap)

    inside = (lon >= lon_lo) & (lon <= lon_hi)
    lon_gap = F.when(inside, zero).otherwise(F.least(around(lon, lon_lo), around(lon, lon_hi)))
    half_lat = F.radians(F.greatest(lat_lo - lat, lat - lat_hi, zero)) / 2
    half_lon = F.radians(lon_gap) / 2
    flattest = F.least(F.cos(F.radians(lat_lo)), F.cos(F.radians(lat_hi)))
    chord = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat)) * flattest * F.pow(
        F.sin(half_lon), F.lit(2)
    )
    return _chord_mi(chord)
