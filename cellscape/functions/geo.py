"""Spherical geometry as column expressions (degrees in, metres or degrees out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dlat = (p2 - p1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dlon), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def wrap360(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from point 1 to point 2, in [0, 360)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return wrap360(F.degrees(F.atan2(east, north)))


def angle_diff(a, b) -> Column:
    """Smallest difference between two bearings, in [0, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def distance_and_bearing(lat1, lon1, lat2, lon2) -> Column:
    return F.struct(
        haversine_m(lat1, lon1, lat2, lon2).alias("distance_m"),
        bearing_deg(lat1, lon1, lat2, lon2).alias("bearing_deg"),
    )


def in_sector(bearing_to_point, azimuth, beamwidth=65.0) -> Column:
    """True when a bearing lies within half the beamwidth of the azimuth."""
    width = beamwidth if isinstance(beamwidth, Column) else F.lit(float(beamwidth))
    return angle_diff(bearing_to_point, azimuth) <= width / 2


def destination(lat, lon, bearing, distance_m) -> Column:
    """Point reached from (lat, lon) along a bearing, as struct(lon, lat)."""
    d = distance_m / F.lit(EARTH_RADIUS_M)
    p, b = F.radians(lat), F.radians(bearing)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.struct(F.degrees(lon2).alias("lon"), F.degrees(lat2).alias("lat"))


def sector_ring(lat, lon, azimuth, hbw, radius_m=500.0, arc_points: int = 9) -> Column:
    """Closed wedge outline of an antenna sector; a full circle when hbw reaches 360."""
    radius = F.lit(float(radius_m))
    steps = F.array(*[F.lit(float(i) / (arc_points - 1)) for i in range(arc_points)])
    arc = F.transform(steps, lambda t: destination(lat, lon, wrap360(azimuth - hbw / 2 + hbw * t), radius))
    site = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    turn = F.array(*[F.lit(10.0 * i) for i in range(37)])
    circle = F.transform(turn, lambda b: destination(lat, lon, b, radius))
    return F.when(hbw >= 360, circle).otherwise(F.concat(site, arc, site))


def circular_mean_terms(angle: Column, weight: Column) -> tuple[Column, Column]:
    """Summands whose totals give a weighted circular mean."""
    return weight * F.sin(F.radians(angle)), weight * F.cos(F.radians(angle))


def circular_mean(sin_sum: Column, cos_sum: Column, weight_sum: Column) -> Column:
    return F.when(weight_sum > 0, wrap360(F.degrees(F.atan2(sin_sum, cos_sum))))
