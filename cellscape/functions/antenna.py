"""Vertical antenna pattern and log-distance path loss as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HPBW_V_DEG = 6.5
SLA_V_DB = 30.0
PATTERN_COEFFICIENT = 12.0


def elevation_deg(height_m, distance_m) -> Column:
    return F.degrees(F.atan2(height_m, distance_m))


def vertical_attenuation(theta, tilt, hpbw: float = HPBW_V_DEG, sla: float = SLA_V_DB) -> Column:
    off_axis = (theta - tilt) / F.lit(hpbw)
    return F.least(PATTERN_COEFFICIENT * off_axis * off_axis, F.lit(sla))


def attenuation_change(distance_m, tilt, height_m, delta_deg: float, hpbw=HPBW_V_DEG, sla=SLA_V_DB) -> Column:
    """Attenuation after minus before a tilt change (positive delta tilts down)."""
    theta = elevation_deg(height_m, distance_m)
    return vertical_attenuation(theta, tilt + delta_deg, hpbw, sla) - vertical_attenuation(theta, tilt, hpbw, sla)


def downtilt_loss(distance_m, tilt, height_m, delta_deg: float) -> Column:
    """RSRP lost at a bin by tilting down, never negative."""
    return F.greatest(attenuation_change(distance_m, tilt, height_m, delta_deg), F.lit(0.0))


def distance_after_downtilt(max_distance_m, tilt, height_m, delta_deg: float, exponent=3.5) -> Column:
    """Reach after tilting down; never grows; unusable inputs pass through."""
    gain = -attenuation_change(max_distance_m, tilt, height_m, delta_deg)
    reach = max_distance_m * F.pow(F.lit(10.0), gain / (10.0 * exponent))
    usable = (max_distance_m > 0) & (height_m >= 0)
    return F.when(usable, F.least(reach, max_distance_m)).otherwise(max_distance_m)


def distance_after_uptilt(max_distance_m, total_tilt, height_m, delta_deg: float, exponent=3.5) -> Column:
    """Reach after tilting up; never shrinks; a cell already at zero tilt keeps its reach."""
    gain = -attenuation_change(max_distance_m, total_tilt, height_m, -delta_deg)
    reach = max_distance_m * F.pow(F.lit(10.0), gain / (10.0 * exponent))
    usable = (max_distance_m > 0) & (height_m > 0) & (total_tilt > 0)
    return F.when(usable, F.greatest(reach, max_distance_m)).otherwise(max_distance_m)


def sinr_from_rsrp_rsrq(rsrp, rsrq, resource_blocks: int = 50, offset_db: float = 0.0) -> Column:
    """SINR in dB implied by reference-signal power and quality, null when not positive."""
    signal = F.pow(F.lit(10.0), rsrp / 10)
    total = resource_blocks * signal / F.pow(F.lit(10.0), rsrq / 10)
    rest = total - signal
    return F.when(rest > 0, 10 * F.log10(signal / rest) + offset_db)
