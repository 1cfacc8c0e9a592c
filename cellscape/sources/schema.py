"""Canonical schemas and the column aliases accepted for them."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in fields])


COVERAGE = _schema(
    ("grid", StringType), ("ix", IntegerType), ("iy", IntegerType), ("cell_name", StringType), ("band", StringType),
    ("avg_rsrp", DoubleType), ("avg_rsrq", DoubleType), ("avg_sinr", DoubleType), ("event_count", LongType),
    ("distance_to_cell", DoubleType), ("latitude", DoubleType), ("longitude", DoubleType),
    ("perc_grid_events", DoubleType), ("perc_cell_events", DoubleType), ("grid_bearing_diff", DoubleType), ("ts", TimestampType),
)
CELL_GIS = _schema(
    ("cell_name", StringType), ("site", StringType), ("band", StringType), ("pci", IntegerType), ("latitude", DoubleType),
    ("longitude", DoubleType), ("bearing", DoubleType), ("hbw", DoubleType), ("tilt_elc", DoubleType), ("tilt_mech", DoubleType),
    ("antenna_height", DoubleType), ("tx_power", DoubleType), ("min_tilt", DoubleType), ("max_tilt", DoubleType),
    ("cell_cilac", LongType), ("on_air", BooleanType),
)
RELATIONS = _schema(
    ("cell_name", StringType), ("to_cell_name", StringType), ("pci", IntegerType), ("to_pci", IntegerType), ("band", StringType),
    ("to_band", StringType), ("weight", DoubleType), ("cell_perc_weight", DoubleType), ("distance", DoubleType),
    ("intra_site", StringType), ("intra_cell", StringType), ("neighbor_relation", StringType), ("traffic_data", DoubleType),
    ("drops_voice", DoubleType),
)
HULLS = _schema(
    ("cell_name", StringType), ("wkt", StringType), ("area_km2", DoubleType), ("sample_count", LongType), ("data_timestamp", StringType),
)

REQUIRED = {
    "coverage": ["grid", "cell_name", "avg_rsrp", "event_count"],
    "cell_gis": ["cell_name", "latitude", "longitude"],
    "relations": ["cell_name", "to_cell_name"],
    "hulls": ["cell_name", "wkt"],
}

# Accepted spellings of a column, best first; the canonical name itself always wins.
ALIASES = {
    "coverage": {
        "grid": ["geohash7", "geohash"], "cell_name": ["cilac", "CILAC", "Name"], "band": ["Band", "frequency_band"],
        "event_count": ["total_traffic"], "distance_to_cell": ["distance_m"],
    },
    "cell_gis": {
        "cell_name": ["Name", "cilac", "CILAC"], "latitude": ["Latitude", "lat"], "longitude": ["Longitude", "lon"], "site": ["SiteID"],
        "band": ["Band"], "bearing": ["Bearing", "azimuth"], "hbw": ["HBW"], "tilt_elc": ["TiltE", "elec_tilt"], "tilt_mech": ["TiltM", "mech_tilt"],
        "antenna_height": ["Height"], "pci": ["Scr_Freq"],
    },
    "relations": {
        "to_cell_name": ["cell_impact_name"], "pci": ["cell_pci"], "to_pci": ["cell_impact_pci"], "band": ["cell_band"],
        "to_band": ["cell_impact_band"], "weight": ["cell_perc_weight", "relation_impact_data_perc"], "intra_site": ["co_site"], "intra_cell": ["co_sectored"],
    },
    "hulls": {"wkt": ["geometry"], "cell_name": ["Name"]},
}
SCHEMAS = {"coverage": COVERAGE, "cell_gis": CELL_GIS, "relations": RELATIONS, "hulls": HULLS}
