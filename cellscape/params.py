"""Detector parameters with their default values.

Fixed values throughout: they must equal the published defaults for results to agree.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_ENVIRONMENT = "SUBURBAN"


@dataclass(frozen=True)
class Overshoot:
    edge_traffic_percent: float = 0.15
    min_cell_distance: float = 4000.0
    interference_threshold_db: float = 7.5
    competition_quantile: float = 0.90
    min_cell_count_in_grid: int = 4
    max_percentage_grid_events: float = 0.25
    min_relative_reach: float = 0.70
    max_azimuth_deviation_deg: float = 90.0
    rsrp_degradation_db: float = 10.0
    rsrp_reference_quantile: float = 0.85
    min_overshooting_grids: int = 30
    percentage_overshooting_grids: float = 0.10
    min_rsrp_dbm: float = -140.0
    max_rsrp_dbm: float = -30.0
    missing_rsrp_dbm: float = -140.0
    path_loss_exponent: float = 3.5
    antenna_height_m: float = 30.0
    cell_edge_rsrp_dbm: float = -110.0
    min_resolution_1deg: float = 0.50
    severity_distance_m: tuple = (4000.0, 35000.0)
    severity_rsrp_dbm: tuple = (-70.0, -120.0)
    weights: tuple = (0.30, 0.25, 0.20, 0.15, 0.10)


OVERSHOOT_BY_ENVIRONMENT = {
    "URBAN": Overshoot(
        min_cell_distance=1500.0, min_overshooting_grids=25, edge_traffic_percent=0.12, min_cell_count_in_grid=4,
        interference_threshold_db=8.0, percentage_overshooting_grids=0.08, max_percentage_grid_events=0.25,
        min_relative_reach=0.70,
    ),
    "SUBURBAN": Overshoot(
        min_cell_distance=3500.0, min_overshooting_grids=25, edge_traffic_percent=0.15, min_cell_count_in_grid=3,
        interference_threshold_db=8.0, percentage_overshooting_grids=0.10, max_percentage_grid_events=0.28,
        min_relative_reach=0.68,
    ),
    "RURAL": Overshoot(
        min_cell_distance=8000.0, min_overshooting_grids=22, edge_traffic_percent=0.18, min_cell_count_in_grid=2,
        interference_threshold_db=8.5, percentage_overshooting_grids=0.07, max_percentage_grid_events=0.30,
        min_relative_reach=0.65,
    ),
}


@dataclass(frozen=True)
class Undershoot:
    min_cell_event_count: int = 200
    max_cell_distance: float = 15000.0
    interference_threshold_db: float = 7.5
    competition_quantile: float = 0.90
    max_cell_grid_count: int = 4
    max_interference_percentage: float = 0.20
    min_coverage_increase_1deg: float = 0.05
    min_coverage_increase_2deg: float = 0.10
    min_distance_gain_1deg_m: float = 50.0
    min_distance_gain_2deg_m: float = 100.0
    path_loss_exponent: float = 3.5
    antenna_height_m: float = 30.0
    max_gain_norm: float = 0.50
    weights: tuple = (0.30, 0.25, 0.20, 0.15, 0.10)

    def __post_init__(self):
        if abs(sum(self.weights) - 1.0) > 1e-6:
            raise ValueError("severity weights must sum to 1")


UNDERSHOOT_BY_ENVIRONMENT = {
    "URBAN": Undershoot(
        max_cell_distance=3500.0, max_cell_grid_count=4, max_interference_percentage=0.25,
        min_distance_gain_1deg_m=25.0, min_distance_gain_2deg_m=50.0, path_loss_exponent=4.0,
    ),
    "SUBURBAN": Undershoot(
        max_cell_distance=7000.0, max_cell_grid_count=3, max_interference_percentage=0.20,
        min_distance_gain_1deg_m=50.0, min_distance_gain_2deg_m=100.0, path_loss_exponent=3.5,
    ),
    "RURAL": Undershoot(
        max_cell_distance=12000.0, max_cell_grid_count=2, max_interference_percentage=0.15,
        min_distance_gain_1deg_m=100.0, min_distance_gain_2deg_m=200.0, path_loss_exponent=3.0,
    ),
}

# RSRP gap in dB that counts as interference, by band; 5 for any other band.
BAND_GAP_DB = {
    "L700": 6.0, "L800": 6.0, "N28": 6.0,
    "L1800": 5.0, "L2100": 5.0, "L2600": 5.0, "N1": 5.0, "N3": 5.0, "N7": 5.0,
    "L3500": 4.0, "L3700": 4.0, "N77": 4.0, "N78": 4.0,
}
DEFAULT_BAND_GAP_DB = 5.0


@dataclass(frozen=True)
class Interference:
    min_cells: int = 4
    min_events: int = 2
    min_share: float = 0.05
    dominant_share: float = 0.30
    max_sinr_db: float | None = 0.0
    ring: int = 3
    ring_share: float = 0.33
    clustering: str = "fixed"
    fixed_width_db: float = 5.0
    linkage_width_db: float = 2.5
    perceived: bool = False
    perceived_multiplier: int = 3
    min_cluster_bins: int = 5
    link_bins: int = 1
    norm_bins: float = 100.0
    norm_cells: float = 10.0
    norm_area_km2: float = 5.0
    norm_rsrp_dbm: tuple = (-80.0, -120.0)
    weights: tuple = (0.35, 0.25, 0.20, 0.20)


@dataclass(frozen=True)
class RootCause:
    low_tilt_deg: float = 4.0
    high_tilt_deg: float = 10.0
    tilt_spread_deg: float = 3.0
    min_tilt_deg: float = 0.5
    azimuth_deg: float = 60.0
    very_close_km: float = 0.5
    close_km: float = 1.5
    min_increase_deg: float = 1.0
    max_range_km: float = 2.0
    target_range_km: float = 1.5
    high_priority: tuple = (50, 6)
    medium_priority: tuple = (20, 4)


@dataclass(frozen=True)
class Gaps:
    eps_m: float = 5000.0
    min_hulls: int = 3
    ring: int = 3
    min_missing_neighbours: int = 40
    min_cluster_bins: int = 10
    nearest_cells: int = 5
    link_bins: int = 1
    min_area_km2: float = 1.0
    max_aspect: float = 5.0
    thin_deg: float = 0.015


# RSRP limits by band for URBAN, SUBURBAN, RURAL.
LOW_RSRP_DBM = {
    "L700": (-110.0, -115.0, -120.0), "L800": (-110.0, -115.0, -120.0), "N28": (-105.0, -110.0, -115.0),
    "L1800": (-115.0, -120.0, -125.0), "L2100": (-115.0, -120.0, -125.0), "L2600": (-115.0, -120.0, -125.0),
    "N1": (-115.0, -120.0, -125.0), "N3": (-115.0, -120.0, -125.0), "N7": (-115.0, -120.0, -125.0),
    "L3500": (-118.0, -123.0, -128.0), "L3700": (-118.0, -123.0, -128.0),
    "N77": (-118.0, -123.0, -128.0), "N78": (-118.0, -123.0, -128.0),
}
LOW_RSRP_DEFAULT_DBM = {"URBAN": -110.0, "SUBURBAN": -115.0, "RURAL": -120.0}
MIN_SAMPLES = {"URBAN": 10, "SUBURBAN": 5, "RURAL": 2}


@dataclass(frozen=True)
class LowCoverage:
    rsrp_dbm: float = -115.0
    ring: int = 3
    min_problem_bins: int = 40
    min_cluster_bins: int = 10
    max_km2_per_point: float = 2.0
    min_area_km2: float = 0.5
    min_measured: int = 5
    measured_share: float = 0.2
    min_evidence: int = 2
    evidence_share: float = 0.1
    min_samples: int = 5
    link_bins: int = 1
    norm_area_km2: float = 5.0
    norm_deficit_db: float = 25.0
    listed_cells: int = 10
    weights: tuple = (0.30, 0.25, 0.25, 0.20)


@dataclass(frozen=True)
class Advice:
    radius_m: tuple = (("URBAN", 2000.0), ("SUBURBAN", 5000.0), ("RURAL", 10000.0))
    exponents: tuple = (("URBAN", 4.0), ("SUBURBAN", 3.5), ("RURAL", 3.0))
    max_cells: int = 3
    min_gain_db: float = 3.0
    new_site_margin_db: float = 10.0
    max_uptilt_deg: int = 2
    antenna_height_m: float = 30.0


@dataclass(frozen=True)
class PciPlan:
    keep_active: int = 2
    max_distance_m: float = 30_000.0
    two_hop_factor: float = 0.25
    max_low_activity: float = 5.0
    max_low_share: float = 0.001
    max_single_activity: float = 5.0
    mod3: bool = True
    mod3_factor: float = 0.5
    mod30: bool = False
    mod30_factor: float = 0.3
    validate_range: bool = True
    mod3_bonus: float = 0.25
    mod30_bonus: float = 0.15
    exact_overlap_bonus: float = -0.10


@dataclass(frozen=True)
class PciOverlap:
    overlap: float = 0.10
    min_area_km2: float = 0.0005
    mod_overlap: float = 0.30
    skip_same_site: bool = True
    mod3: bool = True
    mod30: bool = False


@dataclass(frozen=True)
class CarrierAggregation:
    pairs: tuple = (("L800-L1800", "L800", "L1800"), ("L700-L2100", "L700", "L2100"))
    threshold: float = 0.70
    environment_thresholds: tuple = (("URBAN", 0.85), ("SUBURBAN", 0.70), ("RURAL", 0.60))
    cell_pattern: str = r"(SITE\d+)[A-Z0-9]+S(\d)"
    min_samples: int = 100
    max_age_days: int = 30
    max_gap_days: int = 7
    min_parse_ratio: float = 0.5


# Planning radius in km by band.
BAND_RADIUS_KM = {
    "L700": 32.0, "L800": 30.0, "L900": 28.0, "L1800": 25.0, "L2100": 20.0, "L2600": 15.0, "L3500": 10.0, "N78": 2.0,
}


@dataclass(frozen=True)
class Feeders:
    min_distance_m: float = 500.0
    hbw_cap: float = 60.0
    hbw_range: tuple = (1.0, 179.0)
    hbw_factor: float = 1.5
    swap_angle: float = 30.0
    anomaly_ratio: float = 0.5
    anomaly_weight: float = 5.0
    anomaly_relations: int = 5
    anomaly_out: int = 3
    swap_ratio: float = 0.5
    swap_relations: int = 3
    swap_out: int = 2
    listed: int = 5
    strength: str = "weight"


@dataclass(frozen=True)
class DailyTable:
    min_tilt: float = 0.0
    max_tilt: float = 15.0
    status: str = "PENDING"
    created_by: str = "AUTO_GENERATED"


@dataclass(frozen=True)
class OvershootChecks:
    max_change_deg: float = 2.0
    max_total_tilt_deg: float = 15.0
    max_reduction: float = 0.60
    rsrp_range: tuple = (0.0, 25.0)
    warn_above_deg: float = 1.5


@dataclass(frozen=True)
class UndershootChecks:
    max_change_deg: float = 2.0
    min_total_tilt_deg: float = 0.0
    max_coverage_gain: float = 1.0
    max_distance_gain: float = 1.0
    max_interference: float = 0.40
    warn_above_deg: float = 1.5


@dataclass(frozen=True)
class EnvironmentRules:
    urban_km: float = 1.0
    suburban_km: float = 3.0
    nearest_sites: int = 3
    candidates: int = 20
    min_km: float = 0.1
    km_per_degree: float = 111.0
    isolated_km: float = 2.0


def environment_table(spark: SparkSession, by_environment: dict) -> DataFrame:
    """One row per environment with the scalar parameters as columns; three rows by construction."""
    first = next(iter(by_environment.values()))
    scalars = [f.name for f in fields(first) if isinstance(getattr(first, f.name), (int, float))]
    rows = [(env, *[float(asdict(p)[s]) for s in scalars]) for env, p in by_environment.items()]
    schema = "environment string, " + ", ".join(f"p_{s} double" for s in scalars)
    return F.broadcast(spark.createDataFrame(rows, schema))
