"""Cells that serve bins too far out, and the downtilt that would fix them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.functions import antenna, geo
from cellscape.functions.scoring import clip, range_score, ratio, severity_category
from cellscape.operators.checks import COVERAGE, require
from cellscape.operators.competition import BIN_BAND, competition_counts, reference_level
from cellscape.operators.environment import attach_environment
from cellscape.operators.quantile import attach_percentile_range, group_quantiles
from cellscape.params import Overshoot, environment_table
from cellscape.session import cut_lineage


class Overshooters(NamedTuple):
    cells: DataFrame
    bins: DataFrame


def sanitise(coverage: DataFrame, gis: DataFrame, p: Overshoot) -> tuple[DataFrame, DataFrame]:
    """Drop unusable measurements and inventory rows without a valid position."""
    ok = F.col("cell_name").isNotNull() & F.col("avg_rsrp").between(p.min_rsrp_dbm, p.max_rsrp_dbm)
    if "distance_to_cell" in coverage.columns:
        ok = ok & (F.col("distance_to_cell") >= 0)
    placed = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return coverage.where(ok), gis.where(F.col("cell_name").isNotNull() & placed)


def with_distance(coverage: DataFrame, gis: DataFrame) -> DataFrame:
    """``distance_m``: as measured, else computed from the inventory."""
    if "distance_to_cell" in coverage.columns:
        return coverage.withColumn("distance_m", F.col("distance_to_cell"))
    site = gis.select("cell_name", F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"))
    d = geo.haversine_m(F.col("latitude"), F.col("longitude"), F.col("_slat"), F.col("_slon"))
    return coverage.join(site, "cell_name").withColumn("distance_m", d).drop("_slat", "_slon")


def in_beam(coverage: DataFrame, max_deviation_deg: float) -> DataFrame:
    """Rows inside the main beam; all rows where the deviation is not known."""
    if "grid_bearing_diff" not in coverage.columns:
        return coverage
    return coverage.where(F.col("grid_bearing_diff") <= max_deviation_deg)


def edge_bins(coverage: DataFrame, cells: DataFrame | None, p: Overshoot, by_environment: dict | None = None) -> DataFrame:
    """Rows in the furthest share of their cell's in-beam bins.

    With environments the share depends on the cell's class: one pass computes the quantile
    of every class and each cell keeps its own.
    """
    rows = in_beam(coverage, p.max_azimuth_deviation_deg)
    if by_environment is None:
        limits = group_quantiles(
            rows, ["cell_name"], "distance_m", {"edge_distance_m": 1 - p.edge_traffic_percent}, 5.0
        )
    else:
        wanted = {f"_q_{env}": 1 - q.edge_traffic_percent for env, q in by_environment.items()}
        pick = F.coalesce(*[F.when(F.col("environment") == env, F.col(f"_q_{env}")) for env in by_environment])
        limits = group_quantiles(rows, ["cell_name"], "distance_m", wanted, 5.0).join(cells, "cell_name")
        limits = limits.select("cell_name", pick.alias("edge_distance_m"))
    # Rounding keeps a row that lies exactly on its limit.
    limits = cut_lineage(limits.withColumn("edge_distance_m", F.round("edge_distance_m", 6)))
    return rows.join(limits, "cell_name").where(F.col("distance_m") >= F.col("edge_distance_m"))


def cell_metrics(coverage: DataFrame, edges: DataFrame, p: Overshoot) -> DataFrame:
    """Reach, bins and reference signal of every cell, and the same for its edge."""
    overall = coverage.groupBy("cell_name").agg(
        F.max("distance_m").alias("max_distance_m"), F.countDistinct("ix", "iy").alias("total_grids")
    )
    level = group_quantiles(coverage, ["cell_name"], "avg_rsrp", {"cell_max_rsrp": p.rsrp_reference_quantile}, 0.25)
    edge = edges.groupBy("cell_name").agg(
        F.countDistinct("ix", "iy").alias("edge_grids"), F.avg("avg_rsrp").alias("avg_edge_rsrp")
    )
    return overall.join(level, "cell_name", "left").join(edge, "cell_name", "left").withColumns({
        "edge_grids": F.coalesce("edge_grids", F.lit(0).cast("long")),
        "avg_edge_rsrp": F.coalesce("avg_edge_rsrp", F.lit(p.missing_rsrp_dbm)),
    })


def _limit(name: str, p: Overshoot, by_environment: dict | None) -> Column:
    return F.col(f"p_{name}") if by_environment else F.lit(getattr(p, name))


def overshooting_bins(
    coverage: DataFrame,
    edges: DataFrame,
    metrics: DataFrame,
    p: Overshoot,
    by_environment: dict | None = None,
) -> DataFrame:
    """Edge rows that pass the competition, traffic, reach and signal tests.

    Without environments competition is counted among edge rows, with them among all rows
    and at the widest threshold of the classes.
    """
    level = cut_lineage(reference_level(coverage, p.competition_quantile))
    levelled = edges.join(level, BIN_BAND, "left")
    if by_environment is None:
        counts = competition_counts(levelled, p.interference_threshold_db)
    else:
        widest = max(q.interference_threshold_db for q in by_environment.values())
        everything = coverage.select("ix", "iy", "band", "cell_name", "avg_rsrp", "event_count")
        counts = competition_counts(everything.join(level, BIN_BAND, "left"), widest)
    furthest = coverage.groupBy(*BIN_BAND).agg(F.max("distance_m").alias("grid_max_distance"))
    rows = levelled.join(counts.join(furthest, BIN_BAND), BIN_BAND, "left").join(
        metrics.select("cell_name", "cell_max_rsrp", *[c for c in metrics.columns if c.startswith("p_")]), "cell_name"
    )
    rows = rows.withColumns({
        "competing_cells": F.coalesce("competing_cells", F.lit(0).cast("long")),
        "cell_traffic_pct": ratio(F.col("event_count"), F.col("grid_total_traffic")),
        "relative_reach": F.try_divide(F.col("distance_m"), F.col("grid_max_distance")),
    })
    return rows.where(
        (F.col("competing_cells") >= _limit("min_cell_count_in_grid", p, by_environment))
        & (F.col("cell_traffic_pct") <= _limit("max_percentage_grid_events", p, by_environment))
        & (F.col("relative_reach") >= _limit("min_relative_reach", p, by_environment))
        & (F.col("avg_rsrp") <= F.round(F.col("cell_max_rsrp") - p.rsrp_degradation_db, 6))
    )


def tilt_effect(cells: DataFrame, bins: DataFrame, coverage: DataFrame, gis: DataFrame, p: Overshoot, own_level: bool = False) -> DataFrame:
    """Bins resolved and reach left after 1 and 2 degrees of downtilt, and the tilt to choose.

    ``own_level`` compares a bin with its own signal instead of the reference level.
    """
    site = gis.select("cell_name", "tilt_mech", "tilt_elc", "latitude", "longitude", "antenna_height")
    cells = cells.join(site, "cell_name", "left").withColumns({
        "antenna_height_m": F.coalesce("antenna_height", F.lit(p.antenna_height_m)),
        "_tilt": F.coalesce("tilt_elc", F.lit(0.0)),
    })
    for n in (1, 2):
        reach = antenna.distance_after_downtilt(
            F.col("max_distance_m"), F.col("_tilt"), F.col("antenna_height_m"), float(n), p.path_loss_exponent
        )
        cells = cells.withColumn(f"_reach{n}", reach)
    geometry = cells.select("cell_name", "_tilt", "antenna_height_m", "_reach1", "_reach2")
    level = F.col("avg_rsrp") if own_level else F.col("p90_rsrp_in_grid")

    def after(n: int) -> Column:
        return F.col("avg_rsrp") - antenna.downtilt_loss(
            F.col("distance_m"), F.col("_tilt"), F.col("antenna_height_m"), float(n)
        )

    def resolved(n: int) -> Column:
        gone = (F.col("distance_m") > F.col(f"_reach{n}")) | (level - after(n) > p.interference_threshold_db)
        return F.sum(F.when(gone, 1).otherwise(0)).cast("long").alias(f"grids_resolved_{n}deg")

    fixed = bins.join(geometry, "cell_name").groupBy("cell_name").agg(
        resolved(1), resolved(2), F.count(F.lit(1)).alias("_bins")
    )
    served = (
        coverage.select("cell_name", "distance_m", "avg_rsrp")
        .join(geometry, "cell_name")
        .groupBy("cell_name")
        .agg(*[
            F.coalesce(F.max(F.when(after(n) >= p.cell_edge_rsrp_dbm, F.col("distance_m"))), F.lit(0.0)).alias(
                f"new_max_distance_{n}deg_m"
            )
            for n in (1, 2)
        ])
    )
    out = cells.join(fixed, "cell_name", "left").join(served, "cell_name", "left").drop("_tilt", "_reach1", "_reach2")
    out = out.withColumns({
        "resolution_1deg_pct": ratio(F.col("grids_resolved_1deg"), F.col("_bins")),
        "resolution_2deg_pct": ratio(F.col("grids_resolved_2deg"), F.col("_bins")),
    })
    return out.withColumn(
        "recommended_tilt_change", F.when(F.col("resolution_1deg_pct") >= p.min_resolution_1deg, 1).otherwise(2)
    ).drop("_bins")


def interference_reduction(cells: DataFrame) -> DataFrame:
    """Flagged bins before and after the chosen tilt."""
    removed = F.when(F.col("recommended_tilt_change") == 1, F.col("grids_resolved_1deg")).otherwise(
        F.col("grids_resolved_2deg")
    )
    out = cells.withColumns({
        "current_interference_grids": F.col("overshooting_grids"),
        "current_interference_pct": F.col("percentage_overshooting"),
        "removed_interference_grids": removed,
        "new_interference_grids": F.col("overshooting_grids") - removed,
    })
    return out.withColumns({
        "new_interference_pct": ratio(F.col("new_interference_grids"), F.col("total_grids")),
        "interference_reduction_pct": ratio(F.col("removed_interference_grids"), F.col("overshooting_grids")) * 100,
    })


def severity(cells: DataFrame, p: Overshoot) -> DataFrame:
    """Weighted score of flagged bins, their share, reach, edge signal and footprint."""
    out = attach_percentile_range(cells, {"overshooting_grids": 4.0, "total_grids": 16.0})

    def spread(c: str) -> Column:
        return range_score(F.col(c), F.col(f"_p_{c}.low"), F.col(f"_p_{c}.high"), degenerate=None)

    near, far = p.severity_distance_m
    best, worst = p.severity_rsrp_dbm
    parts = (
        spread("overshooting_grids"),
        F.col("percentage_overshooting"),
        clip((F.col("max_distance_m") - near) / (far - near)),
        clip((F.col("avg_edge_rsrp") - best) / (worst - best)),
        spread("total_grids"),
    )
    score = clip(sum(w * x for w, x in zip(p.weights, parts)))
    out = out.withColumn("severity_score", score).drop("_p_overshooting_grids", "_p_total_grids")
    return out.withColumn("severity_category", severity_category(F.col("severity_score"), strict=True))


def flagged_cells(metrics: DataFrame, bins: DataFrame, p: Overshoot, by_environment: dict | None = None) -> DataFrame:
    """Cells with enough reach, enough flagged bins and a large enough share of them."""
    counted = bins.groupBy("cell_name").agg(F.countDistinct("ix", "iy").alias("overshooting_grids"))
    out = metrics.where(F.col("max_distance_m") >= _limit("min_cell_distance", p, by_environment))
    out = out.join(counted, "cell_name", "left").withColumn(
        "overshooting_grids", F.coalesce("overshooting_grids", F.lit(0).cast("long"))
    )
    out = out.withColumn("percentage_overshooting", F.col("overshooting_grids") / F.col("total_grids"))
    return out.where(
        (F.col("overshooting_grids") >= _limit("min_overshooting_grids", p, by_environment))
        & (F.col("percentage_overshooting") >= _limit("percentage_overshooting_grids", p, by_environment))
    )


def detect_overshooting(
    coverage: DataFrame,
    gis: DataFrame,
    params: Overshoot = Overshoot(),
    environment: DataFrame | None = None,
    by_environment: dict[str, Overshoot] | None = None,
    own_level: bool = False,
) -> Overshooters:
    """Overshooting cells with a downtilt recommendation, and the bins behind them.

    With ``environment`` and ``by_environment`` each cell is judged by the limits of its class.
    """
    require(coverage, "overshooting", *COVERAGE)
    require(gis, "overshooting", "cell_name")
    coverage, gis = sanitise(coverage, gis, params)
    rows = with_distance(coverage, gis)
    classes = None
    if by_environment is not None:
        limits = environment_table(coverage.sparkSession, by_environment)
        names = rows.select("cell_name").distinct()
        classes = cut_lineage(attach_environment(names, environment).join(limits, "environment"))
    edges = edge_bins(rows, classes and classes.select("cell_name", "environment"), params, by_environment)
    metrics = cell_metrics(rows, edges, params)
    if classes is not None:
        metrics = metrics.join(classes, "cell_name")
    metrics = cut_lineage(metrics)
    bins = cut_lineage(overshooting_bins(rows, edges, metrics, params, by_environment))
    cells = flagged_cells(metrics, bins, params, by_environment)
    cells = cut_lineage(interference_reduction(tilt_effect(cells, bins, rows, gis, params, own_level)))
    cells = severity(cells, params)
    limits = [c for c in metrics.columns if c.startswith("p_")]
    bins = bins.drop(*limits)
    if classes is not None:
        bins = bins.join(classes.select("cell_name", "environment"), "cell_name")
    return Overshooters(cells.drop(*limits), bins)


