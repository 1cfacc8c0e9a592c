"""Plausibility rules for recommendations and quality figures of the inputs."""

from __future__ import annotations

import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.functions import lattice, shapes
from cellscape.params import OvershootChecks, UndershootChecks
from cellscape.session import cut_lineage


class Validation(NamedTuple):
    valid: DataFrame
    issues: DataFrame


def _issues(df: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """One row per broken rule; rules are (severity, name, broken, value)."""
    found = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(level).alias("severity"), F.lit(name).alias("rule"), value.cast("double").alias("actual_value")))
        for level, name, broken, value in rules
    ]))
    return df.select("cell_name", F.explode(found).alias("_i")).select("cell_name", "_i.*")


def _split(df: DataFrame, rules) -> Validation:
    issues = _issues(df, rules)
    critical = issues.where(F.col("severity") == "CRITICAL").select("cell_name").distinct()
    return Validation(df.join(critical, "cell_name", "left_anti"), issues)


def _has(df: DataFrame, name: str, default: float | None = 0.0) -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast("double")


def validate_overshooting(df: DataFrame, p: OvershootChecks = OvershootChecks()) -> Validation:
    """Downtilt size, resulting tilt, loss of coverage and signal, and score range."""
    tilt = _has(df, "recommended_downtilt_deg")
    total = _has(df, "current_total_tilt_deg") + tilt
    loss = _has(df, "coverage_reduction_percentage")
    rsrp = _has(df, "avg_rsrp_reduction_db", None)
    score = _has(df, "severity_score", None)
    low, high = p.rsrp_range
    return _split(df, [
        ("CRITICAL", "MAX_DOWNTILT", tilt > p.max_change_deg, tilt),
        ("WARNING", "HIGH_DOWNTILT", (tilt > p.warn_above_deg) & (tilt <= p.max_change_deg), tilt),
        ("CRITICAL", "MAX_TOTAL_TILT", total > p.max_total_tilt_deg, total),
        ("CRITICAL", "NEGATIVE_COVERAGE_REDUCTION", loss < 0, loss),
        ("WARNING", "HIGH_COVERAGE_REDUCTION", loss > p.max_reduction, loss),
        ("WARNING", "LOW_RSRP_REDUCTION", rsrp < low, rsrp),
        ("CRITICAL", "EXCESSIVE_RSRP_REDUCTION", rsrp > high, rsrp),
        ("CRITICAL", "INVALID_SEVERITY_SCORE", ~score.between(0, 1), score),
    ])


def validate_undershooting(df: DataFrame, p: UndershootChecks = UndershootChecks()) -> Validation:
    """Uptilt size, resulting tilt, gains in coverage and distance, and interference range."""
    tilt = _has(df, "recommended_uptilt_deg")
    total = _has(df, "current_total_tilt") - tilt
    gain = _has(df, "coverage_increase_percentage")
    metres = _has(df, "distance_increase_m", None)
    reach = _has(df, "current_distance_m", 1.0)
    share = F.when(reach > 0, metres / reach).otherwise(0.0)
    noise = _has(df, "interference_percentage", None)
    return _split(df, [
        ("CRITICAL", "MAX_UPTILT", tilt > p.max_change_deg, tilt),
        ("WARNING", "HIGH_UPTILT", (tilt > p.warn_above_deg) & (tilt <= p.max_change_deg), tilt),
        ("CRITICAL", "NEGATIVE_TOTAL_TILT", total < p.min_total_tilt_deg, total),
        ("CRITICAL", "NEGATIVE_COVERAGE_INCREASE", gain < 0, gain),
        ("WARNING", "EXCESSIVE_COVERAGE_INCREASE", gain > p.max_coverage_gain, gain),
        ("CRITICAL", "NEGATIVE_DISTANCE_INCREASE", metres < 0, metres),
        ("WARNING", "EXCESSIVE_DISTANCE_INCREASE", (metres >= 0) & (share > p.max_distance_gain), share),
        ("CRITICAL", "INVALID_INTERFERENCE", ~noise.between(0, 1), noise),
        ("WARNING", "HIGH_INTERFERENCE", noise.between(0, 1) & (noise > p.max_interference), noise),
    ])


def issue_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("cell_name").alias("cells"))


def coverage_quality(coverage: DataFrame, day: datetime.date, max_age_days: int = 7) -> DataFrame:
    """One row: geohash lengths seen, rows that no bin can hold, and age of the newest measurement on ``day``."""
    measures = [F.count(F.lit(1)).alias("rows")]
    if "grid" in coverage.columns:
        measures += [F.countDistinct(F.length("grid")).alias("grid_lengths"), F.min(F.length("grid")).alias("shortest_grid")]
        measures.append(F.sum(F.when(F.col("grid").isNull() | lattice.decode(F.col("grid")).isNull(), 1).otherwise(0)).alias("rejected_grids"))
    if "ts" in coverage.columns:
        newest = F.max(F.try_to_timestamp(F.col("ts").cast("string")))
        measures += [newest.alias("newest"), (F.datediff(F.lit(day), newest) > max_age_days).alias("stale")]
    return coverage.agg(*measures)


def input_quality(coverage: DataFrame, gis: DataFrame, hulls: DataFrame | None, cell_pattern: str, min_parse_ratio: float, day: datetime.date) -> DataFrame:
    """Problems of the input tables that detectors pass over in silence, one row per check: (check, rows, problems, ok).

    Counted are signals outside -140 to -30 dBm, rows without event count or distance, cells without an inventory row,
    inventory rows without a position, names the site pattern cannot read, and, of outlines, missing polygons,
    repeated cells and outlines without area.  ``ok`` is false where the names fall below ``min_parse_ratio`` or
    another check has a problem in every row.
    """
    def check(df: DataFrame, name: str, bad) -> DataFrame:
        found = F.sum(F.when(F.coalesce(bad, F.lit(True)), 1).otherwise(0))
        counted = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(found, F.lit(0)).cast("long").alias("problems"))
        return counted.select(F.lit(name).alias("check"), "rows", "problems", ((F.col("rows") == 0) | (F.col("problems") < F.col("rows"))).alias("ok"))

    served = coverage.groupBy("cell_name").agg(F.count(F.lit(1)).alias("n")).join(gis.select("cell_name").distinct().withColumn("_known", F.lit(True)), "cell_name", "left")
    names = check(gis, "name_pattern", ~F.col("cell_name").rlike(cell_pattern))
    out = [
        check(coverage, "signal_range", ~F.col("avg_rsrp").between(-140, -30)),
        check(coverage, "event_count", F.col("event_count").isNull() | (F.col("event_count") <= 0)),
        check(coverage, "distance", F.col("distance_to_cell").isNull() | (F.col("distance_to_cell") < 0)),
        check(served, "inventory_missing", F.col("_known").isNull()),
        check(gis, "position", F.col("latitude").isNull() | F.col("longitude").isNull()),
        names.withColumn("ok", F.col("rows") - F.col("problems") >= min_parse_ratio * F.col("rows")),
    ]
    if hulls is not None:
        shaped = cut_lineage(shapes.with_shape(hulls).select("cell_name", "shape"))  # built once for three checks
        out += [
            check(shaped, "polygon_missing", F.col("shape").isNull()),
            check(shaped.where(F.col("shape").isNotNull()), "polygon_area", ~(shapes.area_km2(F.col("shape")) > 0)),
            check(shaped.groupBy("cell_name").agg(F.count(F.lit(1)).alias("n")), "polygon_repeated", F.col("n") > 1),
        ]
    return reduce(DataFrame.unionByName, out)
