"""Cells whose reach could grow by tilting up without adding interference."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.functions import antenna
from cellscape.functions.scoring import clip, range_score, ratio, round_half_even, severity_category
from cellscape.operators.checks import COVERAGE, require
from cellscape.operators.competition import BIN_BAND, competition_counts, with_reference_level
from cellscape.operators.environment import attach_environment
from cellscape.operators.quantile import attach_percentile_range
from cellscape.params import Undershoot, environment_table
from cellscape.session import cut_lineage

# Fixed value: note of the output.
MIN_TILT_NOTE = "Cell at minimum tilt (0 deg) - investigate physical build"
OUTPUT = [
    "cell_name", "max_distance_m", "total_grids", "interference_grids", "interference_percentage", "total_traffic",
    "tilt_mech", "tilt_elc", "recommended_uptilt_deg", "new_max_distance_m", "coverage_increase_percentage",
    "current_coverage_grids", "current_distance_m", "distance_increase_m", "new_coverage_grids",
    "total_coverage_after_uptilt", "severity_score", "severity_category", "physical_constraint_note",
]


class Undershooters(NamedTuple):
    cells: DataFrame
    bins: DataFrame


def sanitise(coverage: DataFrame, gis: DataFrame) -> DataFrame:
    """Complete rows with a positive distance; a missing band comes from the inventory."""
    rows = coverage.withColumn("cell_name", F.col("cell_name").cast("string"))
    if "band" not in rows.columns:
        bands = gis.groupBy("cell_name").agg(F.min("band").alias("band"))
        rows = rows.join(bands, "cell_name", "left")
    needed = ["cell_name", "avg_rsrp", "distance_to_cell", "event_count"]
    return rows.dropna(subset=needed).where(F.col("distance_to_cell") > 0)


def cell_statistics(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("cell_name").agg(
        F.max("distance_to_cell").alias("max_distance_m"),
        F.sum("event_count").alias("total_traffic"),
        F.count(F.lit(1)).alias("total_grids"),
    )


def _limit(name: str, p: Undershoot, by_environment: dict | None) -> Column:
    return F.col(f"p_{name}") if by_environment else F.lit(getattr(p, name))


def interfering_rows(coverage: DataFrame, candidates: DataFrame, p: Undershoot, by_environment=None) -> DataFrame:
    """Rows of candidate cells in bins where too many rows of the band compete."""
    levelled = with_reference_level(coverage, coverage, p.competition_quantile)
    counts = competition_counts(levelled, p.interference_threshold_db).select(*BIN_BAND, "competing_rows")
    limits = candidates.select("cell_name", *[c for c in candidates.columns if c.startswith("p_")])
    rows = coverage.join(limits, "cell_name").join(counts, BIN_BAND, "left")
    return rows.where(F.col("competing_rows") > _limit("max_cell_grid_count", p, by_environment))


def with_interference(candidates: DataFrame, bins: DataFrame) -> DataFrame:
    counted = bins.groupBy("cell_name").agg(F.count(F.lit(1)).alias("interference_grids"))
    out = candidates.join(counted, "cell_name", "left").withColumn(
        "interference_grids", F.coalesce("interference_grids", F.lit(0).cast("long"))
    )
    return out.withColumn("interference_percentage", ratio(F.col("interference_grids"), F.col("total_grids")))


def join_inventory(candidates: DataFrame, gis: DataFrame) -> DataFrame:
    kept = [c for c in ("tilt_mech", "tilt_elc", "antenna_height", "latitude", "longitude") if c in gis.columns]
    return candidates.join(gis.select("cell_name", *kept), "cell_name")


def uptilt_impact(cells: DataFrame, p: Undershoot, by_environment: dict | None = None) -> DataFrame:
    """Reach and relative gain after 1 and 2 degrees of uptilt."""
    tilt = F.coalesce("tilt_mech", F.lit(0.0)) + F.coalesce("tilt_elc", F.lit(0.0))
    height = F.coalesce("antenna_height", F.lit(p.antenna_height_m))
    exponent = _limit("path_loss_exponent", p, by_environment)
    out = cells.withColumn("uptilt_constraint", F.when(tilt <= 0, "MIN_TILT_REACHED"))
    d = F.col("max_distance_m")
    for n in (1, 2):
        out = out.withColumn(
            f"new_distance_{n}deg_m", antenna.distance_after_uptilt(d, tilt, height, float(n), exponent)
        ).withColumn(f"coverage_increase_{n}deg_pct", ratio(F.col(f"new_distance_{n}deg_m") - d, d))
    return out


def choose_uptilt(cells: DataFrame, p: Undershoot, by_environment: dict | None = None, keep_constrained: bool = False) -> DataFrame:
    """Two degrees if the gain is worth it, else one, else none."""
    d = F.col("max_distance_m")

    def worth(n: int) -> Column:
        enough = F.col(f"coverage_increase_{n}deg_pct") >= _limit(f"min_coverage_increase_{n}deg", p, by_environment)
        far = F.col(f"new_distance_{n}deg_m") - d >= _limit(f"min_distance_gain_{n}deg_m", p, by_environment)
        return enough & far

    def pick(two, one, none):
        return F.when(worth(2), two).when(worth(1), one).otherwise(none)

    out = cells.withColumns({
        "recommended_uptilt_deg": pick(F.lit(2), F.lit(1), F.lit(0)),
        "new_max_distance_m": pick(F.col("new_distance_2deg_m"), F.col("new_distance_1deg_m"), d),
        "coverage_increase_percentage": pick(
            F.col("coverage_increase_2deg_pct"), F.col("coverage_increase_1deg_pct"), F.lit(0.0)
        ),
        "physical_constraint_note": F.when(F.col("uptilt_constraint").isNotNull(), MIN_TILT_NOTE),
    })
    kept = F.col("recommended_uptilt_deg") > 0
    if keep_constrained:
        kept = kept | F.col("uptilt_constraint").isNotNull()
    return out.where(kept)


def expansion_metrics(cells: DataFrame) -> DataFrame:
    gained = round_half_even(F.col("total_grids") * F.col("coverage_increase_percentage"))
    return cells.withColumns({
        "current_coverage_grids": F.col("total_grids"),
        "current_distance_m": F.col("max_distance_m"),
        "distance_increase_m": F.col("new_max_distance_m") - F.col("max_distance_m"),
        "new_coverage_grids": gained,
        "total_coverage_after_uptilt": F.col("total_grids") + gained,
    })


def severity(cells: DataFrame, p: Undershoot) -> DataFrame:
    names = {"new_coverage_grids": 4.0, "distance_increase_m": 10.0, "total_grids": 16.0}
    out = attach_percentile_range(cells, names)

    def spread(c: str) -> Column:
        return range_score(F.col(c), F.col(f"_p_{c}.low"), F.col(f"_p_{c}.high"))

    parts = (
        clip(F.col("coverage_increase_percentage") / p.max_gain_norm),
        spread("new_coverage_grids"),
        1.0 - F.col("interference_percentage"),
        spread("distance_increase_m"),
        spread("total_grids"),
    )
    out = out.withColumn("severity_score", clip(sum(w * x for w, x in zip(p.weights, parts))))
    out = out.withColumn("severity_category", severity_category(F.col("severity_score")))
    return out.drop(*[f"_p_{c}" for c in names])


def detect_undershooting(
    coverage: DataFrame,
    gis: DataFrame,
    params: Undershoot = Undershoot(),
    environment: DataFrame | None = None,
    by_environment: dict[str, Undershoot] | None = None,
) -> Undershooters:
    """Undershooting cells with an uptilt recommendation, and their interfering bins."""
    require(coverage, "undershooting", *COVERAGE)
    require(gis, "undershooting", "cell_name")
    rows = sanitise(coverage, gis)
    stats = cell_statistics(rows)
    if by_environment is not None:
        limits = environment_table(coverage.sparkSession, by_environment)
        stats = attach_environment(stats, environment).join(limits, "environment")
    candidates = stats.where(F.col("max_distance_m") <= _limit("max_cell_distance", params, by_environment))
    candidates = cut_lineage(candidates)
    bins = cut_lineage(interfering_rows(rows, candidates, params, by_environment))
    candidates = with_interference(candidates, bins).where(
        (F.col("total_traffic") >= _limit("min_cell_event_count", params, by_environment))
        & (F.col("interference_percentage") <= _limit("max_interference_percentage", params, by_environment))
    )
    cells = uptilt_impact(join_inventory(candidates, gis), params, by_environment)
    cells = choose_uptilt(cells, params, by_environment, keep_constrained=by_environment is not None)
    cells = severity(cut_lineage(expansion_metrics(cells)), params)
    extra = ["environment", "intersite_distance_km"] if by_environment is not None else []
    bins = bins.drop(*[c for c in bins.columns if c.startswith("p_")])
    return Undershooters(cells.select(*OUTPUT, *extra), bins)


def compare_modes(standard: DataFrame, by_class: DataFrame, environment: DataFrame) -> DataFrame:
    """Number of undershooters per class in both modes, with difference, change and rate."""
    sizes = environment.groupBy("environment").agg(F.count(F.lit(1)).alias("cells"))
    classes = environment.select("cell_name", "environment")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select("cell_name").join(classes, "cell_name").groupBy("environment").agg(F.count(F.lit(1)).alias(name))

    out = sizes.join(counted(standard, "standard"), "environment", "left").join(
        counted(by_class, "environment_aware"), "environment", "left"
    )
    out = out.fillna(0, ["standard", "environment_aware"])
    total = out.agg(
        F.lit("Total").alias("environment"), *[F.sum(c).alias(c) for c in ("cells", "standard", "environment_aware")]
    )
    change = F.col("environment_aware") - F.col("standard")
    return out.unionByName(total).withColumns({
        "difference": change,
        "pct_change": ratio(change, F.col("standard")) * 100,
        "standard_rate_pct": ratio(F.col("standard"), F.col("cells")) * 100,
        "environment_rate_pct": ratio(F.col("environment_aware"), F.col("cells")) * 100,
    })
