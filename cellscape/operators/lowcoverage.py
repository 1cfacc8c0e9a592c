"""Measured areas where every cell arrives too weak, and what could help."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.functions import antenna, shapes, text
from cellscape.functions.scoring import clip, range_score, severity_category
from cellscape.operators.checks import COVERAGE, require
from cellscape.operators import spans
from cellscape.operators.environment import attach_environment
from cellscape.operators.outline import clip_regions, clip_to_boundary, cluster_bins, drop_slivers, region_outlines, region_summary
from cellscape.operators.ring import ring_totals
from cellscape.operators.spatial import radius_join
from cellscape.params import (
    DEFAULT_ENVIRONMENT,
    LOW_RSRP_DBM,
    LOW_RSRP_DEFAULT_DBM,
    MIN_SAMPLES,
    Advice,
    LowCoverage,
)
from cellscape.session import cut_lineage

KEY = ["band", "ix", "iy"]
CLUSTER = ["band", "cluster_id"]
THIN_DEG, MAX_ASPECT, MIN_OUTLINE_KM2 = 0.015, 5.0, 1.0
# Notes of the advice table.
NEW_SITE, NO_BAND, AT_MINIMUM = "NEW_SITE_REQUIRED", "NO_SAME_BAND_CELLS_IN_RANGE", "PHYSICAL_CONSTRAINT - Cell at 0° tilt"
TOO_LITTLE, MAYBE_SITE = "INSUFFICIENT_GAIN", "NEW_SITE_MAY_BE_REQUIRED"
RISK_HIGH = "HIGH_NEIGHBOR_IMPACT_RISK - verify no pilot pollution"
RISK_MEDIUM = "MODERATE_NEIGHBOR_IMPACT - monitor after implementation"


class LowCoverageFindings(NamedTuple):
    clusters: DataFrame
    bins: DataFrame
    members: DataFrame


def good_rows(coverage: DataFrame, environment: DataFrame | None) -> DataFrame:
    """Rows with a plausible signal and enough events for their class."""
    rows = coverage.where(F.col("avg_rsrp").between(-140, -30))
    rows = attach_environment(rows, environment).drop("intersite_distance_km")
    return rows.where(F.col("event_count") >= text.choose(F.col("environment"), MIN_SAMPLES, F.lit(5)))


def low_rsrp_bins(rows: DataFrame, p: LowCoverage = LowCoverage()) -> DataFrame:
    """Bins whose best signal is at or below the least limit of the cells seen there."""
    classes = ("URBAN", "SUBURBAN", "RURAL")
    env, band = F.col("environment"), F.upper("band")
    limit = F.coalesce(
        *[F.when(env == c, text.choose(band, {b: v[i] for b, v in LOW_RSRP_DBM.items()})) for i, c in enumerate(classes)],
        text.choose(env, LOW_RSRP_DEFAULT_DBM, F.lit(p.rsrp_dbm)),
    )
    best = rows.groupBy(*KEY).agg(F.max("avg_rsrp").alias("best_rsrp"), F.min(limit).alias("rsrp_threshold"))
    return best.where(F.col("best_rsrp") <= F.col("rsrp_threshold"))


def low_rsrp_bins_plain(rows: DataFrame, p: LowCoverage = LowCoverage()) -> DataFrame:
    """Bins with any row at or below one limit."""
    return rows.where(F.col("avg_rsrp") <= p.rsrp_dbm).select(*KEY).distinct()


def dense_low_bins(low: DataFrame, rows: DataFrame, p: LowCoverage = LowCoverage()) -> DataFrame:
    """Low bins whose neighbourhood is mostly weak or unmeasured, with enough evidence."""
    measured = rows.groupBy(*KEY).agg(F.max(F.when(F.col("avg_rsrp") > p.rsrp_dbm, 1).otherwise(0)).cast("long").alias("good"))
    measured = measured.withColumn("measured_neighbors", F.lit(1).cast("long"))
    around = ring_totals(measured, ["band"], ["good", "measured_neighbors"], p.ring)
    size = (2 * p.ring + 1) ** 2
    out = low.join(around, KEY).withColumns({
        "problematic_neighbors": size - F.col("good"),
        "low_rsrp_neighbors": F.col("measured_neighbors") - F.col("good"),
        "no_data_neighbors": size - F.col("measured_neighbors"),
    })
    least_measured = max(p.min_measured, int(size * p.measured_share))
    least_low = max(p.min_evidence, int(p.min_problem_bins * p.evidence_share))
    return out.where(
        (F.col("problematic_neighbors") >= p.min_problem_bins)
        & ((F.col("measured_neighbors") >= least_measured) | (F.col("low_rsrp_neighbors") >= least_low))
    ).drop("good")


def with_confidence(clusters: DataFrame) -> DataFrame:
    """Confidence in a cluster from its mean number of samples per bin."""
    n = F.col("total_samples") / F.col("n_points")
    score = (
        F.when(n >= 20, F.least(0.7 + (n - 20) / 100, F.lit(1.0)))
        .when(n >= 5, 0.4 + (n - 5) / 50)
        .otherwise(F.greatest(n / 12.5, F.lit(0.1)))
    )
    return clusters.withColumns({
        "avg_samples_per_geohash": F.round(n, 1),
        "confidence_score": F.round(score, 3),
        "confidence_category": F.when(n >= 20, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW"),
    })


def listed_cells(members: DataFrame, p: LowCoverage = LowCoverage()) -> DataFrame:
    """The first cells of each cluster by name, for display only."""
    first = Window.partitionBy(*CLUSTER).orderBy("cell_name")
    return members.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= p.listed_cells).drop("_n")


def severity(clusters: DataFrame, members: DataFrame, rows: DataFrame, p: LowCoverage = LowCoverage()) -> DataFrame:
    """Score from area, number of bins, depth below the limit and lack of servers.

    Every band is scaled by its own clusters; a band with one cluster spans from zero to that cluster.
    """
    weak = rows.where(F.col("avg_rsrp") <= p.rsrp_dbm).select("band", "cell_name", "avg_rsrp")
    per_cell = weak.groupBy("band", "cell_name").agg(F.sum("avg_rsrp").alias("_s"), F.count(F.lit(1)).alias("_n"))
    depth = members.join(per_cell, ["band", "cell_name"]).groupBy(*CLUSTER).agg((F.sum("_s") / F.sum("_n")).alias("avg_rsrp_dbm"))
    out = clusters.join(depth, CLUSTER, "left").withColumn("avg_rsrp_dbm", F.coalesce("avg_rsrp_dbm", F.lit(p.rsrp_dbm)))
    out = out.withColumn("rsrp_deficit_db", F.greatest(p.rsrp_dbm - F.col("avg_rsrp_dbm"), F.lit(0.0)))
    spread = clusters.groupBy("band").agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile("n_points", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"),
        F.max("n_points").alias("_top"),
        F.greatest(F.max("n_serving_cells"), F.lit(1)).alias("_most"),
    )
    several = F.col("_n") > 1
    spread = spread.select(
        "band", "_most", F.when(several, F.col("_q")[0]).otherwise(0.0).alias("_low"), F.when(several, F.col("_q")[1]).otherwise(F.col("_top")).alias("_high")
    )
    out = out.join(spread, "band")
    parts = (
        clip(F.col("area_km2") / p.norm_area_km2),
        range_score(F.col("n_points"), F.col("_low"), F.col("_high")),
        clip(F.col("rsrp_deficit_db") / p.norm_deficit_db),
        1.0 - clip(F.col("n_serving_cells") / F.col("_most")),
    )
    out = out.withColumn("severity_score", clip(sum(w * x for w, x in zip(p.weights, parts)))).drop("_low", "_high", "_most")
    return out.withColumn("severity_category", severity_category(F.col("severity_score")))


def detect_low_coverage(
    coverage: DataFrame,
    environment: DataFrame | None = None,
    p: LowCoverage = LowCoverage(),
    boundary: DataFrame | None = None,
    min_outline_km2: float = MIN_OUTLINE_KM2,
) -> LowCoverageFindings:
    """Low-coverage regions per band with servers, samples, confidence and severity."""
    require(coverage, "low coverage", *COVERAGE)
    rows = cut_lineage(good_rows(coverage, environment))
    dense = dense_low_bins(low_rsrp_bins(rows, p), rows, p)
    bins = cut_lineage(
        cluster_bins(cut_lineage(dense), ["band"], p.min_cluster_bins, p.link_bins).drop("n_points").withColumnRenamed("component", "cluster_id")
    )
    served = rows.select(*KEY, "cell_name", "event_count").join(bins, KEY)
    counts = served.groupBy(*CLUSTER).agg(
        F.countDistinct("cell_name").alias("n_serving_cells"), F.sum("event_count").alias("total_samples")
    )
    regions = region_summary(bins, CLUSTER).join(region_outlines(bins, CLUSTER), CLUSTER)
    regions = drop_slivers(regions, max(min_outline_km2, p.min_area_km2), MAX_ASPECT, THIN_DEG)
    regions = regions.where(F.col("area_km2") / F.col("n_points") <= p.max_km2_per_point).join(counts, CLUSTER)
    if boundary is not None:
        regions = clip_regions(regions, bins, CLUSTER, boundary)
    regions = cut_lineage(with_confidence(regions))
    members = cut_lineage(served.select(*CLUSTER, "cell_name").distinct().join(regions.select(*CLUSTER), CLUSTER, "left_semi"))
    names = listed_cells(members, p).groupBy(*CLUSTER).agg(F.array_join(F.array_sort(F.collect_list("cell_name")), ",").alias("serving_cells"))
    clusters = severity(regions, members, rows, p).join(names, CLUSTER, "left")
    return LowCoverageFindings(clusters, bins if boundary is None else clip_to_boundary(bins, boundary), members)


def server_count_distribution(coverage: DataFrame) -> DataFrame:
    """How many bins of a band are served by one cell, two cells and so on."""
    per_bin = coverage.groupBy(*KEY).agg(F.countDistinct("cell_name").alias("n_servers"))
    return per_bin.groupBy("band", "n_servers").agg(F.count(F.lit(1)).alias("bins"))


def single_server_bins(hulls: DataFrame) -> DataFrame:
    """Bins inside exactly one coverage outline of a band, with that cell."""
    return spans.bins_of(single_server_spans(hulls)).select(*KEY, "cell_name")


def single_server_spans(hulls: DataFrame) -> DataFrame:
    """Stretches of bins per band and column, (band, ix, lo, hi, cell_name), inside the outline of one cell only."""
    covered = spans.cover_spans(shapes.with_shape(hulls).select("band", "cell_name", "shape"), ["band", "cell_name"])
    return spans.sole_owner(covered, ["band"], "cell_name")


def _by_class(env: Column, table: tuple) -> Column:
    values = dict(table)
    return text.choose(env, values, F.lit(values[DEFAULT_ENVIRONMENT]))


def cluster_environment(members: DataFrame, environment: DataFrame | None) -> DataFrame:
    """Most frequent class among the cells of a cluster."""
    rows = attach_environment(members, environment)
    counts = rows.groupBy(*CLUSTER, "environment").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*CLUSTER).agg(F.max_by("environment", F.struct("_n", "environment")).alias("environment"))


def impact_risk(candidates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Risk of tilting a cell up, from how far and how strongly it serves already."""
    served = coverage.select("cell_name", "distance_to_cell", "avg_rsrp").join(
        candidates.select(*CLUSTER, "cell_name", "distance_m"), "cell_name"
    )
    far = F.col("distance_to_cell") >= F.col("distance_m") * 0.7
    facts = served.groupBy(*CLUSTER, "cell_name").agg(
        F.max("distance_to_cell").alias("_max"),
        F.avg(F.when(far, 1.0).otherwise(0.0)).alias("_far"),
        F.avg(F.when(far, F.col("avg_rsrp"))).alias("_rsrp"),
    )
    out = candidates.join(facts, [*CLUSTER, "cell_name"], "left")
    level = F.coalesce("_rsrp", F.lit(-120.0))
    reach = F.when(F.col("_max") > F.col("distance_m") * 1.2, 2).when(F.col("_max") > F.col("distance_m"), 1).otherwise(0)
    field = (
        F.when((F.col("_far") > 0.20) & (level > -110), 2).when((F.col("_far") > 0.10) & (level > -115), 1).otherwise(0)
    )
    score = reach + field + F.when(F.col("current_tilt_deg") < 4, 1).otherwise(0)
    risk = F.when(F.col("_max").isNull(), "LOW").when(score >= 4, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW")
    return out.withColumn("neighbor_impact_risk", F.when(F.col("current_tilt_deg") <= 0, "N/A").otherwise(risk)).drop("_max", "_far", "_rsrp")


def recommend(
    found: LowCoverageFindings,
    gis: DataFrame,
    coverage: DataFrame,
    environment: DataFrame | None = None,
    p: Advice = Advice(),
) -> DataFrame:
    """Up to three uptilt candidates per cluster, or a note that a new site is needed."""
    classes = cluster_environment(found.members, environment)
    clusters = found.clusters.select(*CLUSTER, "centroid_lat", "centroid_lon", "rsrp_deficit_db").join(classes, CLUSTER, "left")
    clusters = clusters.withColumn("environment", F.coalesce("environment", F.lit(DEFAULT_ENVIRONMENT)))
    clusters = cut_lineage(clusters.withColumn("_radius", _by_class(F.col("environment"), p.radius_m)))
    left = clusters.select(*CLUSTER, "environment", "_radius", "rsrp_deficit_db", F.col("centroid_lat").alias("llat"), F.col("centroid_lon").alias("llon"))
    right = gis.select(
        "cell_name", F.col("band").alias("_cband"), "tilt_mech", "tilt_elc", "antenna_height",
        F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"),
    )
    near = radius_join(left, right, max(r for _, r in p.radius_m)).where(F.col("distance_m") <= F.col("_radius"))
    near = cut_lineage(near)
    in_range = near.select(*CLUSTER).distinct().withColumn("_any", F.lit(True))
    tilt = F.coalesce("tilt_mech", F.lit(0.0)) + F.coalesce("tilt_elc", F.lit(0.0))
    height = F.coalesce(F.when(F.col("antenna_height") != 0, F.col("antenna_height")), F.lit(p.antenna_height_m))
    own_band = text.normalise_band(F.col("_cband"), keep_nr=True)
    same = near.where((F.coalesce("_cband", F.lit("")) == "") | (own_band == F.col("band"))).withColumn("current_tilt_deg", tilt)

    def gain(n: int) -> Column:
        value = F.greatest(-antenna.attenuation_change(F.col("distance_m"), F.col("current_tilt_deg"), height, -float(n)), F.lit(0.0))
        return F.when((F.col("current_tilt_deg") <= 0) | (F.col("distance_m") <= 0) | (height <= 0), 0.0).otherwise(value)

    same = same.withColumns({"_g1": gain(1), "_g2": gain(2)})
    best_first = Window.partitionBy(*CLUSTER).orderBy(F.desc(F.greatest("_g1", "_g2")), "cell_name")
    top = same.withColumn("_n", F.row_number().over(best_first)).where(F.col("_n") <= p.max_cells)
    top = impact_risk(cut_lineage(top), coverage)
    stuck = F.col("current_tilt_deg") <= 0
    two, one = F.col("_g2") >= p.min_gain_db, F.col("_g1") >= p.min_gain_db
    expected = F.when(stuck, 0.0).when(two, F.col("_g2")).when(one, F.col("_g1")).otherwise(F.greatest("_g1", "_g2"))
    deficit = F.col("rsrp_deficit_db")
    confidence = F.when(expected >= deficit, "HIGH").when(expected >= deficit * 0.5, "MEDIUM").otherwise("LOW")
    weak = ~stuck & ~two & ~one
    note = (
        F.when((F.col("_n") == 1) & (expected < deficit - p.new_site_margin_db), MAYBE_SITE)
        .when(stuck, AT_MINIMUM)
        .when(weak, TOO_LITTLE)
        .when(F.col("neighbor_impact_risk") == "HIGH", RISK_HIGH)
        .when(F.col("neighbor_impact_risk") == "MEDIUM", RISK_MEDIUM)
    )
    advice = top.select(
        *CLUSTER,
        F.col("cell_name").alias("recommended_cell"),
        "current_tilt_deg",
        F.when(stuck | weak, 0).when(two, 2).otherwise(1).alias("recommended_uptilt_deg"),
        F.round(expected, 1).alias("expected_rsrp_gain_db"),
        F.round("distance_m", 0).alias("distance_to_cluster_m"),
        F.when(stuck, "N/A").when(weak, "LOW").otherwise(confidence).alias("confidence"),
        note.alias("note"),
        "neighbor_impact_risk",
    )
    out = clusters.select(*CLUSTER).join(in_range, CLUSTER, "left").join(advice, CLUSTER, "left")
    empty = F.col("recommended_cell").isNull()
    return out.withColumns({
        "note": F.when(F.col("_any").isNull(), NEW_SITE).when(empty, NO_BAND).otherwise(F.col("note")),
        "confidence": F.coalesce("confidence", F.lit("N/A")),
        "expected_rsrp_gain_db": F.coalesce("expected_rsrp_gain_db", F.lit(0.0)),
    }).drop("_any")
