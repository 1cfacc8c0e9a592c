"""Antenna feeders that look swapped, from where a cell's handovers point."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.functions import geo, text
from cellscape.functions.scoring import ratio, severity_category
from cellscape.operators.checks import RELATIONS, require
from cellscape.operators.quantile import group_quantiles
from cellscape.params import BAND_RADIUS_KM, Feeders
from cellscape.session import cut_lineage

# Base score by confidence, share bonus, order and notes of the site summary.
CONFIDENCE_SCORE = {"HIGH_POTENTIAL_SWAP": 0.90, "POSSIBLE_SWAP": 0.70, "SINGLE_ANOMALY": 0.50, "REPAN": 0.30, "NONE": 0.0}
SHARE_BONUS = 0.10
DEFAULT_RADIUS_KM = 30.0
SITE_BAND = ["site", "band"]


class FeederFindings(NamedTuple):
    cells: DataFrame
    pairs: DataFrame
    sites: DataFrame


def relation_geometry(relations: DataFrame, gis: DataFrame, p: Feeders = Feeders()) -> DataFrame:
    """Usable relations with the angle to the neighbour and whether it lies in the beam."""
    near = gis.select("cell_name", "site", "bearing", "hbw", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    far = gis.select(F.col("cell_name").alias("to_cell_name"), F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon"))
    same = text.technology(F.col("band")) == text.technology(F.col("to_band"))
    kept = relations.where(same & (text.yes_no(F.col("intra_site")) == "n")).select(
        "cell_name", "to_cell_name", "band", F.coalesce("distance", F.lit(0.0)).alias("distance"),
        F.greatest(F.coalesce(F.col(p.strength).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"),
    )
    rows = kept.join(near, "cell_name").join(far, "to_cell_name").dropna(
        subset=["bearing", "hbw", "lat", "lon", "to_lat", "to_lon"]
    )
    radius = text.choose(F.upper("band"), BAND_RADIUS_KM, F.lit(DEFAULT_RADIUS_KM)) * 1000
    rows = rows.where(
        F.col("hbw").between(*p.hbw_range) & (F.col("distance") >= p.min_distance_m) & (F.col("distance") <= radius)
    )
    rows = rows.withColumn("bearing", F.round(geo.wrap360(F.col("bearing")), 6)).withColumns({
        "angle_to_neighbor": geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")),
        "half_width": F.least(F.col("hbw") * p.hbw_factor, F.lit(p.hbw_cap)),
    })
    rows = rows.withColumn("angle_diff", geo.angle_diff(F.col("bearing"), F.col("angle_to_neighbor")))
    return rows.withColumn("in_beam", F.col("angle_diff") <= F.col("half_width"))


def cell_metrics(geometry: DataFrame, gis: DataFrame, p: Feeders = Feeders()) -> DataFrame:
    """Weight in and out of the beam per cell, and the main direction of the latter."""
    out = ~F.col("in_beam")
    outside = F.when(out, F.col("weight")).otherwise(0.0)
    sin_w, cos_w = geo.circular_mean_terms(F.col("angle_to_neighbor"), outside)
    sums = geometry.groupBy("cell_name").agg(
        F.sum("weight").alias("total_weight"),
        F.sum(F.when(F.col("in_beam"), F.col("weight")).otherwise(0.0)).alias("in_beam_weight"),
        F.sum(outside).alias("out_of_beam_weight"),
        F.count(F.lit(1)).alias("total_relations"),
        F.sum(F.when(out, 1).otherwise(0)).alias("out_of_beam_relations"),
        geo.circular_mean(F.sum(sin_w), F.sum(cos_w), F.sum(outside)).alias("dominant_traffic_direction"),
    )
    strongest = Window.partitionBy("cell_name").orderBy(F.desc("weight"), "to_cell_name")
    label = F.format_string(
        "%s (d=%dm, w=%.1f, angle=%.0f°)",
        "to_cell_name", F.floor("distance").cast("long"), "weight", "angle_to_neighbor",
    )
    top = (
        geometry.where(out)
        .withColumn("_n", F.row_number().over(strongest))
        .where(F.col("_n") <= p.listed)
        .groupBy("cell_name")
        .agg(F.array_sort(F.collect_list(F.struct("_n", label.alias("t")))).alias("_l"))
        .select("cell_name", F.array_join(F.col("_l.t"), " | ").alias("top_suspicious_relations"))
    )
    cells = gis.select("cell_name", "site", "band", "bearing", "hbw", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    merged = sums.join(top, "cell_name", "left").join(cells, "cell_name", "left")
    return merged.withColumns({
        "out_of_beam_ratio": ratio(F.col("out_of_beam_weight"), F.col("total_weight")),
        "top_suspicious_relations": F.coalesce("top_suspicious_relations", F.lit("")),
    })


def swap_pairs(metrics: DataFrame, p: Feeders = Feeders()) -> DataFrame:
    """Cells of a site and band whose out-of-beam traffic points along each other's azimuth.

    The match is on direction, so cells meet by direction sector: the sector of one cell's
    traffic and the sectors its tolerance can reach for the other's azimuth.
    """
    candidates = metrics.where(
        (F.col("out_of_beam_ratio") >= p.swap_ratio)
        & (F.col("total_relations") >= p.swap_relations)
        & (F.col("out_of_beam_relations") >= p.swap_out)
        & F.col("dominant_traffic_direction").isNotNull()
    )
    width = p.swap_angle

    def sector(angle: Column) -> Column:
        return F.floor(geo.wrap360(angle) / width)

    sectors = int(-(-360 // width))

    def around(angle: Column) -> Column:
        s = sector(angle)
        return F.array_distinct(F.array(*[F.pmod(s + d, F.lit(sectors)) for d in (-1, 0, 1)], *([F.pmod(s - 2, F.lit(sectors))] if 360 % width else [])))

    def side(tag: str) -> DataFrame:
        return candidates.select(
            *SITE_BAND,
            F.col("cell_name").alias(f"cell_{tag}"),
            F.col("bearing").alias(f"cell_{tag}_azimuth"),
            F.col("dominant_traffic_direction").alias(f"cell_{tag}_traffic_dir"),
        )

    a = side("a").withColumn("_s", F.explode(around(F.col("cell_a_traffic_dir")))).withColumn("_t", sector(F.col("cell_a_azimuth")))
    b = side("b").withColumn("_s", sector(F.col("cell_b_azimuth"))).withColumn("_t", F.explode(around(F.col("cell_b_traffic_dir"))))
    pairs = a.join(b, [*SITE_BAND, "_s", "_t"]).where(F.col("cell_a") < F.col("cell_b")).drop("_s", "_t")
    pairs = pairs.withColumns({
        "a_to_b_angle_diff": geo.angle_diff(F.col("cell_a_traffic_dir"), F.col("cell_b_azimuth")),
        "b_to_a_angle_diff": geo.angle_diff(F.col("cell_b_traffic_dir"), F.col("cell_a_azimuth")),
    })
    return pairs.where((F.col("a_to_b_angle_diff") <= p.swap_angle) & (F.col("b_to_a_angle_diff") <= p.swap_angle))


def grade_cells(metrics: DataFrame, pairs: DataFrame, gis: DataFrame, p: Feeders = Feeders()) -> DataFrame:
    """Confidence, swap partner, note and severity of every cell with relations.

    The partner is the last of the cell's pairs in name order.
    """
    partners = pairs.select(F.col("cell_a").alias("cell_name"), F.struct("cell_a", "cell_b", F.col("cell_b").alias("p")).alias("_o")).unionByName(
        pairs.select(F.col("cell_b").alias("cell_name"), F.struct("cell_a", "cell_b", F.col("cell_a").alias("p")).alias("_o"))
    )
    partners = partners.groupBy("cell_name").agg(F.max("_o").alias("_o")).select("cell_name", F.col("_o.p").alias("swap_partner"))
    odd = (
        (F.col("out_of_beam_ratio") >= p.anomaly_ratio)
        & (F.col("out_of_beam_weight") >= p.anomaly_weight)
        & (F.col("total_relations") >= p.anomaly_relations)
        & (F.col("out_of_beam_relations") >= p.anomaly_out)
    )
    rows = metrics.withColumn("_odd", odd)
    group = rows.groupBy(*SITE_BAND).agg(F.sum(F.when(F.col("_odd"), 1).otherwise(0)).alias("_n_odd"))
    on_band = gis.groupBy(*SITE_BAND).agg(F.count(F.lit(1)).alias("_n_band"))
    rows = rows.join(group, SITE_BAND).join(on_band, SITE_BAND, "left").join(partners, "cell_name", "left")
    alone = F.col("_n_band") == 1
    level = (
        F.when(alone & F.col("_odd"), "REPAN")
        .when(alone, "NONE")
        .when(F.col("swap_partner").isNotNull(), "HIGH_POTENTIAL_SWAP")
        .when(F.col("_odd") & (F.col("_n_odd") >= 2), "POSSIBLE_SWAP")
        .when(F.col("_odd"), "SINGLE_ANOMALY")
        .otherwise("NONE")
    )
    rows = rows.withColumn("confidence_level", level)
    note = (
        F.when(level == "REPAN", "Out-of-beam traffic on the only cell of the band: review azimuth")
        .when(level == "HIGH_POTENTIAL_SWAP", F.concat(F.lit("Reciprocal swap pattern with "), "swap_partner"))
        .when(level == "POSSIBLE_SWAP", F.concat(F.lit("Out-of-beam traffic, anomalous cells on site: "), F.col("_n_odd").cast("string")))
        .when(level == "SINGLE_ANOMALY", "Out-of-beam traffic on one cell: review azimuth or terrain")
        .otherwise("No out-of-beam anomaly")
    )
    bonus = F.least(F.col("out_of_beam_ratio") * SHARE_BONUS, F.lit(SHARE_BONUS))
    score = F.round(F.least(text.choose(F.col("confidence_level"), CONFIDENCE_SCORE) + bonus, F.lit(1.0)), 4)
    rows = rows.withColumns({"recommendation": note, "severity_score": score})
    rows = rows.withColumn("severity_category", severity_category(F.col("severity_score")))
    return rows.drop("_odd", "_n_odd", "_n_band")


def site_summary(cells: DataFrame) -> DataFrame:
    """Findings per site and band, worst first."""

    def count_of(*levels: str) -> Column:
        return F.sum(F.when(F.col("confidence_level").isin(*levels), 1).otherwise(0))

    out = cells.groupBy(*SITE_BAND).agg(
        F.count(F.lit(1)).alias("total_cells"),
        count_of("HIGH_POTENTIAL_SWAP").alias("high_confidence"),
        count_of("POSSIBLE_SWAP", "SINGLE_ANOMALY").alias("medium_confidence"),
        count_of("REPAN").alias("low_confidence"),
        F.round(F.max("severity_score"), 4).alias("severity_score"),
    )
    order = [("HIGH", F.col("high_confidence") > 0), ("MEDIUM", F.col("medium_confidence") > 0), ("LOW", F.col("low_confidence") > 0)]
    category = F.lit("MINIMAL")
    for name, test in reversed(order):
        category = F.when(test, name).otherwise(category)
    label = (
        F.when(F.col("high_confidence") > 0, F.format_string("CROSSED FEEDER: %d swap pair(s) detected", "high_confidence"))
        .when(F.col("medium_confidence") > 0, F.format_string("POSSIBLE ISSUE: %d cells with out-of-beam anomalies", "medium_confidence"))
        .when(F.col("low_confidence") > 0, F.format_string("AZIMUTH REVIEW: %d cell(s) may need azimuth adjustment", "low_confidence"))
        .otherwise("No issues detected")
    )
    return out.withColumns({"severity_category": category, "classification": label})


def detect_crossed_feeders(relations: DataFrame, gis: DataFrame, p: Feeders = Feeders()) -> FeederFindings:
    require(relations, "crossed feeders", *RELATIONS)
    require(gis, "crossed feeders", "cell_name", "bearing", "latitude", "longitude")
    metrics = cut_lineage(cell_metrics(relation_geometry(relations, gis, p), gis, p))
    pairs = cut_lineage(swap_pairs(metrics, p))
    cells = cut_lineage(grade_cells(metrics, pairs, gis, p))
    return FeederFindings(cells, pairs, site_summary(cells))


def feeders_from_bins(coverage: DataFrame, min_deviation_deg: float = 90.0) -> DataFrame:
    """Share of a cell's events in bins behind its azimuth."""
    behind = coverage.where(F.col("grid_bearing_diff") >= min_deviation_deg)
    out = behind.groupBy("cell_name").agg(F.sum("perc_cell_events").alias("behind_share"))
    return out


# Fixed values of the scored variant.
SCORE_MIN_M, SCORE_MAX_HBW, SCORE_HALF_WIDTH, SCORE_QUANTILE = 1000.0, 180.0, 60.0, 0.95


def scored_feeders(impacts: DataFrame) -> DataFrame:
    """Top cells by share x distance x angle of relations outside the beam, classed per site and band.

    ``impacts`` carries hbw, distance, max_neigh_distance, angle_cell_to_impact, cell_azimuth_diff
    and relation_impact_pct per relation.
    """
    half = F.least("cell_hbw", F.lit(SCORE_HALF_WIDTH))
    void = (
        (F.col("cell_hbw") >= SCORE_MAX_HBW)
        | (F.col("distance") < SCORE_MIN_M)
        | (F.coalesce("max_neigh_distance", F.lit(0.0)) < SCORE_MIN_M)
        | F.col("cell_azimuth_diff").isNull()
        | (F.col("cell_azimuth_diff") <= half)
    )
    value = F.col("relation_impact_pct") * F.least(F.col("distance") / F.col("max_neigh_distance"), F.lit(1.0)) * F.col("cell_azimuth_diff") / 180
    rows = impacts.withColumn("_s", F.when(void, 0.0).otherwise(value))
    cells = cut_lineage(
        rows.groupBy("cell_site", "cell_name", "cell_band").agg(
            F.sum("_s").alias("score"), F.sum(F.when(F.col("_s") > 0, 1).otherwise(0)).alias("scored_impacts")
        )
    )
    limit = group_quantiles(cells, [], "score", {"q": SCORE_QUANTILE}, 0.5, bounded=True).agg(F.max("q"))
    top = cells.where(F.round("score", 6) >= F.round(limit.scalar(), 6))
    counts = top.groupBy("cell_site", "cell_band").agg(F.count(F.lit(1)).alias("cell_occurrences"))
    sites = top.groupBy("cell_site").agg(F.sum("score").alias("site_score"))
    label = (
        F.when(F.col("cell_occurrences") >= 3, "High potential: All feeders swapped")
        .when(F.col("cell_occurrences") == 2, "High potential: 2 feeders swapped")
        .otherwise("Low potential: 1 feeder with high swapped score")
    )
    out = top.join(counts, ["cell_site", "cell_band"]).join(sites, "cell_site")
    return out.withColumns({"site_band": F.concat_ws("_", "cell_site", "cell_band"), "classification": label})


def co_sector_feeders(impacts: DataFrame, min_share: float = 10.0, max_diff: float = -10.0) -> DataFrame:
    """Cells whose other-band handovers on the site favour another sector over their own."""
    on_site = impacts.where((F.col("cell_site") == F.col("impact_site")) & (F.col("cell_band") != F.col("impact_band")))
    same = F.round("cell_bearing") == F.round("impact_bearing")
    own = on_site.where(same).select(
        "cell_site", "cell_name", "cell_band", "impact_band",
        F.col("to_cell_name").alias("co_sectored_impact_cell"), F.col("relation_impact_pct").alias("co_pct"),
    )
    other = on_site.where(~same).select(
        "cell_name", "impact_band", F.col("to_cell_name").alias("non_co_sectored_impact_cell"),
        F.col("relation_impact_pct").alias("non_co_pct"),
    )
    rows = own.join(other, ["cell_name", "impact_band"], "right")
    rows = rows.withColumn("diff", 100 * ratio(F.col("co_pct") - F.col("non_co_pct"), F.col("co_pct") + F.col("non_co_pct")))
    rows = rows.where(F.col("co_pct").isNotNull()).where(
        ((F.col("co_pct") > min_share) | (F.col("non_co_pct") > min_share)) & (F.col("diff") < max_diff)
    )
    group = ["cell_site", "cell_band", "impact_band"]
    totals = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("cell_count"), F.sum("diff").alias("combined_diff"))
    return rows.join(totals.where(F.col("cell_count") > 1), group)
