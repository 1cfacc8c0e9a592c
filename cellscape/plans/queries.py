"""Every operator as a named query over the star-schema test tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellscape.sources import bench_tables as tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """Round every double column, so results do not depend on summation order.

    ``nudge`` moves values off exact rounding ties, which means of decimal data often hit.
    """
    return df.select(*[
        F.round(F.col(f"`{n}`") + nudge, digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes
    ])


@query
def gis_adapter(spark, sf):
    return tables.cell_gis(spark, sf)


@query
def coverage_adapter(spark, sf):
    return rounded(tables.coverage(spark, sf), 6)


@query
def relations_adapter(spark, sf):
    return tables.relations(spark, sf)


# --- lattice and geometry functions -------------------------------------------------

from cellscape.functions import antenna, geo, lattice, rings, scoring, shapes, text  # noqa: E402
from cellscape.operators import enrich, impacts  # noqa: E402


@query
def geohash_encode(spark, sf):
    bins = tables.coverage(spark, sf).select("ix", "iy").distinct()
    code = lattice.encode(F.col("ix"), F.col("iy"))
    back = lattice.decode(F.col("grid"))
    out = bins.withColumn("grid", code).withColumn("_b", back)
    return out.select("ix", "iy", "grid", F.col("_b.ix").alias("back_ix"), F.col("_b.iy").alias("back_iy"))


@query
def geohash_bounds(spark, sf):
    bins = tables.coverage(spark, sf).select("ix", "iy").distinct()
    out = bins.withColumn("_b", lattice.bounds(F.col("ix"), F.col("iy")))
    return rounded(out.select("ix", "iy", "_b.min_lat", "_b.max_lat", "_b.min_lon", "_b.max_lon"), 8)


@query
def geohash_neighbours(spark, sf):
    from cellscape.operators.ring import expand_ring

    bins = tables.coverage(spark, sf).select("ix", "iy").distinct()
    around = expand_ring(bins, 1, include_self=False)
    return around.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.sum("nx").alias("sx"), F.sum("ny").alias("sy"))


def _ends(spark, sf):
    gis = tables.cell_gis(spark, sf)
    keep = ["cell_name", "latitude", "longitude", "bearing", "hbw"]
    near = gis.select(*keep).toDF("cell_name", "lat", "lon", "bearing", "hbw")
    far = gis.select(*keep[:3]).toDF("to_cell_name", "to_lat", "to_lon")
    return tables.relations(spark, sf).select("cell_name", "to_cell_name").join(near, "cell_name").join(far, "to_cell_name")


@query
def haversine_bearing(spark, sf):
    pair = geo.distance_and_bearing(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    out = _ends(spark, sf).withColumn("_p", pair).select("cell_name", "to_cell_name", "_p.distance_m", "_p.bearing_deg")
    return rounded(out, 4)


@query
def sector_flag(spark, sf):
    b = F.round(geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")), 4)
    return _ends(spark, sf).select(
        "cell_name", "to_cell_name", geo.in_sector(b, F.col("bearing"), F.col("hbw")).alias("inside")
    )


@query
def sector_polygon(spark, sf):
    gis = tables.cell_gis(spark, sf)
    ring = geo.sector_ring(F.col("latitude"), F.col("longitude"), F.col("bearing"), F.col("hbw"), 500.0)
    box = rings.ring_bounds(F.col("ring"))
    out = gis.withColumn("ring", ring).select("cell_name", F.size("ring").cast("long").alias("n_points"), box.alias("b"))
    return rounded(out.select("cell_name", "n_points", "b.min_lon", "b.max_lon", "b.min_lat", "b.max_lat"), 6)


@query
def destination_point(spark, sf):
    gis = tables.cell_gis(spark, sf)
    p = geo.destination(F.col("latitude"), F.col("longitude"), F.col("bearing"), F.lit(1000.0) + F.col("cell_key"))
    return rounded(gis.select("cell_name", p["lon"].alias("lon"), p["lat"].alias("lat")), 7)


@query
def name_normalisers(spark, sf):
    gis = tables.cell_gis(spark, sf)
    parts = text.site_and_sector(F.col("cell_name"), r"^(S\d+)[A-Z](\d)$")
    return gis.select(
        "cell_name",
        text.normalise_band(F.concat(F.lit(" "), F.substring("band", 2, 9), F.lit(".0"))).alias("band_norm"),
        text.normalise_band(F.lit("n78"), keep_nr=True).alias("nr_norm"),
        text.technology(F.col("band")).alias("technology"),
        text.site_from_cell(F.col("cell_name")).alias("site_by_suffix"),
        text.site_from_cell(F.col("cell_name"), 5).alias("site_by_prefix"),
        parts["site"].alias("site"),
        parts["sector"].alias("sector"),
        text.band_from_cell(F.col("cell_name")).alias("band_from_name"),
        text.yes_no(F.when(F.col("pci") % 2 == 0, " Yes").otherwise("0")).alias("flag"),
        text.neighbour_relation(F.when(F.col("pci") % 3 == 0, "no").when(F.col("pci") % 3 == 1, "1")).alias("relation"),
        text.pci_in_range(F.col("pci") * 40, F.col("band")).alias("pci_ok"),
    )


# --- enrichment ----------------------------------------------------------------------


def _samples(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.select(
        F.expr(f"cast({tables.IX0} + l_partkey % 50 as int)").alias("ix"),
        F.expr(f"cast({tables.IY0} + l_partkey div 50 as int)").alias("iy"),
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("cell_name"),
        (-70.0 - 400.0 * F.col("l_discount")).alias("avg_rsrp"),
        (-5.0 - 100.0 * F.col("l_tax")).alias("avg_rsrq"),
        F.col("l_quantity").alias("event_count"),
    )


@query
def bin_aggregate(spark, sf):
    return rounded(enrich.weighted_bins(_samples(spark, sf)))


def _long_kpis(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    names = F.array(*[F.lit(n) for n in enrich.KPI_NAMES], F.lit("RRC_Other_A"), F.lit("RRC_Other_B"))
    return lines.select(
        F.concat(F.lit("C"), (F.col("l_suppkey") % 50).cast("string")).alias("cell_name"),
        F.concat(F.lit("G"), (F.col("l_partkey") % 40).cast("string")).alias("grid"),
        F.get(names, ((F.col("l_orderkey") + F.col("l_linenumber")) % 14).cast("int")).alias("kqi_name"),
        F.col("l_quantity").alias("value"),
    )


@query
def kpi_pivot(spark, sf):
    return rounded(enrich.kpi_ratios(enrich.pivot_kpis(_long_kpis(spark, sf))))


@query
def grid_cell_totals(spark, sf):
    kept = ["ix", "iy", "cell_name", "event_count", "avg_rsrp", "avg_rsrq", "avg_sinr"]
    return rounded(enrich.bin_and_cell_totals(tables.coverage(spark, sf).select(*kept)), 6, nudge=1e-9)


@query
def located_bins(spark, sf):
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name", "latitude", "longitude")
    return rounded(enrich.locate(cov, tables.cell_gis(spark, sf)), 4)


@query
def distance_metrics(spark, sf):
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name", "distance_to_cell")
    by_cell = enrich.distance_metrics(cov)
    return rounded(by_cell, 6)


@query
def rsrp_share(spark, sf):
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name", "avg_rsrp")
    return rounded(enrich.rsrp_share(cov), 3, nudge=1e-9)


@query
def dominance_tiers(spark, sf):
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name", "event_count", "distance_to_cell", "avg_rsrp", "avg_rsrq", "avg_sinr")
    both = enrich.distance_metrics(enrich.bin_and_cell_totals(cov))
    return enrich.dominance_tiers(both).select("ix", "iy", "cell_name", "dominance", "tier")


@query
def same_pci_count(spark, sf):
    pci = tables.cell_gis(spark, sf).select("cell_name", "pci")
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name").join(pci, "cell_name")
    return enrich.cell_counts(cov)


@query
def clamp_metrics(spark, sf):
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name", "avg_rsrp", "avg_rsrq", "avg_sinr", "distance_to_cell")
    wide = cov.withColumns({"avg_rsrp": F.col("avg_rsrp") * 1.5, "avg_rsrq": -F.col("avg_rsrq") * 2, "avg_sinr": F.col("avg_sinr") * 3})
    return rounded(enrich.clamp_metrics(wide))


@query
def tilt_distance_metrics(spark, sf):
    return rounded(enrich.tilt_distance_metrics(tables.coverage(spark, sf), tables.cell_gis(spark, sf)))


@query
def tilt_rsrp_scenarios(spark, sf):
    cov = tables.coverage(spark, sf)
    metrics = enrich.tilt_distance_metrics(cov, tables.cell_gis(spark, sf))
    kept = cov.select("ix", "iy", "cell_name", "band", "avg_rsrp", "event_count", "distance_to_cell")
    out = enrich.tilt_rsrp_scenarios(kept, metrics)
    return rounded(out.select("ix", "iy", "cell_name", *enrich.SCENARIO_COLUMNS.values()))


@query
def tilt_scenario_tables(spark, sf):
    cov = tables.coverage(spark, sf)
    metrics = enrich.tilt_distance_metrics(cov, tables.cell_gis(spark, sf))
    stacked = enrich.scenario_tables(enrich.tilt_rsrp_scenarios(cov, metrics))
    return rounded(stacked.groupBy("scenario", "cell_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("avg_rsrp").alias("mean_rsrp"), F.max("distance_to_cell").alias("reach")
    ), 3)


def _with_holes(spark, sf):
    cov = tables.coverage(spark, sf)
    keep = (F.col("cell_key") + F.col("ix") + F.col("iy")) % 5 != 0
    return cov.select(
        "ix", "iy", "cell_name", "latitude", "longitude", F.when(keep, F.col("avg_rsrp")).alias("avg_rsrp")
    )


@query
def rsrp_idw_fill(spark, sf):
    out = enrich.fill_rsrp_same_cell(_with_holes(spark, sf), tables.cell_gis(spark, sf))
    return rounded(out.drop("latitude", "longitude"), 3)


@query
def rsrp_model_fill(spark, sf):
    out = enrich.fill_rsrp_across_cells(_with_holes(spark, sf), tables.cell_gis(spark, sf))
    return rounded(out.drop("latitude", "longitude"), 3)


# --- relation enrichment -------------------------------------------------------------


def _impacts(spark, sf):
    gis = tables.cell_gis(spark, sf).withColumn("tech", F.when(F.col("cell_key") % 3 == 0, "nsa").otherwise("lte"))
    return impacts.relation_shares(impacts.enrich_impacts(tables.relations(spark, sf), gis))


@query
def impact_enriched(spark, sf):
    return rounded(_impacts(spark, sf).select(
        "cell_name", "to_cell_name", "co_site", "co_sectored", "tech_band", "impact_tech_band", "traffic_data",
        "total_cell_traffic_data", "relation_impact_pct",
    ))


@query
def impact_tech_shares(spark, sf):
    return rounded(impacts.technology_shares(_impacts(spark, sf), ["lte_L800", "nsa_L1800"]))


@query
def neighbour_distances(spark, sf):
    out = impacts.neighbour_distances(_impacts(spark, sf))
    return rounded(out.select(
        "cell_name", "to_cell_name", "distance", "angle_cell_to_impact", "angle_impact_to_cell", "cell_azimuth_diff",
        "impact_azimuth_diff", "max_neigh_distance", "median_neigh_distance",
    ), 3)


@query
def site_tech_bands(spark, sf):
    gis = tables.cell_gis(spark, sf).withColumn("tech", F.when(F.col("cell_key") % 3 == 0, "nsa").otherwise("lte"))
    return impacts.site_tech_bands(gis).select("site", F.array_join("tech_bands", ",").alias("tech_bands"))


# --- environment, competition, over- and undershooting ---------------------------------

from dataclasses import replace  # noqa: E402

from cellscape import params as P  # noqa: E402
from cellscape.operators import competition, environment, overshoot, undershoot  # noqa: E402

# The derived tables are smaller and flatter than a live network, so limits are loosened.
OVER = P.Overshoot(min_cell_count_in_grid=2, min_overshooting_grids=5, percentage_overshooting_grids=0.02, min_relative_reach=0.5)
OVER_ENV = {
    env: replace(p, min_cell_count_in_grid=n, min_overshooting_grids=5, percentage_overshooting_grids=0.02, min_cell_distance=d)
    for (env, p), n, d in zip(P.OVERSHOOT_BY_ENVIRONMENT.items(), (3, 2, 2), (1500.0, 3500.0, 4000.0))
}
ENV_RULES = P.EnvironmentRules(urban_km=1.25, suburban_km=1.4)
UNDER = P.Undershoot(max_cell_grid_count=3, max_interference_percentage=0.9)
UNDER_ENV = {
    env: replace(p, max_interference_percentage=0.9, max_cell_distance=d)
    for (env, p), d in zip(P.UNDERSHOOT_BY_ENVIRONMENT.items(), (6500.0, 7000.0, 12000.0))
}


@query
def site_environment(spark, sf):
    out = environment.classify_environment(tables.cell_gis(spark, sf))
    return rounded(out.select("cell_name", "intersite_distance_km", "environment"))


@query
def competition_counts(spark, sf):
    cov = tables.coverage(spark, sf)
    rows = competition.with_reference_level(cov, cov, 0.9)
    level = rows.groupBy(*competition.BIN_BAND).agg(F.max("p90_rsrp_in_grid").alias("p90"))
    return rounded(competition.competition_counts(rows, 7.5).join(level, competition.BIN_BAND))


def _ranged(spark, sf):
    cov, gis = overshoot.sanitise(tables.coverage(spark, sf), tables.cell_gis(spark, sf), OVER)
    return overshoot.with_distance(cov, gis)


@query
def edge_bins(spark, sf):
    out = overshoot.edge_bins(_ranged(spark, sf), None, OVER)
    return rounded(out.select("ix", "iy", "cell_name", "distance_m", "edge_distance_m"))


@query
def cell_metrics(spark, sf):
    rows = _ranged(spark, sf)
    out = overshoot.cell_metrics(rows, overshoot.edge_bins(rows, None, OVER), OVER)
    return rounded(out, 3, nudge=1e-9)


@query
def overshoot_bins(spark, sf):
    out = overshoot.detect_overshooting(tables.coverage(spark, sf), tables.cell_gis(spark, sf), OVER)
    return rounded(out.bins.select(
        "ix", "iy", "cell_name", "competing_cells", "grid_total_traffic", "cell_traffic_pct", "relative_reach", "p90_rsrp_in_grid"
    ))


def _over_output(cells):
    return rounded(cells.select(
        "cell_name", "max_distance_m", "total_grids", "cell_max_rsrp", "edge_grids", "avg_edge_rsrp", "overshooting_grids",
        "percentage_overshooting", "tilt_mech", "tilt_elc", "antenna_height_m", "grids_resolved_1deg", "grids_resolved_2deg",
        "new_max_distance_1deg_m", "new_max_distance_2deg_m", "resolution_1deg_pct", "resolution_2deg_pct",
        F.col("recommended_tilt_change").cast("long").alias("recommended_tilt_change"), "removed_interference_grids",
        "new_interference_grids", "new_interference_pct", "interference_reduction_pct", "severity_score", "severity_category",
    ), 3, nudge=1e-9)


@query
def overshoot_cells(spark, sf):
    return _over_output(overshoot.detect_overshooting(tables.coverage(spark, sf), tables.cell_gis(spark, sf), OVER).cells)


def _over_env(spark, sf):
    gis = tables.cell_gis(spark, sf)
    env = environment.classify_environment(gis, ENV_RULES)
    return overshoot.detect_overshooting(tables.coverage(spark, sf), gis, P.Overshoot(), env, OVER_ENV)


@query
def overshoot_env_cells(spark, sf):
    out = _over_env(spark, sf).cells
    extra = out.select("cell_name", "environment")
    return _over_output(out).join(extra, "cell_name")


@query
def overshoot_env_bins(spark, sf):
    out = _over_env(spark, sf).bins
    return rounded(out.select("ix", "iy", "cell_name", "environment", "competing_cells", "cell_traffic_pct", "relative_reach"))


@query
def undershoot_candidates(spark, sf):
    rows = undershoot.sanitise(tables.coverage(spark, sf), tables.cell_gis(spark, sf))
    stats = undershoot.cell_statistics(rows)
    candidates = stats.where(F.col("max_distance_m") <= UNDER.max_cell_distance)
    bins = undershoot.interfering_rows(rows, candidates, UNDER)
    return rounded(undershoot.with_interference(candidates, bins), 6)


@query
def undershoot_bins(spark, sf):
    out = undershoot.detect_undershooting(tables.coverage(spark, sf), tables.cell_gis(spark, sf), UNDER).bins
    return out.select("ix", "iy", "cell_name", "competing_rows")


@query
def undershoot_uptilt(spark, sf):
    out = undershoot.detect_undershooting(tables.coverage(spark, sf), tables.cell_gis(spark, sf), UNDER).cells
    return rounded(out.withColumn("recommended_uptilt_deg", F.col("recommended_uptilt_deg").cast("long")))


def _under_env(spark, sf):
    gis = tables.cell_gis(spark, sf)
    env = environment.classify_environment(gis, ENV_RULES)
    return undershoot.detect_undershooting(tables.coverage(spark, sf), gis, P.Undershoot(), env, UNDER_ENV), env


@query
def undershoot_env(spark, sf):
    out = _under_env(spark, sf)[0].cells
    return rounded(out.withColumn("recommended_uptilt_deg", F.col("recommended_uptilt_deg").cast("long")))


@query
def undershoot_compare(spark, sf):
    by_class, env = _under_env(spark, sf)
    plain = undershoot.detect_undershooting(tables.coverage(spark, sf), tables.cell_gis(spark, sf), UNDER)
    return rounded(undershoot.compare_modes(plain.cells, by_class.cells, env))


# --- identity planning and feeders -----------------------------------------------------

from cellscape.operators import feeders, pci  # noqa: E402

PLAN = P.PciPlan(max_low_activity=8.0, max_low_share=0.05, max_single_activity=6.0)


def _relations_with_dead(spark, sf):
    """Some relations carry no handovers, so that dead ones exist."""
    rel = tables.relations(spark, sf)
    idle = (F.col("weight") <= 4) & (F.length("cell_name") > 0) & (F.col("pci") + F.col("to_pci") < 40)
    return rel.withColumn("weight", F.when(idle, 0.0).otherwise(F.col("weight")))


def _network(spark, sf):
    return pci.build_network(_relations_with_dead(spark, sf), PLAN)


@query
def pci_edges(spark, sf):
    out = _network(spark, sf).edges.select("serving", "neighbour", "out_ho", "in_ho", "act_ho", "share", "active_neighbours")
    return rounded(out, 6)


@query
def pci_pairs(spark, sf):
    """As its SQL twin: two-hop weights of pairs that can collide only; ``pci_all_pairs`` has them all."""
    return rounded(pci.collision_weights(_network(spark, sf), PLAN), 4)


@query
def pci_all_pairs(spark, sf):
    return rounded(pci.pair_weights(_network(spark, sf), PLAN), 4)


@query
def pci_confusions(spark, sf):
    return rounded(pci.detect_confusions(_network(spark, sf)), 4)


@query
def pci_confusion_members(spark, sf):
    out = pci.confusion_members(_network(spark, sf))
    return rounded(out.select("serving", "band", F.col("pci").alias("confusion_pci"), "neighbour", "act_ho", "group_size"), 4)


@query
def pci_collisions(spark, sf):
    return rounded(pci.detect_collisions(_network(spark, sf), PLAN), 4)


@query
def pci_blacklist(spark, sf):
    return rounded(pci.suggest_blacklist(_network(spark, sf), PLAN), 6)


@query
def pci_blacklist_applied(spark, sf):
    rel = _relations_with_dead(spark, sf)
    decisions = pci.suggest_blacklist(pci.build_network(rel, PLAN), PLAN)
    net = pci.apply_blacklist(rel, decisions, PLAN)
    return rounded(net.edges.select("serving", "neighbour", "act_ho", "share", "active_neighbours"), 6)


@query
def cosector_groups(spark, sf):
    rel = tables.relations(spark, sf).withColumn(
        "intra_cell", F.when((F.col("intra_site") == "y") & (F.col("band") == F.col("to_band")), "y").otherwise("n")
    )
    return pci.co_sector_groups(rel)


@query
def pci_summary(spark, sf):
    net = _network(spark, sf)
    found = pci.planning_summary(pci.score_confusions(pci.confusion_members(net)), pci.detect_collisions(net, PLAN), pci.suggest_blacklist(net, PLAN))
    return found


FEED = P.Feeders(swap_ratio=0.3, anomaly_ratio=0.5, anomaly_weight=5.0, swap_angle=60.0)


@query
def feeder_geometry(spark, sf):
    out = feeders.relation_geometry(tables.relations(spark, sf), tables.cell_gis(spark, sf), FEED)
    return rounded(out.select("cell_name", "to_cell_name", "weight", "distance", "angle_to_neighbor", "angle_diff", "in_beam"), 4)


@query
def feeder_cells(spark, sf):
    out = feeders.detect_crossed_feeders(tables.relations(spark, sf), tables.cell_gis(spark, sf), FEED).cells
    return rounded(out.select(
        "cell_name", "site", "band", "total_weight", "in_beam_weight", "out_of_beam_weight", "out_of_beam_ratio", "total_relations",
        "out_of_beam_relations", "dominant_traffic_direction", "confidence_level", "swap_partner", "severity_score", "severity_category",
    ), 3)


@query
def feeder_relation_texts(spark, sf):
    out = feeders.detect_crossed_feeders(tables.relations(spark, sf), tables.cell_gis(spark, sf), FEED).cells
    return out.select("cell_name", "top_suspicious_relations")


@query
def feeder_swaps(spark, sf):
    return rounded(feeders.detect_crossed_feeders(tables.relations(spark, sf), tables.cell_gis(spark, sf), FEED).pairs, 3)


@query
def feeder_sites(spark, sf):
    return rounded(feeders.detect_crossed_feeders(tables.relations(spark, sf), tables.cell_gis(spark, sf), FEED).sites, 3)


def _impact_geometry(spark, sf):
    hbw = tables.cell_gis(spark, sf).select("cell_name", F.col("hbw").alias("cell_hbw"))
    return impacts.neighbour_distances(_impacts(spark, sf)).join(hbw, "cell_name")


@query
def feeder_scored(spark, sf):
    return rounded(feeders.scored_feeders(_impact_geometry(spark, sf)), 3)


@query
def feeder_cosector(spark, sf):
    out = feeders.co_sector_feeders(_impacts(spark, sf), min_share=0.5, max_diff=-1.0)
    return rounded(out, 3)


@query
def feeder_bins(spark, sf):
    kept = ["ix", "iy", "cell_name", "event_count", "avg_rsrp", "avg_rsrq", "avg_sinr", "grid_bearing_diff"]
    return rounded(feeders.feeders_from_bins(enrich.bin_and_cell_totals(tables.coverage(spark, sf).select(*kept))), 5)


# --- interference, gaps, low coverage, outlines ------------------------------------------

from cellscape.operators import gaps, hulls, interference, lowcoverage, rootcause, spans  # noqa: E402
from cellscape.session import cut_lineage  # noqa: E402

NOISY = P.Interference(min_cells=3, max_sinr_db=None, ring_share=0.2, dominant_share=0.12)
MEASURED = P.Gaps(min_missing_neighbours=24, min_cluster_bins=6, min_area_km2=0.05, thin_deg=0.002)
HOLES = P.Gaps(min_missing_neighbours=24, min_cluster_bins=6, min_area_km2=0.1)
WEAK = P.LowCoverage(min_problem_bins=20, min_cluster_bins=6, min_area_km2=0.1)


def _outlined(regions):
    """Regions with the corners of their outline and the number of parts less holes in place of the shape."""
    holes = F.size(F.filter("shape", lambda r: r["hole"]))
    corners = F.aggregate("shape", F.lit(0), lambda n, r: n + F.size(r["ring"]) - 1)
    return regions.withColumns({"n_corners": corners.cast("long"), "parts_less_holes": (F.size("shape") - 2 * holes).cast("long")}).drop("shape")


def _shared_coverage(spark, sf):
    cov = tables.coverage(spark, sf).select("ix", "iy", "cell_name", "band", "avg_rsrp", "avg_sinr", "event_count", "distance_to_cell")
    out = enrich.join_group(cov, ["ix", "iy"], _t=F.sum("event_count"))
    return out.withColumn("perc_grid_events", F.col("event_count") / F.col("_t")).drop("_t")


@query
def interference_groups(spark, sf):
    rows = interference.level_groups(interference.close_to_strongest(_shared_coverage(spark, sf), NOISY), NOISY)
    return rounded(rows.select("band", "ix", "iy", "cell_name", "perc_grid_events", "rsrp_dist_max", F.col("grid_cluster_no").cast("long").alias("grid_cluster_no")), 6, nudge=1e-9)


@query
def interference_linked(spark, sf):
    """Signal groups of every bin by complete linkage."""
    p = dataclasses.replace(NOISY, clustering="linked", linkage_width_db=0.6)
    rows = interference.level_groups(interference.close_to_strongest(_shared_coverage(spark, sf), p), p)
    return rounded(rows.select("band", "ix", "iy", "cell_name", "rsrp_dist_max", F.col("grid_cluster_no").cast("long").alias("grid_cluster_no")), 6)


@query
def interference_dominant(spark, sf):
    cov = _shared_coverage(spark, sf)
    return interference.dominant_bins(cov, interference.close_to_strongest(cov, NOISY), NOISY)


@query
def interference_bins(spark, sf):
    out = interference.interfering_bins(_shared_coverage(spark, sf), NOISY)
    return rounded(out.select("band", "ix", "iy", "cell_name", "avg_rsrp", "count"))


@query
def interference_kring(spark, sf):
    out = interference.dense_bins(interference.interfering_bins(_shared_coverage(spark, sf), NOISY), NOISY)
    return out.select("band", "ix", "iy", "interferers_within_3_steps").distinct()


@query
def interference_cells(spark, sf):
    rows = cut_lineage(interference.dense_bins(interference.interfering_bins(_shared_coverage(spark, sf), NOISY), NOISY))
    return rounded(interference.cell_interference(interference.with_rsrp_weight(rows)), 3)


@query
def interference_clusters(spark, sf):
    found = interference.detect_interference(_shared_coverage(spark, sf), NOISY)
    return rounded(_outlined(found.clusters), 4, nudge=1e-9)


@query
def interference_members(spark, sf):
    """The cells of every interference region, one row each."""
    return interference.detect_interference(_shared_coverage(spark, sf), NOISY).members


@query
def interference_root_cause(spark, sf):
    found = interference.detect_interference(_shared_coverage(spark, sf), NOISY)
    out = rootcause.analyse_root_causes(found.clusters, found.members, tables.cell_gis(spark, sf)).clusters
    return rounded(out.drop("shape").withColumn("causes", F.array_join("causes", ",")), 3)


@query
def interference_tilt_advice(spark, sf):
    found = interference.detect_interference(_shared_coverage(spark, sf), NOISY)
    return rounded(rootcause.analyse_root_causes(found.clusters, found.members, tables.cell_gis(spark, sf)).tilt_advice)


@query
def low_coverage_bins(spark, sf):
    cov = tables.coverage(spark, sf).withColumn("avg_rsrp", F.col("avg_rsrp") - 20)
    env = environment.classify_environment(tables.cell_gis(spark, sf), ENV_RULES)
    return rounded(lowcoverage.low_rsrp_bins(lowcoverage.good_rows(cov, env), WEAK))


@query
def low_coverage_kring(spark, sf):
    cov = tables.coverage(spark, sf).withColumn("avg_rsrp", F.col("avg_rsrp") - 20)
    rows = lowcoverage.good_rows(cov, environment.classify_environment(tables.cell_gis(spark, sf), ENV_RULES))
    return rounded(lowcoverage.dense_low_bins(lowcoverage.low_rsrp_bins(rows, WEAK), rows, WEAK))


def _low(spark, sf):
    cov = tables.coverage(spark, sf).withColumn("avg_rsrp", F.col("avg_rsrp") - 20)
    env = environment.classify_environment(tables.cell_gis(spark, sf), ENV_RULES)
    return lowcoverage.detect_low_coverage(cov, env, WEAK, min_outline_km2=0.1), cov, env


@query
def low_coverage_clusters(spark, sf):
    return rounded(_outlined(_low(spark, sf)[0].clusters))


@query
def low_coverage_advice(spark, sf):
    found, cov, env = _low(spark, sf)
    return rounded(lowcoverage.recommend(found, tables.cell_gis(spark, sf), cov, env))


@query
def server_counts(spark, sf):
    return lowcoverage.server_count_distribution(tables.coverage(spark, sf))


def _hulls(spark, sf, share=hulls.CLOSEST_SHARE):
    built = hulls.build_hulls(tables.coverage(spark, sf), tables.cell_gis(spark, sf), share)
    return hulls.enrich_hulls(built, tables.cell_gis(spark, sf))


def _wedges(spark, sf):
    """Short sector outlines, which leave room between sites."""
    gis = tables.cell_gis(spark, sf)
    ring = geo.sector_ring(F.col("latitude"), F.col("longitude"), F.col("bearing"), F.col("hbw"), 300.0)
    return gis.select("cell_name", "band", "pci", "site", ring.alias("ring"))


@query
def hull_build(spark, sf):
    out = _hulls(spark, sf).withColumns({"n_corners": (F.size("ring") - 1).cast("long"), "_b": rings.ring_bounds(F.col("ring"))})
    box = [F.round(f"_b.{c}", 6).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")]
    return out.select("cell_name", "sample_count", F.round("area_km2", 4).alias("area_km2"), "band", "pci", "site", "n_corners", *box)


@query
def outline_cover(spark, sf):
    """Every sector outline as spans of bins per lattice column."""
    covered = spans.cover_spans(shapes.with_shape(_wedges(spark, sf)), ["cell_name", "band"])
    return covered.select("cell_name", "band", "ix", "lo", "hi")


@query
def uncovered_bins(spark, sf):
    wedges = _wedges(spark, sf)
    return gaps.uncovered_bins(wedges, gaps.hull_clusters(wedges, HOLES)).select("ix", "iy").distinct()


@query
def coverage_gaps_measured(spark, sf):
    """Gaps per band between outlines measured from the coverage table; those of the closest tenth leave some."""
    return rounded(_outlined(gaps.detect_coverage_gaps(_hulls(spark, sf, 0.1), MEASURED, by_band=True).gaps))


@query
def single_server_measured(spark, sf):
    """Spans per lattice column inside the measured outline of one cell of a band only."""
    return lowcoverage.single_server_spans(_hulls(spark, sf))


@query
def hull_dbscan(spark, sf):
    return gaps.hull_clusters(_wedges(spark, sf), P.Gaps(eps_m=1500.0))


@query
def coverage_gaps(spark, sf):
    return rounded(_outlined(gaps.detect_coverage_gaps(_wedges(spark, sf), HOLES).gaps))


@query
def coverage_gaps_by_band(spark, sf):
    return rounded(_outlined(gaps.detect_coverage_gaps(_wedges(spark, sf), HOLES, by_band=True).gaps))


@query
def gap_statistics(spark, sf):
    return gaps.gap_statistics(gaps.detect_coverage_gaps(_wedges(spark, sf), HOLES, by_band=True).gaps)


@query
def gap_cells(spark, sf):
    found = gaps.detect_coverage_gaps(_wedges(spark, sf), HOLES)
    near = gaps.nearest_cells(found.gaps, tables.coverage(spark, sf), tables.cell_gis(spark, sf))
    return rounded(near.withColumn("nearby_cells", F.array_join("nearby_cells", ",")), 2)


@query
def single_server_bins(spark, sf):
    return lowcoverage.single_server_bins(_wedges(spark, sf))


@query
def hull_conflicts(spark, sf):
    return hulls.detect_pci_overlaps(_hulls(spark, sf)).drop("recommendation")


@query
def ca_imbalance(spark, sf):
    pattern = P.CarrierAggregation(cell_pattern=r"^(S\d+)[LH](\d)$", pairs=(("L800-L1800", "L800", "L1800"),), threshold=0.999)
    return hulls.detect_ca_imbalance(_hulls(spark, sf), pattern).drop("recommendation")


def _growth(spark, sf):
    steps = F.array(*[F.struct(F.lit(n).alias("degree"), F.lit(300.0 * n).alias("dist_increase")) for n in (1, 2)])
    return tables.cell_gis(spark, sf).select("cell_name", F.explode(steps).alias("s")).select("cell_name", "s.*")


@query
def uptilt_extension(spark, sf):
    gis = tables.cell_gis(spark, sf)
    grown = hulls.expansion_bins(_wedges(spark, sf), gis, _growth(spark, sf))
    return rounded(hulls.expansion_interference(grown, tables.coverage(spark, sf)))


@query
def uptilt_final_candidates(spark, sf):
    cov, gis = tables.coverage(spark, sf), tables.cell_gis(spark, sf)
    # bins here have about thirty servers each, so that many count as quiet
    shares = hulls.expansion_interference(hulls.expansion_bins(_wedges(spark, sf), gis, _growth(spark, sf)), cov, max_cells=30)
    grids = cov.groupBy("cell_name").agg(F.count(F.lit(1)).alias("grid_count"))
    return rounded(hulls.final_uptilt_candidates(shares, grids, max_share=0.7, min_growth=0.02))


@query
def pci_collisions_output(spark, sf):
    return rounded(pci.actionable_collisions(pci.detect_collisions(_network(spark, sf), PLAN)))


@query
def bearing_shift(spark, sf):
    turned = hulls.shift_hulls(_wedges(spark, sf), tables.cell_gis(spark, sf), F.lit(90.0))
    box = turned.withColumn("_b", rings.ring_bounds(F.col("ring")))
    return rounded(box.select("cell_name", "_b.*"), 5)


# --- reports, validation, combined views --------------------------------------------------

import datetime  # noqa: E402

from cellscape.operators import combine, reports, validate  # noqa: E402

DAY = datetime.date(2025, 3, 9)


def _gis_with_ids(spark, sf):
    return tables.cell_gis(spark, sf).withColumn("cell_cilac", F.col("cell_key") + 1000)


def _shooters(spark, sf):
    cov, gis = tables.coverage(spark, sf), tables.cell_gis(spark, sf)
    over = overshoot.detect_overshooting(cov, gis, OVER)
    under = undershoot.detect_undershooting(cov, gis, UNDER)
    return over, under, cov


@query
def daily_resolution(spark, sf):
    over, under, cov = _shooters(spark, sf)
    flagged = over.bins.join(over.cells.select("cell_name"), "cell_name", "left_semi")
    return reports.daily_resolution(over.cells, flagged, under.cells, under.bins, cov, _gis_with_ids(spark, sf), DAY)


@query
def resolution_table(spark, sf):
    over, under, cov = _shooters(spark, sf)
    return reports.resolution_table(over.cells, over.bins, under.cells, under.bins, cov, _gis_with_ids(spark, sf), DAY)


@query
def tier3_neighbours(spark, sf):
    over, _, cov = _shooters(spark, sf)
    return reports.tier3_neighbours(over.cells, over.bins, cov, tables.relations(spark, sf), _gis_with_ids(spark, sf), DAY)


def _pci_findings(spark, sf):
    net = _network(spark, sf)
    collisions = cut_lineage(pci.detect_collisions(net, PLAN))
    decisions = cut_lineage(pci.suggest_blacklist(net, PLAN))
    return collisions, cut_lineage(pci.confusion_members(net)), decisions


@query
def pci_level1(spark, sf):
    return reports.pci_level1(_pci_findings(spark, sf)[0], tables.relations(spark, sf), _gis_with_ids(spark, sf), DAY)


@query
def pci_blacklist_table(spark, sf):
    return reports.pci_blacklist_table(_pci_findings(spark, sf)[2], tables.relations(spark, sf), _gis_with_ids(spark, sf), DAY)


@query
def pci_level2(spark, sf):
    return reports.pci_level2(*_pci_findings(spark, sf), tables.relations(spark, sf), _gis_with_ids(spark, sf), DAY)


@query
def pci_combined(spark, sf):
    return reports.pci_combined(*_pci_findings(spark, sf), tables.relations(spark, sf), _gis_with_ids(spark, sf), DAY)


@query
def validate_overshoot(spark, sf):
    gis = tables.cell_gis(spark, sf)
    rows = gis.select(
        "cell_name",
        (F.col("pci") % 6 / 2).alias("recommended_downtilt_deg"),
        (F.col("tilt_elc") + F.col("tilt_mech") + 5).alias("current_total_tilt_deg"),
        ((F.col("pci") - 3) / 30).alias("coverage_reduction_percentage"),
        (F.col("bearing") / 10 - 1).alias("avg_rsrp_reduction_db"),
        (F.col("antenna_height") / 40).alias("severity_score"),
    )
    return rounded(validate.validate_overshooting(rows).issues)


@query
def validate_undershoot(spark, sf):
    gis = tables.cell_gis(spark, sf)
    rows = gis.select(
        "cell_name",
        (F.col("pci") % 6 / 2).alias("recommended_uptilt_deg"),
        (F.col("tilt_elc") + F.col("tilt_mech") - 1).alias("current_total_tilt"),
        ((F.col("pci") - 3) / 20).alias("coverage_increase_percentage"),
        ((F.col("bearing") - 40) * 20).alias("distance_increase_m"),
        (F.col("antenna_height") * 50).alias("current_distance_m"),
        (F.col("antenna_height") / 42).alias("interference_percentage"),
    )
    out = validate.validate_undershooting(rows)
    return validate.issue_totals(out.issues)


@query
def unified_cells(spark, sf):
    over, under, _ = _shooters(spark, sf)
    conf = pci.confusion_members(_network(spark, sf)).select(F.col("serving").alias("cell_name"))
    swaps = feeders.detect_crossed_feeders(tables.relations(spark, sf), tables.cell_gis(spark, sf), FEED).cells
    swaps = swaps.where(F.col("confidence_level") != "NONE")
    return combine.issue_matrix(tables.cell_gis(spark, sf), overshooting=over.cells, undershooting=under.cells, confusion=conf, feeders=swaps)


@query
def issue_overlap(spark, sf):
    over, under, _ = _shooters(spark, sf)
    return combine.issue_overlap(over.cells, under.cells)


@query
def issue_statistics(spark, sf):
    over, under, _ = _shooters(spark, sf)
    both = combine.unified_recommendations(overshooters=over.cells, undershooters=under.cells)
    return combine.severity_statistics(both)


@query
def detector_statistics(spark, sf):
    """Statistics of cell, identity and area detectors."""
    over, under, _ = _shooters(spark, sf)
    net = _network(spark, sf)
    holes = gaps.detect_coverage_gaps(_wedges(spark, sf), HOLES, by_band=True).gaps
    found = combine.detector_statistics(
        overshooting=over.cells, undershooting=under.cells, pci_confusions=pci.detect_confusions(net), pci_collisions=pci.detect_collisions(net, PLAN),
        pci_blacklist=pci.suggest_blacklist(net, PLAN), coverage_gaps=holes,
    )
    return rounded(found, 3)


@query
def unified_identities(spark, sf):
    """Confusions and blacklist entries in the common list of recommendations."""
    net = _network(spark, sf)
    return rounded(combine.unified_recommendations(confusions=pci.detect_confusions(net), blacklist=pci.suggest_blacklist(net, PLAN)), 4)


@query
def tilt_per_cell(spark, sf):
    """One tilt change per cell of over- and undershooting together; uptilts are negative."""
    over, under, _ = _shooters(spark, sf)
    down = over.cells.select("cell_name", "severity_score", F.col("recommended_tilt_change").cast("int").alias("tilt_change"))
    up = under.cells.select("cell_name", "severity_score", (-F.col("recommended_uptilt_deg")).cast("int").alias("tilt_change"))
    return combine.first_tilt_per_cell(down.unionByName(up), "tilt_change")


@query
def input_quality(spark, sf):
    cov, gis = tables.coverage(spark, sf), tables.cell_gis(spark, sf)
    return validate.input_quality(cov, gis.where(F.col("market") != "0"), _hulls(spark, sf), r"^S\d+[LH][12]$", 0.7, DAY)


@query
def hull_quality(spark, sf):
    return hulls.hull_quality(_hulls(spark, sf), DAY, min_samples=15_000)


@query
def low_coverage_plain(spark, sf):
    cov = tables.coverage(spark, sf).withColumn("avg_rsrp", F.col("avg_rsrp") - 20)
    return lowcoverage.low_rsrp_bins_plain(lowcoverage.good_rows(cov, environment.classify_environment(tables.cell_gis(spark, sf), ENV_RULES)), WEAK)


@query
def detector_counts(spark, sf):
    over, under, _ = _shooters(spark, sf)
    return combine.detector_counts(overshooting=over.cells, overshooting_bins=over.bins, undershooting=under.cells, undershooting_bins=under.bins)


@query
def flagged_bins(spark, sf):
    over, under, cov = _shooters(spark, sf)
    return combine.flag_bins(cov.select("cell_name", "ix", "iy"), overshooting=over.bins, interfering=under.bins)


@query
def market_contributors(spark, sf):
    return rounded(combine.market_contributors(tables.cell_gis(spark, sf), 3000.0), 3)


@query
def cell_bin_documents(spark, sf):
    return combine.cell_bin_documents(tables.coverage(spark, sf))


@query
def coverage_quality(spark, sf):
    cov = tables.coverage(spark, sf).withColumn("grid", lattice.encode(F.col("ix"), F.col("iy")))
    return validate.coverage_quality(cov, DAY)
