"""Bins where several cells of a band arrive equally strong, and the regions they form."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.functions import lattice, text
from cellscape.functions.rings import let
from cellscape.functions.scoring import clip, range_score, ratio, severity_category
from cellscape.operators.checks import COVERAGE, require
from cellscape.operators.outline import cluster_bins, region_outlines
from cellscape.operators.quantile import group_quantiles
from cellscape.operators.ring import ring_density
from cellscape.params import BAND_GAP_DB, DEFAULT_BAND_GAP_DB, Interference
from cellscape.session import cut_lineage

KEY = ["band", "ix", "iy"]


class InterferenceFindings(NamedTuple):
    clusters: DataFrame
    members: DataFrame
    bins: DataFrame


def band_gap(band: Column) -> Column:
    return text.choose(F.upper(band), BAND_GAP_DB, F.lit(DEFAULT_BAND_GAP_DB))


def renormalise_shares(coverage: DataFrame) -> DataFrame:
    """Event shares that add up to one per bin of a band; a table without shares stays as it is."""
    if "perc_grid_events" not in coverage.columns:
        return coverage
    total = F.sum("perc_grid_events").over(Window.partitionBy(*KEY))
    return coverage.withColumn("perc_grid_events", ratio(F.col("perc_grid_events"), total))


def close_to_strongest(coverage: DataFrame, p: Interference = Interference()) -> DataFrame:
    """Good rows within the band's gap of the strongest row of their bin.

    The figures of a bin are windows over one partitioning: a table that arrives by (ix, iy) is not shuffled again.
    """
    rows = renormalise_shares(coverage.dropna(subset=KEY))
    if not p.perceived:  # both columns are optional
        if "event_count" in rows.columns:
            rows = rows.where(F.col("event_count") >= p.min_events)
        if "perc_grid_events" in rows.columns:
            rows = rows.where(F.round("perc_grid_events", 9) >= p.min_share)
    rows = rows.withColumn("max_rsrp", F.max("avg_rsrp").over(Window.partitionBy(*KEY))).withColumn("rsrp_dist_max", F.round(F.col("max_rsrp") - F.col("avg_rsrp"), 6))
    return rows.where(F.col("rsrp_dist_max") <= band_gap(F.col("band")))


def level_groups(rows: DataFrame, p: Interference = Interference()) -> DataFrame:
    """Number and name the groups of similar signal within each bin."""
    if p.clustering == "fixed":
        rows = _anchored_groups(rows, p.fixed_width_db)
    else:
        rows = _linked_groups(rows, p.linkage_width_db)
    name = F.format_string("%s_grp%02d", lattice.encode(F.col("ix"), F.col("iy")), F.col("grid_cluster_no"))
    return rows.withColumn("grid_cluster_name", name)


def _anchored_groups(rows: DataFrame, width: float) -> DataFrame:
    """A group takes every row within ``width`` of its strongest; the next row starts another.

    Gaps are capped by the band limit, so a bin has few groups and each start is one minimum over the bin.
    """
    rows = rows.withColumns({"grid_cluster_no": F.lit(1), "_anchor": F.lit(0.0)})
    widest = max(*BAND_GAP_DB.values(), DEFAULT_BAND_GAP_DB)
    for n in range(2, math.ceil(widest / width) + 1):
        beyond = F.col("rsrp_dist_max") - F.col("_anchor") > width
        last = F.col("grid_cluster_no") == n - 1
        moved = last & beyond
        rows = rows.withColumn("_next", F.min(F.when(moved, F.col("rsrp_dist_max"))).over(Window.partitionBy(*KEY)))
        rows = rows.withColumns({
            "grid_cluster_no": F.when(moved, F.lit(n)).otherwise(F.col("grid_cluster_no")),
            "_anchor": F.when(moved, F.col("_next")).otherwise(F.col("_anchor")),
        }).drop("_next")
    return rows.drop("_anchor")


def _linked_groups(rows: DataFrame, width: float) -> DataFrame:
    """Complete-linkage groups of the distinct gaps of a bin; members lie within 2 x width.

    Equal gaps always share a group, so only distinct values take part; they are capped by the band limit and
    measured in hundredths, so a bin has a few hundred at most.  Groups are intervals of the sorted gaps, and a step
    joins the two neighbours that span least.
    """
    values = F.array_sort(F.collect_set("rsrp_dist_max"))
    single = F.transform(values, lambda x: F.struct(x.alias("lo"), x.alias("hi")))
    own = rows.groupBy(*KEY).agg(single.alias("_start"))

    def join_least(groups: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(groups) - 2), lambda i: F.struct((F.get(groups, i + 1)["hi"] - F.get(groups, i)["lo"]).alias("span"), i.alias("i")))

        def joined(best: Column) -> Column:
            i = best["i"]
            both = F.array(F.struct(F.get(groups, i)["lo"].alias("lo"), F.get(groups, i + 1)["hi"].alias("hi")))
            return F.when(best["span"] < 2 * width, F.concat(F.slice(groups, F.lit(1), i), both, F.slice(groups, i + 3, F.size(groups)))).otherwise(groups)

        return F.when(F.size(groups) > 1, let(F.array_min(pairs), joined)).otherwise(groups)

    steps = F.sequence(F.lit(1), F.greatest(F.size("_start") - 1, F.lit(1)))
    own = own.withColumn("_groups", F.aggregate(steps, F.col("_start"), lambda groups, _: join_least(groups))).drop("_start")
    number = F.size(F.filter("_groups", lambda g: g["lo"] <= F.col("rsrp_dist_max")))
    return rows.join(own, KEY).withColumn("grid_cluster_no", number).drop("_groups")


def dominant_bins(coverage: DataFrame, rows: DataFrame, p: Interference = Interference()) -> DataFrame:
    """Bins where one cell leads by the band's gap and carries a large share of events."""
    strongest = Window.partitionBy(*KEY).orderBy(F.desc("avg_rsrp"), "cell_name")
    ranked = coverage.select(*KEY, "cell_name", "avg_rsrp").withColumn("_n", F.row_number().over(strongest))
    second = ranked.where(F.col("_n") <= 2).groupBy(*KEY).agg(F.max(F.when(F.col("_n") == 2, F.col("avg_rsrp"))).alias("_second"))
    best = rows.groupBy(*KEY).agg(F.first("max_rsrp").alias("_best"))
    lead = best.join(second, KEY).where(F.round(F.col("_best") - F.col("_second"), 6) >= band_gap(F.col("band"))).select(*KEY)
    if p.perceived:
        return lead
    loaded = coverage.where(F.col("perc_grid_events") >= p.dominant_share).select(*KEY).distinct()
    return lead.join(loaded, KEY, "left_semi")


def interfering_bins(coverage: DataFrame, p: Interference = Interference()) -> DataFrame:
    """Rows of groups with enough similar cells, outside dominated bins.

    Dominance is that of ``dominant_bins``, marked on the rows in the same pass, so the table is shuffled once.
    """
    everyone = Window.partitionBy(*KEY).orderBy(F.desc("avg_rsrp"), "cell_name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    loaded = F.lit(True) if p.perceived else F.coalesce(F.max(F.col("perc_grid_events") >= p.dominant_share).over(everyone), F.lit(False))
    marked = coverage.dropna(subset=KEY).withColumns({"_second": F.nth_value("avg_rsrp", 2).over(everyone), "_loaded": loaded})
    rows = close_to_strongest(marked, p)
    leads = F.round(F.col("max_rsrp") - F.col("_second"), 6) >= band_gap(F.col("band"))
    rows = rows.where(~F.coalesce(leads & F.col("_loaded"), F.lit(False))).drop("_second", "_loaded")
    needed = p.min_cells * p.perceived_multiplier if p.perceived else p.min_cells
    group = Window.partitionBy(*KEY, "grid_cluster_no")
    grouped = level_groups(rows, p).withColumn("count", F.count(F.lit(1)).over(group))
    return cut_lineage(grouped.where(F.col("count") >= needed))


def dense_bins(rows: DataFrame, p: Interference = Interference()) -> DataFrame:
    """Rows of bins whose neighbourhood holds enough other interfering bins."""
    name = f"interferers_within_{p.ring}_steps"
    density = ring_density(rows, ["band"], p.ring, name)
    return rows.join(density.where(F.col(name) > (2 * p.ring + 1) ** 2 * p.ring_share), KEY)


def with_rsrp_weight(rows: DataFrame) -> DataFrame:
    """Position of each row's signal between the 2nd and 98th percentile of its band."""
    spread = group_quantiles(rows, ["band"], "avg_rsrp", {"_lo": 0.02, "_hi": 0.98}, 0.1)
    out = rows.join(spread, "band", "left")
    return out.withColumn("weight", range_score(F.col("avg_rsrp"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def detect_interference(coverage: DataFrame, p: Interference = Interference()) -> InterferenceFindings:
    """Interference regions with severity, their member cells, and the rows behind them."""
    require(coverage, "interference", *COVERAGE[:5], *(() if p.perceived else ("perc_grid_events",)))
    if p.max_sinr_db is not None and "avg_sinr" in coverage.columns:
        coverage = coverage.where(F.col("avg_sinr") <= p.max_sinr_db)
    rows = cut_lineage(with_rsrp_weight(cut_lineage(dense_bins(interfering_bins(coverage, p), p))))
    regions = cluster_bins(rows, ["band"], p.min_cluster_bins, p.link_bins).drop("n_points")
    rows = cut_lineage(
        rows.join(regions, KEY).withColumn("cluster_id", F.concat_ws("_", "band", F.col("component").cast("string")))
    )
    by = ["cluster_id", "band"]
    measures = [F.avg("avg_sinr").alias("avg_sinr")] if "avg_sinr" in rows.columns else []
    facts = rows.groupBy(*by).agg(
        F.countDistinct("ix", "iy").alias("n_grids"),
        F.countDistinct("cell_name").alias("n_cells"),
        F.avg(lattice.iy_to_lat(F.col("iy"))).alias("centroid_lat"),
        F.avg(lattice.ix_to_lon(F.col("ix"))).alias("centroid_lon"),
        F.avg("avg_rsrp").alias("avg_rsrp"),
        *measures,
    )
    clusters = cut_lineage(facts.join(region_outlines(rows, by), by))
    members = cut_lineage(rows.select(*by, "cell_name").distinct())
    return InterferenceFindings(severity(clusters, p), members, rows)


def severity(clusters: DataFrame, p: Interference = Interference()) -> DataFrame:
    best, worst = p.norm_rsrp_dbm
    parts = (
        clip(F.col("n_grids") / p.norm_bins),
        clip(F.col("n_cells") / p.norm_cells),
        clip(F.col("area_km2") / p.norm_area_km2),
        clip((best - F.col("avg_rsrp")) / (best - worst)),
    )
    out = clusters.withColumn("severity_score", F.round(sum(w * x for w, x in zip(p.weights, parts)), 4))
    return out.withColumn("severity_category", severity_category(F.col("severity_score")))


def cell_interference(rows: DataFrame) -> DataFrame:
    """Interfering rows per cell: number, distances, share of events and total weight."""
    median = group_quantiles(rows, ["cell_name"], "distance_to_cell", {"median_distance_m": 0.5}, 10.0)
    out = rows.groupBy("cell_name").agg(
        F.count(F.lit(1)).alias("n_bins"),
        F.max("distance_to_cell").alias("max_distance_m"),
        F.avg("perc_grid_events").alias("mean_share"),
        F.sum("weight").alias("total_weight"),
    )
    return out.join(median, "cell_name", "left")
