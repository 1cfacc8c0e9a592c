"""Daily tables that hand the findings to planning tools."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.functions import geo
from cellscape.functions.scoring import clip, ratio
from cellscape.params import DailyTable
from cellscape.session import cut_lineage

DAILY_COLUMNS = [
    "analysisdate", "cell_name", "cilac", "parameter", "category", "parameter_new_value", "cycle_start_date",
    "cycle_end_date", "cycle_status", "conditions", "current_tilt", "min_tilt", "max_tilt", "tier_3_sectors_count",
    "tier_3_cells_count", "tier_3_traffic_total", "tier_3_drops_total", "tier3_traffic_perc", "tier3_drops_perc",
]
REPORT_DATE_FORMAT = "dd/MM/yyyy"


def report_date(day: datetime.date, style: str | None = None) -> Column:
    """ISO date text, or the day-first text of the report tables."""
    return F.date_format(F.lit(day), style or "yyyy-MM-dd")


def cell_bands(coverage: DataFrame, gis: DataFrame) -> DataFrame:
    """Band of every cell, as measured, else from the inventory."""
    seen = coverage.groupBy("cell_name").agg(F.min("band").alias("_seen"))
    known = gis.groupBy("cell_name").agg(F.min("band").alias("_known"))
    return known.join(seen, "cell_name", "full").select("cell_name", F.coalesce("_seen", "_known").alias("band"))


def tier3_metrics(flagged: DataFrame, coverage: DataFrame, bands: DataFrame | None = None, count_all_bands: bool = False) -> DataFrame:
    """Per flagged cell: other cells in its flagged bins, its own traffic there and the share of it.

    Other cells count on the cell's band only, unless ``count_all_bands``.
    """
    drops = F.col("drops") if "drops" in coverage.columns else F.lit(0)
    rows = coverage.select("ix", "iy", F.col("cell_name").alias("_other"), F.col("band").alias("_oband"), "event_count", drops.alias("_drops"))
    spots = flagged.select("cell_name", "ix", "iy").distinct()
    if bands is not None:
        spots = spots.join(bands.select("cell_name", F.col("band").alias("_band")), "cell_name", "left")
    else:
        spots = spots.withColumn("_band", F.lit(None).cast("string"))
    own = F.col("_other") == F.col("cell_name")
    on_band = F.lit(True) if count_all_bands else F.col("_band").isNull() | (F.col("_oband") == F.col("_band"))
    inside = (
        spots.join(rows, ["ix", "iy"])
        .groupBy("cell_name", "_other")
        .agg(
            F.max(on_band).alias("_on"),
            F.sum("event_count").alias("_t"),
            F.sum("_drops").alias("_d"),
        )
        .groupBy("cell_name")
        .agg(
            F.sum(F.when(F.col("_on") & ~own, 1).otherwise(0)).alias("tier_3_sectors_count"),
            F.sum(F.when(own, F.col("_t")).otherwise(0)).alias("tier_3_traffic_total"),
            F.sum(F.when(own, F.col("_d")).otherwise(0)).alias("tier_3_drops_total"),
        )
    )
    totals = coverage.join(flagged.select("cell_name").distinct(), "cell_name", "left_semi").groupBy("cell_name").agg(
        F.sum("event_count").alias("_all"), F.sum(drops).alias("_alld")
    )
    out = inside.join(totals, "cell_name", "left")
    return out.select(
        "cell_name",
        "tier_3_sectors_count",
        F.col("tier_3_sectors_count").alias("tier_3_cells_count"),
        F.col("tier_3_traffic_total").cast("long").alias("tier_3_traffic_total"),
        F.col("tier_3_drops_total").cast("long").alias("tier_3_drops_total"),
        F.round(ratio(F.col("tier_3_traffic_total"), F.col("_all")) * 100, 2).alias("tier3_traffic_perc"),
        F.round(ratio(F.col("tier_3_drops_total"), F.col("_alld")) * 100, 2).alias("tier3_drops_perc"),
    )


def _with_tier3(rows: DataFrame, tier3: DataFrame) -> DataFrame:
    out = rows.join(tier3, "cell_name", "left")
    whole = ["tier_3_sectors_count", "tier_3_cells_count", "tier_3_traffic_total", "tier_3_drops_total"]
    return out.fillna(0, whole).fillna(0.0, ["tier3_traffic_perc", "tier3_drops_perc"])


def _tilts(cells: DataFrame, gis: DataFrame, change: str) -> DataFrame:
    extra = [F.col(c) if c in gis.columns else F.lit(None).cast(t).alias(c) for c, t in (("cell_cilac", "long"), ("min_tilt", "double"), ("max_tilt", "double"))]
    site = gis.select("cell_name", F.coalesce("tilt_elc", F.lit(0.0)).alias("_e"), F.coalesce("tilt_mech", F.lit(0.0)).alias("_m"), *extra)
    out = cells.select("cell_name", F.col(change).cast("double").alias("_c")).join(site, "cell_name", "left")
    return out.fillna(0.0, ["_e", "_m", "_c"])


def daily_resolution(
    overshooters: DataFrame,
    overshoot_bins: DataFrame,
    undershooters: DataFrame,
    undershoot_bins: DataFrame,
    coverage: DataFrame,
    gis: DataFrame,
    day: datetime.date,
    p: DailyTable = DailyTable(),
) -> DataFrame:
    """One tilt change per flagged cell: electrical, or manual where no electrical tilt is left."""
    bands = cut_lineage(cell_bands(coverage, gis))
    today = report_date(day)

    def table(cells, flagged, change, category, parameter, new_value):
        rows = _with_tier3(_tilts(cells, gis, change), tier3_metrics(flagged, coverage, bands))
        return rows.select(
            today.alias("analysisdate"),
            "cell_name",
            F.coalesce(F.col("cell_cilac").cast("string"), F.col("cell_name")).alias("cilac"),
            parameter.alias("parameter"),
            F.lit(category).alias("category"),
            F.round(clip(new_value, p.min_tilt, p.max_tilt), 1).alias("parameter_new_value"),
            today.alias("cycle_start_date"),
            F.lit("").alias("cycle_end_date"),
            F.lit(p.status).alias("cycle_status"),
            F.lit(p.created_by).alias("conditions"),
            F.round(F.col("_e") + F.col("_m"), 1).alias("current_tilt"),
            F.lit(p.min_tilt).alias("min_tilt"),
            F.lit(p.max_tilt).alias("max_tilt"),
            *DAILY_COLUMNS[13:],
        )

    down = table(overshooters, overshoot_bins, "recommended_tilt_change", "overshooter", F.lit("Electrical_tilt"), F.col("_e") + F.col("_c"))
    manual = F.col("_e") <= 0
    up = table(
        undershooters, undershoot_bins, "recommended_uptilt_deg", "undershooter",
        F.when(manual, "Manual_tilt").otherwise("Electrical_tilt"),
        F.when(manual, F.col("_m")).otherwise(F.col("_e")) - F.col("_c"),
    )
    return down.unionByName(up)


def resolution_table(overshooters, overshoot_bins, undershooters, undershoot_bins, coverage, gis, day, p: DailyTable = DailyTable()) -> DataFrame:
    """The planning-table form: manual tilt inside each cell's own limits, neighbours of all bands."""
    today = report_date(day, REPORT_DATE_FORMAT)

    def table(cells, flagged, change, category, sign):
        rows = _with_tier3(_tilts(cells, gis, change), tier3_metrics(flagged, coverage, count_all_bands=True))
        low = F.coalesce("min_tilt", F.lit(p.min_tilt))
        high = F.coalesce(F.when(F.col("max_tilt") != 0, F.col("max_tilt")), F.lit(p.max_tilt))
        moved = F.col("_e") + sign * F.abs("_c")
        return rows.select(
            today.alias("analysisdate"),
            "cell_name",
            F.col("cell_cilac").cast("string").alias("cilac"),
            F.lit("Manual_tilt").alias("parameter"),
            F.lit(category).alias("category"),
            F.round(F.greatest(F.least(moved, high), low), 1).alias("parameter_new_value"),
            today.alias("cycle_start_date"),
            today.alias("cycle_end_date"),
            F.lit(p.status).alias("cycle_status"),
            F.lit(p.created_by).alias("conditions"),
            F.round("_e", 1).alias("current_tilt"),
            F.round(low, 1).alias("min_tilt"),
            F.round(high, 1).alias("max_tilt"),
            *DAILY_COLUMNS[13:],
        )

    down = table(overshooters, overshoot_bins, "recommended_tilt_change", "OverShooter", 1)
    return down.unionByName(table(undershooters, undershoot_bins, "recommended_uptilt_deg", "UnderShooter", -1))


def lookup_relations(pairs: DataFrame, relations: DataFrame, gis: DataFrame) -> DataFrame:
    """Traffic, drops, distance and neighbour flag of (cell_a, cell_b).

    The relation in the given direction counts, else the reverse one, else only the distance
    between the inventory positions is known.
    """
    facts = relations.groupBy("cell_name", "to_cell_name").agg(
        F.min(F.struct(
            F.coalesce("traffic_data", F.lit(0.0)).alias("traffic"),
            F.coalesce("drops_voice", F.lit(0.0)).alias("drops"),
            F.coalesce("distance", F.lit(0.0)).alias("distance"),
            F.col("neighbor_relation").alias("relation"),
        )).alias("_r")
    )
    forward = facts.select(F.col("cell_name").alias("cell_a"), F.col("to_cell_name").alias("cell_b"), F.col("_r").alias("_f"))
    reverse = facts.select(F.col("to_cell_name").alias("cell_a"), F.col("cell_name").alias("cell_b"), F.col("_r").alias("_b"))
    place = gis.select("cell_name", "latitude", "longitude")
    out = pairs.join(forward, ["cell_a", "cell_b"], "left").join(reverse, ["cell_a", "cell_b"], "left")
    out = out.join(place.toDF("cell_a", "_lat1", "_lon1"), "cell_a", "left").join(place.toDF("cell_b", "_lat2", "_lon2"), "cell_b", "left")
    known = F.coalesce("_f", "_b")
    straight = F.coalesce(geo.haversine_m(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2")), F.lit(0.0))
    return out.withColumn("_k", known).select(
        *pairs.columns,
        F.coalesce("_k.traffic", F.lit(0.0)).alias("impact_traffic"),
        F.coalesce("_k.drops", F.lit(0.0)).alias("impact_drops"),
        F.coalesce("_k.distance", straight).alias("impact_distance"),
        F.coalesce("_k.relation", F.lit("N/A")).alias("impact_relation"),
    )


def with_cell_ids(df: DataFrame, gis: DataFrame, **names: str) -> DataFrame:
    """Add numeric cell ids: ``new_column="name_column"``."""
    ids = gis.select("cell_name", F.col("cell_cilac")) if "cell_cilac" in gis.columns else gis.select("cell_name", F.lit(None).cast("long").alias("cell_cilac"))
    for new, source in names.items():
        df = df.join(ids.select(F.col("cell_name").alias(source), F.col("cell_cilac").alias(new)), source, "left")
    return df


def tier3_neighbours(overshooters: DataFrame, overshoot_bins: DataFrame, coverage: DataFrame, relations: DataFrame, gis: DataFrame, day: datetime.date, top: int = 5) -> DataFrame:
    """The busiest other cells in each overshooter's flagged bins."""
    spots = overshoot_bins.select("cell_name", "ix", "iy").distinct().join(overshooters.select("cell_name"), "cell_name", "left_semi")
    rows = coverage.select("ix", "iy", F.col("cell_name").alias("toname"), "event_count")
    traffic = spots.join(rows, ["ix", "iy"]).where(F.col("toname") != F.col("cell_name")).groupBy("cell_name", "toname").agg(F.sum("event_count").alias("_t"))
    busiest = Window.partitionBy("cell_name").orderBy(F.desc("_t"), "toname")
    best = traffic.withColumn("_n", F.row_number().over(busiest)).where(F.col("_n") <= top)
    own = tier3_metrics(overshoot_bins, coverage, count_all_bands=True).select("cell_name", "tier_3_traffic_total", "tier3_traffic_perc")
    place = gis.select("cell_name", "latitude", "longitude")
    out = best.join(own, "cell_name").join(place.toDF("cell_name", "_lat1", "_lon1"), "cell_name", "left").join(place.toDF("toname", "_lat2", "_lon2"), "toname", "left")
    flag = lookup_relations(best.select(F.col("cell_name").alias("cell_a"), F.col("toname").alias("cell_b")), relations, gis).select(
        F.col("cell_a").alias("cell_name"), F.col("cell_b").alias("toname"), "impact_relation"
    )
    out = out.join(flag, ["cell_name", "toname"])
    return with_cell_ids(out, gis, fromcilac="cell_name", tocilac="toname").select(
        report_date(day, REPORT_DATE_FORMAT).alias("analysisdate"),
        F.col("cell_name").alias("fromname"),
        "fromcilac",
        "toname",
        "tocilac",
        F.round(geo.haversine_m(F.col("_lat1"), F.col("_lon1"), F.col("_lat2"), F.col("_lon2")), 2).alias("fromtodistance"),
        F.col("tier_3_traffic_total").alias("tier_3_traffic"),
        F.lit(0).alias("tier_3_drops"),
        "tier3_traffic_perc",
        F.lit(0.0).alias("tier3_drops_perc"),
        F.col("impact_relation").alias("is_neighbored"),
    )


def pci_level1(collisions: DataFrame, relations: DataFrame, gis: DataFrame, day: datetime.date) -> DataFrame:
    """Collisions between direct neighbours."""
    rows = collisions.where(F.col("hop_type") == "1-hop").select("cell_a", "cell_b", "pci_a", "pci_b")
    out = with_cell_ids(lookup_relations(rows, relations, gis), gis, cilac="cell_a", nextcilac="cell_b")
    return out.select(
        report_date(day, REPORT_DATE_FORMAT).alias("insertdatetime"),
        F.col("impact_drops").alias("sum_drops"),
        F.col("impact_traffic").alias("sum_impact"),
        F.round("impact_distance", 2).alias("distance"),
        "cilac",
        "nextcilac",
        F.when(F.col("impact_relation") == "Y", 1).otherwise(0).alias("neighbourindex"),
        F.col("pci_a").alias("tosectorsc1"),
        F.col("pci_b").alias("tosectorsc2"),
    )


def pci_blacklist_table(decisions: DataFrame, relations: DataFrame, gis: DataFrame, day: datetime.date) -> DataFrame:
    rows = decisions.select(F.col("serving").alias("cell_a"), F.col("neighbor").alias("cell_b"), "confusion_pci")
    out = with_cell_ids(lookup_relations(rows, relations, gis), gis, cilac="cell_a")
    return out.select(
        report_date(day, REPORT_DATE_FORMAT).alias("insertdatetime"),
        "cilac",
        F.col("confusion_pci").alias("pci"),
        F.lit(0).alias("bl"),
        F.lit("Confusion").alias("colision_type"),
        F.col("impact_traffic").alias("adj_weight"),
        F.lit(0.0).alias("other_adj_weight"),
        F.col("cell_b").alias("adjacency"),
        F.lit("blacklist").alias("parameter"),
        F.lit(1).alias("value"),
        F.lit(None).cast("int").alias("sector_sc_other"),
        F.lit(0.0).alias("distancefrom"),
        F.round("impact_distance", 2).alias("distanceto"),
    )


def _flag(df: DataFrame, names: DataFrame, key: str, alias: str) -> DataFrame:
    """0/1 column: the key occurs among the names."""
    known = names.toDF(key).distinct().withColumn("_hit", F.lit(1))
    return df.join(known, key, "left").withColumn(alias, F.coalesce("_hit", F.lit(0))).drop("_hit")


def pci_level2(collisions: DataFrame, members: DataFrame, decisions: DataFrame, relations: DataFrame, gis: DataFrame, day: datetime.date) -> DataFrame:
    """Two-hop collisions, and the neighbours of every confusion, each with the next by name.

    ``members`` are the confusion members (serving, neighbour, band, pci).
    """
    serving = decisions.select("serving")
    two_hop = collisions.where(F.col("hop_type") == "2-hop").select("cell_a", "cell_b", "pci_a", "pci_b")
    hops = lookup_relations(two_hop, relations, gis)
    hops = _flag(_flag(hops, serving, "cell_a", "_bla"), serving, "cell_b", "_blb")
    hops = hops.select(
        F.col("cell_a").alias("from"), F.col("pci_a").alias("tosectorsc1"), F.col("pci_b").alias("tosectorsc2"),
        F.col("impact_traffic").alias("impact1"), F.lit(0.0).alias("impact2"),
        F.when(F.col("impact_relation") == "Y", 1).otherwise(0).alias("neighbour1"), F.lit(0).alias("neighbour2"),
        F.col("impact_distance").alias("_d1"), F.lit(0.0).alias("_d2"),
        F.col("cell_a").alias("first"), F.col("cell_b").alias("second"), F.greatest("_bla", "_blb").alias("l2_nr_bl_candidate"),
    )
    by_name = Window.partitionBy("serving", "band", "pci").orderBy("neighbour")
    pair = members.select("serving", "band", "pci", F.col("neighbour").alias("n1"), F.lead("neighbour").over(by_name).alias("n2")).where(F.col("n2").isNotNull())

    def side(name: str, tag: str) -> DataFrame:
        rows = pair.select(F.col("serving").alias("cell_a"), F.col(name).alias("cell_b")).distinct()
        return lookup_relations(rows, relations, gis).select(
            F.col("cell_a").alias("serving"), F.col("cell_b").alias(name),
            F.col("impact_traffic").alias(f"impact{tag}"), F.col("impact_distance").alias(f"_d{tag}"),
            F.when(F.col("impact_relation") == "Y", 1).otherwise(0).alias(f"neighbour{tag}"),
        )

    conf = pair.join(side("n1", "1"), ["serving", "n1"]).join(side("n2", "2"), ["serving", "n2"])
    conf = _flag(conf, serving, "serving", "l2_nr_bl_candidate").select(
        F.col("serving").alias("from"), F.col("pci").alias("tosectorsc1"), F.col("pci").alias("tosectorsc2"),
        "impact1", "impact2", "neighbour1", "neighbour2", "_d1", "_d2",
        F.col("n1").alias("first"), F.col("n2").alias("second"), "l2_nr_bl_candidate",
    )
    out = with_cell_ids(hops.unionByName(conf), gis, fromcilac="from", cilac="first", nextcilac="second")
    return out.select(
        report_date(day, REPORT_DATE_FORMAT).alias("insertdatetime"), "fromcilac", F.lit(0).alias("shoa"), "tosectorsc1",
        "impact1", "neighbour1", F.lit(0).alias("shob"), "tosectorsc2", "impact2", "neighbour2",
        F.round("_d1", 2).alias("distancefrom"), F.round("_d2", 2).alias("distanceto"), "cilac", "nextcilac",
        (F.col("neighbour1") * F.col("neighbour2")).alias("neibour2sector"), F.lit(0).alias("totalsho"), "l2_nr_bl_candidate",
    )


def pci_combined(collisions: DataFrame, members: DataFrame, decisions: DataFrame, relations: DataFrame, gis: DataFrame, day: datetime.date) -> DataFrame:
    """Collisions and confusions in one table, with the strongest and nearest neighbour."""
    serving = decisions.select("serving")
    either = serving.unionByName(decisions.select(F.col("neighbor").alias("serving")))
    hits = lookup_relations(collisions.select("cell_a", "cell_b", "pci_b", "hop_type"), relations, gis)
    hits = _flag(hits, either, "cell_a", "bl").select(
        F.col("cell_a").alias("from"), F.col("pci_b").alias("pci"), F.col("impact_traffic").alias("strongestsectorweight"), "bl",
        F.col("cell_b").alias("near"), F.col("cell_b").alias("strong"), F.col("impact_distance").alias("_dn"), F.col("impact_distance").alias("_ds"),
        F.col("impact_traffic").alias("totalweight"), F.when(F.col("hop_type") == "1-hop", "Yes").otherwise("No").alias("is_level1"),
    )
    rows = lookup_relations(members.select(F.col("serving").alias("cell_a"), F.col("neighbour").alias("cell_b"), "band", "pci"), relations, gis)
    carried = F.col("impact_traffic") > 0
    # The strongest or nearest of equals is the first by name.
    conf = rows.groupBy("cell_a", "band", "pci").agg(
        F.sum("impact_traffic").alias("totalweight"),
        F.min(F.when(carried, F.struct((-F.col("impact_traffic")).alias("w"), F.col("cell_b").alias("c"), F.col("impact_distance").alias("d")))).alias("_s"),
        F.min(F.struct(F.col("impact_distance").alias("d"), F.col("cell_b").alias("c"))).alias("_n"),
    )
    conf = _flag(conf, serving, "cell_a", "bl").select(
        F.col("cell_a").alias("from"), "pci", F.coalesce(-F.col("_s.w"), F.lit(0.0)).alias("strongestsectorweight"), "bl",
        F.col("_n.c").alias("near"), F.col("_s.c").alias("strong"), F.col("_n.d").alias("_dn"), F.coalesce("_s.d", F.lit(0.0)).alias("_ds"),
        "totalweight", F.lit("No").alias("is_level1"),
    )
    out = with_cell_ids(hits.unionByName(conf), gis, cilac="from", nearestcilac="near", strongestcilac="strong")
    return out.select(
        report_date(day, REPORT_DATE_FORMAT).alias("analysisdate"), "cilac", "pci", "strongestsectorweight", "bl", "nearestcilac", "strongestcilac",
        F.round("_dn", 2).alias("distance_near"), F.round("_ds", 2).alias("distance_strong"), "totalweight", "is_level1", F.lit(0).alias("regionid"),
    )
