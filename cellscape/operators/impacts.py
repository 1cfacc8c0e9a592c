"""Cell-to-cell relation enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellscape.functions import geo
from cellscape.functions.scoring import percentage
from cellscape.operators.quantile import group_quantiles

CO_SECTOR_DEG = 20.0
MIN_IMPACT_PCT, MAX_IMPACT_M = 2.0, 30_000.0
TECHNOLOGIES = ["gsm", "umts", "lte", "nsa", "sa"]


def enrich_impacts(relations: DataFrame, gis: DataFrame) -> DataFrame:
    """Inventory of both ends on every relation, with co-site and co-sector flags."""
    sides = ["site", "band", "tech", "latitude", "longitude", "bearing"]
    near = gis.select("cell_name", *[F.col(c).alias(f"cell_{c}") for c in sides])
    far = gis.select(F.col("cell_name").alias("to_cell_name"), *[F.col(c).alias(f"impact_{c}") for c in sides])
    kept = relations.select("cell_name", "to_cell_name", "traffic_data", "drops_voice")
    out = kept.where(F.col("cell_name") != F.col("to_cell_name")).join(near, "cell_name").join(far, "to_cell_name")
    turn = geo.angle_diff(F.col("cell_bearing"), F.col("impact_bearing"))
    return out.withColumns({
        "co_site": F.when(F.col("cell_site") == F.col("impact_site"), "y").otherwise("n"),
        "co_sectored": F.when(turn <= CO_SECTOR_DEG, "y").otherwise("n"),
        "tech_band": F.concat_ws("_", "cell_tech", "cell_band"),
        "impact_tech_band": F.concat_ws("_", "impact_tech", "impact_band"),
    })


def relation_shares(enriched: DataFrame) -> DataFrame:
    """Share of each relation in its cell's traffic, in percent."""
    totals = enriched.groupBy("cell_name").agg(F.sum("traffic_data").alias("total_cell_traffic_data"))
    out = enriched.join(totals, "cell_name")
    return out.withColumn("relation_impact_pct", percentage(F.col("traffic_data"), F.col("total_cell_traffic_data")))


def technology_shares(enriched: DataFrame, tech_bands: list[str]) -> DataFrame:
    """Per cell: share of its traffic by the other end's technology and technology-band."""

    def part(condition):
        return F.sum(F.when(condition, F.col("traffic_data")))

    whole = F.sum("traffic_data")
    return enriched.groupBy("cell_name").agg(
        whole.alias("total_cell_traffic_data"),
        *[percentage(part(F.col("impact_tech") == t), whole).alias(f"total_{t}_impact_pct") for t in TECHNOLOGIES],
        *[percentage(part(F.col("impact_tech_band") == b), whole).alias(f"total_{b}_impact_pct") for b in tech_bands],
    )


def neighbour_distances(shares: DataFrame) -> DataFrame:
    """Relations with distance and angles both ways, and the cell's furthest and median neighbour."""
    a = (F.col("cell_latitude"), F.col("cell_longitude"))
    b = (F.col("impact_latitude"), F.col("impact_longitude"))
    out = shares.withColumns({
        "distance": geo.haversine_m(*a, *b),
        "angle_cell_to_impact": geo.bearing_deg(*a, *b),
        "angle_impact_to_cell": geo.bearing_deg(*b, *a),
    }).withColumns({
        "cell_azimuth_diff": geo.angle_diff(F.col("angle_cell_to_impact"), F.col("cell_bearing")),
        "impact_azimuth_diff": geo.angle_diff(F.col("angle_impact_to_cell"), F.col("impact_bearing")),
    })
    strong = out.where((F.col("relation_impact_pct") >= MIN_IMPACT_PCT) & (F.col("distance") <= MAX_IMPACT_M))
    furthest = strong.groupBy("cell_name").agg(F.max("distance").alias("max_neigh_distance"))
    median = group_quantiles(
        strong.where(F.col("co_site") == "n"), ["cell_name"], "distance", {"median_neigh_distance": 0.5}, 10.0
    )
    return out.join(furthest, "cell_name", "left").join(median, "cell_name", "left")


def site_tech_bands(gis: DataFrame) -> DataFrame:
    """Distinct technology-bands of each site; bounded by the number of bands in use."""
    return gis.groupBy("site").agg(F.sort_array(F.collect_set(F.concat_ws("_", "tech", "band"))).alias("tech_bands"))
