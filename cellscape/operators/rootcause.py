"""Why the cells of an interference cluster overlap, and what to change."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructType

from cellscape.functions import geo
from cellscape.params import RootCause
from cellscape.session import cut_lineage

# Causes from the most to the least telling, and those that alone mean high priority.
CAUSE_ORDER = ["tall_site_overshoot", "low_tilt", "very_close_proximity", "azimuth_convergence", "close_proximity", "inconsistent_tilt"]
URGENT = ["low_tilt", "very_close_proximity", "tall_site_overshoot"]
PIECE = 500


class RootCauses(NamedTuple):
    clusters: DataFrame
    tilt_advice: DataFrame
    converging: DataFrame


def tilt_facts(cells: DataFrame, p: RootCause = RootCause()) -> DataFrame:
    """Per cell of a cluster: total tilt, height-adjusted range and the tilt that would shorten it."""
    tilt = F.coalesce("tilt_elc", F.lit(0.0)) + F.coalesce("tilt_mech", F.lit(0.0))
    out = cells.withColumn("total_tilt", tilt)
    reach = F.col("antenna_height") / (F.tan(F.radians("total_tilt")) * 1000)
    usable = (F.col("antenna_height") > 0) & (F.col("total_tilt") >= p.min_tilt_deg)
    out = out.withColumn("effective_range_km", F.when(usable, reach))
    target = F.degrees(F.atan(F.col("antenna_height") / (p.target_range_km * 1000)))
    long_reach = F.coalesce(F.col("effective_range_km") > p.max_range_km, F.lit(False))
    return out.withColumns({
        "long_reach": long_reach,
        "tall_suggestion": F.when(long_reach & (target > F.col("total_tilt") + p.min_increase_deg), target),
        "low_tilt": F.col("total_tilt") < p.low_tilt_deg,
    })


def tilt_advice(facts: DataFrame, p: RootCause = RootCause()) -> DataFrame:
    """One row per cell that should tilt down."""
    low = F.col("low_tilt") & ~F.col("long_reach")
    suggestion = F.coalesce(
        "tall_suggestion", F.when(low, F.least(F.col("total_tilt") + 2, F.lit(p.high_tilt_deg)))
    )
    # Reasons of the output.
    reason = F.when(
        F.col("tall_suggestion").isNotNull(),
        F.format_string("Tall site (%.0fm) with low tilt reaching %.2fkm", "antenna_height", "effective_range_km"),
    ).otherwise("Low tilt causing coverage overshoot")
    return facts.withColumn("_s", suggestion).where(F.col("_s").isNotNull()).select(
        "cluster_id",
        "cell_name",
        F.lit("increase_tilt").alias("action"),
        F.round("total_tilt", 1).alias("current_tilt"),
        F.round("_s", 1).alias("suggested_tilt"),
        reason.alias("reason"),
    )


def azimuth_facts(cells: DataFrame, p: RootCause = RootCause()) -> tuple[DataFrame, DataFrame]:
    """Smallest azimuth difference per cluster, and the cells that have a close partner.

    The nearest azimuth is the previous or the next one on the circle, so distinct azimuths
    are put in order and neighbours compared; no pair of cells is formed.
    """
    spread = cells.where(F.col("bearing").isNotNull()).groupBy("cluster_id", "bearing").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("cluster_id").orderBy("bearing")
    whole = Window.partitionBy("cluster_id")
    ends = spread.withColumns({
        "_prev": F.coalesce(F.lag("bearing").over(order), F.max("bearing").over(whole) - 360),
        "_next": F.coalesce(F.lead("bearing").over(order), F.min("bearing").over(whole) + 360),
    })
    gap = F.least(F.col("bearing") - F.col("_prev"), F.col("_next") - F.col("bearing"))
    nearest = F.when(F.col("_n") >= 2, 0.0).when(gap < 360, gap)
    ends = ends.withColumn("nearest_azimuth_deg", nearest).select("cluster_id", "bearing", "nearest_azimuth_deg")
    least = ends.groupBy("cluster_id").agg(F.min("nearest_azimuth_deg").alias("min_azimuth_diff_deg"))
    close = ends.where(F.col("nearest_azimuth_deg") < p.azimuth_deg)
    converging = cells.join(close, ["cluster_id", "bearing"]).select("cluster_id", "cell_name", "bearing", "nearest_azimuth_deg")
    return least, converging


@F.pandas_udf(StructType().add("total", DoubleType()).add("least", DoubleType()))
def _piece_distances(
    alat: pd.Series, alon: pd.Series, an: pd.Series, blat: pd.Series, blon: pd.Series, bn: pd.Series
) -> pd.DataFrame:
    """Weighted sum and smallest positive value of the distances between two pieces, in km."""
    totals, least = [], []
    for row in zip(alat, alon, an, blat, blon, bn):
        a, o, m, b, q, n = (np.asarray(x, float) for x in row)
        a, o, b, q = np.radians(a), np.radians(o), np.radians(b), np.radians(q)
        h = np.sin((b - a[:, None]) / 2) ** 2 + np.cos(a)[:, None] * np.cos(b) * np.sin((q - o[:, None]) / 2) ** 2
        d = 2 * geo.EARTH_RADIUS_M / 1000 * np.arcsin(np.sqrt(h))
        totals.append(float(m @ d @ n))
        least.append(float(np.min(d, where=d > 0, initial=np.inf)))
    return pd.DataFrame({"total": totals, "least": least})


def distance_facts(cells: DataFrame) -> DataFrame:
    """Smallest and mean distance between the cells of a cluster.

    Cells at one place count as one weighted point; points travel in bounded pieces and only
    pairs of pieces become rows, each reduced to one sum and one minimum.
    """
    places = cells.groupBy("cluster_id", "latitude", "longitude").agg(F.count(F.lit(1)).alias("_n"))
    sizes = places.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("_places"), F.sum("_n").alias("_cells"), F.max("_n").alias("_most")
    )
    pieces = F.ceil(F.col("_places") / F.lit(float(PIECE)))
    packed = (
        places.join(sizes.select("cluster_id", "_places"), "cluster_id")
        .withColumn("_p", F.pmod(F.xxhash64("latitude", "longitude"), pieces))
        .groupBy("cluster_id", "_p")
        .agg(F.collect_list(F.struct("latitude", "longitude", "_n")).alias("_l"))
        .select("cluster_id", F.col("_l.latitude").alias("a"), F.col("_l.longitude").alias("o"), F.col("_l._n").alias("n"))
    )
    packed = cut_lineage(packed)
    pairs = packed.join(packed.toDF("cluster_id", "b", "q", "m"), "cluster_id")
    sums = pairs.withColumn("_d", _piece_distances("a", "o", "n", "b", "q", "m")).groupBy("cluster_id").agg(
        F.sum("_d.total").alias("_total"), F.min("_d.least").alias("_least")
    )
    n = F.col("_cells")
    out = sums.join(sizes, "cluster_id").where(n >= 2)
    least = F.when(F.col("_most") >= 2, 0.0).otherwise(F.col("_least"))
    return out.select(
        "cluster_id",
        least.alias("min_cell_distance_km"),
        (F.col("_total") / (n * (n - 1))).alias("avg_cell_distance_km"),
    )


def analyse_root_causes(clusters: DataFrame, members: DataFrame, gis: DataFrame, p: RootCause = RootCause()) -> RootCauses:
    """Causes, primary cause and priority per cluster, with advice per cell in side tables."""
    site = gis.select("cell_name", "latitude", "longitude", "bearing", "tilt_elc", "tilt_mech", "antenna_height")
    cells = cut_lineage(members.select("cluster_id", "cell_name").join(site, "cell_name"))
    facts = tilt_facts(cells, p)
    tilts = facts.groupBy("cluster_id").agg(
        F.avg("total_tilt").alias("avg_tilt_deg"),
        F.min("total_tilt").alias("min_tilt_deg"),
        F.max("total_tilt").alias("max_tilt_deg"),
        F.sum(F.when(F.col("low_tilt"), 1).otherwise(0)).alias("n_low_tilt_cells"),
        F.sum(F.when(F.col("long_reach"), 1).otherwise(0)).alias("n_long_reach_cells"),
        F.count("tall_suggestion").alias("_tall"),
    )
    azimuths, converging = azimuth_facts(cells, p)
    out = clusters.join(tilts, "cluster_id", "left").join(azimuths, "cluster_id", "left").join(
        distance_facts(cells), "cluster_id", "left"
    )
    out = out.withColumn("tilt_spread_deg", F.col("max_tilt_deg") - F.col("min_tilt_deg"))
    near = F.col("min_cell_distance_km")
    tests = {
        "tall_site_overshoot": F.col("_tall") > 0,
        "low_tilt": F.col("n_low_tilt_cells") > 0,
        "very_close_proximity": near < p.very_close_km,
        "azimuth_convergence": F.col("min_azimuth_diff_deg") < p.azimuth_deg,
        "close_proximity": (near >= p.very_close_km) & (near < p.close_km),
        "inconsistent_tilt": F.col("tilt_spread_deg") > p.tilt_spread_deg,
    }
    causes = F.array_compact(F.array(*[F.when(tests[c], F.lit(c)) for c in CAUSE_ORDER]))
    out = out.withColumn("causes", causes)

    def larger(limits):
        return (F.col("n_grids") > limits[0]) | (F.col("n_cells") > limits[1])

    def any_of(*names):
        return F.arrays_overlap("causes", F.array(*[F.lit(n) for n in names]))

    priority = (
        F.when(any_of(*URGENT) | larger(p.high_priority), "high")
        .when(larger(p.medium_priority) | any_of("azimuth_convergence", "close_proximity"), "medium")
        .otherwise("low")
    )
    out = out.withColumns({
        "root_cause": F.coalesce(F.get("causes", F.lit(0)), F.lit("undetermined")),
        "priority": priority,
    }).drop("_tall")
    return RootCauses(out, tilt_advice(facts, p), converging)
