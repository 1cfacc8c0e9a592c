"""Urban, suburban and rural classes from the spacing of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellscape.operators.spatial import knn_join

from cellscape.params import DEFAULT_ENVIRONMENT, EnvironmentRules
from cellscape.session import cut_lineage


def classify_environment(gis: DataFrame, rules: EnvironmentRules = EnvironmentRules()) -> DataFrame:
    """Every cell with its site, mean distance to the nearest sites and class.

    Distances are planar degrees times a constant; sites closer than ``min_km`` are passed
    over, however many there are: ``candidates`` is only the number looked at first.
    """
    keyed = gis.select(
        "cell_name",
        "latitude",
        "longitude",
        F.round("latitude", 6).alias("_y"),
        F.round("longitude", 6).alias("_x"),
    )
    sites = keyed.groupBy("_y", "_x").agg(F.min(F.struct("latitude", "longitude")).alias("_p"))
    queries = sites.select(F.struct("_y", "_x").alias("qid"), F.col("_p.latitude").alias("llat"), F.col("_p.longitude").alias("llon"))
    points = queries.toDF("pid", "rlat", "rlon")
    total, looked, spacing = points.count(), rules.candidates, None
    while True:
        near = knn_join(queries, points, looked, "planar").where(F.col("rank") > 1)
        near = near.withColumn("_km", F.col("distance") * rules.km_per_degree).where(F.col("_km") >= rules.min_km)
        order = Window.partitionBy("qid").orderBy("rank")
        kept = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rules.nearest_sites)
        means = cut_lineage(kept.groupBy("qid").agg(F.avg("_km").alias("_mean"), F.count(F.lit(1)).alias("_c")))
        means_now = means if looked >= total else means.where(F.col("_c") >= rules.nearest_sites)
        spacing = means_now if spacing is None else spacing.unionByName(means_now)
        if looked >= total:
            break
        # sites whose nearest are all too close look among more
        queries = cut_lineage(queries.join(means_now, "qid", "left_anti"))
        if queries.isEmpty():
            break
        looked *= 8
    spacing = spacing.select(F.col("qid._y").alias("_y"), F.col("qid._x").alias("_x"), "_mean")
    mean = F.coalesce("_mean", F.lit(rules.isolated_km))
    name = F.when(mean <= rules.urban_km, "URBAN").when(mean <= rules.suburban_km, "SUBURBAN").otherwise("RURAL")
    return keyed.join(spacing, ["_y", "_x"], "left").select(
        "cell_name",
        "latitude",
        "longitude",
        F.concat_ws("_", F.col("_y").cast("string"), F.col("_x").cast("string")).alias("site_key"),
        F.round(mean, 3).alias("intersite_distance_km"),
        name.alias("environment"),
    )


def attach_environment(df: DataFrame, environment: DataFrame | None) -> DataFrame:
    """Add environment and intersite distance; unknown cells are suburban."""
    if environment is None:
        return df.withColumns({
            "environment": F.lit(DEFAULT_ENVIRONMENT), "intersite_distance_km": F.lit(None).cast("double")
        })
    known = environment.select("cell_name", F.upper("environment").alias("environment"), "intersite_distance_km")
    out = df.join(known, "cell_name", "left")
    return out.withColumn("environment", F.coalesce("environment", F.lit(DEFAULT_ENVIRONMENT)))


def choose_environment(gis: DataFrame, supplied: DataFrame | None, rules: EnvironmentRules = EnvironmentRules()) -> DataFrame:
    """A supplied table wins; otherwise the classes are derived from the inventory."""
    return supplied if supplied is not None else classify_environment(gis, rules)
