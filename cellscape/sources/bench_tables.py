"""Radio tables derived from the star-schema test tables.

``supplier`` rows act as cells, (supplier, part) pairs in ``lineitem`` as (cell, bin)
measurements and ``lineitem`` rows as handovers between cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellscape.functions import geo, lattice
from cellscape.session import cut_lineage

IX0, IY0, COLUMNS = 124795, 103315, 50


def _prepared(build):
    """Derive a table once per session and scale; every query then scans the written table."""
    done: dict[tuple, DataFrame] = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in done:
            done[key] = cut_lineage(build(spark, sf_dir))
        return done[key]

    get.__doc__ = build.__doc__
    return get


@_prepared
def cell_gis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell."""
    s, g = "s_suppkey", "(s_suppkey div 6)"
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col(s).alias("cell_key"),
        F.expr(f"concat('S', lpad(cast({g} as string), 4, '0'))").alias("site"),
        F.expr(f"if(({s} div 3) % 2 = 0, 'L800', 'L1800')").alias("band"),
        F.expr(
            f"concat('S', lpad(cast({g} as string), 4, '0'), if(({s} div 3) % 2 = 0, 'L', 'H'), cast({s} % 3 + 1 as string))"
        ).alias("cell_name"),
        F.expr(f"cast(({s} * 17) % 30 as int)").alias("pci"),
        F.expr(f"51.90D + 0.012D * ({g} div 4) + 0.001D * (({g} * 37) % 7)").alias("latitude"),
        F.expr(f"-8.60D + 0.018D * ({g} % 4) + 0.001D * (({g} * 13) % 5)").alias("longitude"),
        F.expr(f"cast(120 * ({s} % 3) + ({g} * 7) % 30 as double)").alias("bearing"),
        F.lit(65.0).alias("hbw"),
        F.expr(f"cast(({s} * 5) % 9 as double)").alias("tilt_elc"),
        F.expr(f"cast(({s} * 3) % 4 as double)").alias("tilt_mech"),
        F.expr(f"cast(20 + ({s} * 7) % 26 as double)").alias("antenna_height"),
        F.expr(f"cast(40 + ({s} * 11) % 7 as double)").alias("tx_power"),
        F.expr(f"s_nationkey % 5").cast("string").alias("market"),
    )


@_prepared
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (cell, bin) with averaged signal and event count."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("event_count"),
        F.avg("l_discount").alias("_discount"),
        F.avg("l_tax").alias("_tax"),
        F.max("l_shipdate").alias("ts"),
    )
    bins = pairs.select(
        F.col("l_suppkey").alias("cell_key"),
        F.expr(f"cast({IX0} + l_partkey % {COLUMNS} as int)").alias("ix"),
        F.expr(f"cast({IY0} + l_partkey div {COLUMNS} as int)").alias("iy"),
        "event_count",
        "_discount",
        "_tax",
        "ts",
    ).withColumns({
        "latitude": lattice.iy_to_lat(F.col("iy")),
        "longitude": lattice.ix_to_lon(F.col("ix")),
    })
    cells = cell_gis(spark, sf_dir).select(
        "cell_key", "cell_name", "band", "bearing", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")
    )
    here = (F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
    out = bins.join(cells, "cell_key").withColumn("distance_to_cell", F.round(geo.haversine_m(*here), 1))
    return out.select(
        "ix",
        "iy",
        "cell_key",
        "cell_name",
        "band",
        F.round(
            -70.0 - 21.0 * F.log10(F.greatest(F.col("distance_to_cell"), F.lit(100.0)) / 100.0) - 150.0 * F.col("_discount"), 2
        ).alias("avg_rsrp"),
        F.round(-5.0 - 100.0 * F.col("_tax"), 2).alias("avg_rsrq"),
        F.round(15.0 - 400.0 * F.col("_tax"), 2).alias("avg_sinr"),
        "event_count",
        "distance_to_cell",
        "latitude",
        "longitude",
        F.round(geo.angle_diff(geo.bearing_deg(*here), F.col("bearing")), 2).alias("grid_bearing_diff"),
        "ts",
    )


@_prepared
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed handover counts between cells whose keys lie close together."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    step = F.expr("if(l_linenumber % 2 = 0, l_orderkey % 61 - 30, l_orderkey % 13 - 6)")
    hops = (
        lines.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + step).alias("b"), "l_quantity", "l_returnflag")
        .where("a <> b")
        .groupBy("a", "b")
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.sum("l_quantity").alias("traffic_data"),
            F.sum(F.expr("if(l_returnflag = 'R', 1, 0)")).alias("drops_voice"),
        )
    )
    cells = cell_gis(spark, sf_dir).select("cell_key", "cell_name", "site", "band", "pci", "latitude", "longitude")
    left = cells.toDF("a", "cell_name", "site", "band", "pci", "_lat", "_lon")
    right = cells.toDF("b", "to_cell_name", "to_site", "to_band", "to_pci", "_tlat", "_tlon")
    return hops.join(left, "a").join(right, "b").select(
        "cell_name",
        "to_cell_name",
        "pci",
        "to_pci",
        "band",
        "to_band",
        F.col("weight").cast("double").alias("weight"),
        F.round(geo.haversine_m(F.col("_lat"), F.col("_lon"), F.col("_tlat"), F.col("_tlon")), 1).alias("distance"),
        F.when(F.col("site") == F.col("to_site"), "y").otherwise("n").alias("intra_site"),
        F.lit("n").alias("intra_cell"),
        F.expr("if((a * 7 + b) % 4 = 0, 'N', 'Y')").alias("neighbor_relation"),
        "traffic_data",
        F.col("drops_voice").cast("double").alias("drops_voice"),
    )
