"""How many cells compete for each bin of a band; shared by the shoot detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellscape.operators.quantile import group_quantiles

BIN_BAND = ["ix", "iy", "band"]


def reference_level(coverage: DataFrame, quantile: float) -> DataFrame:
    """Per bin and band: the reference signal level."""
    return group_quantiles(coverage, BIN_BAND, "avg_rsrp", {"p90_rsrp_in_grid": quantile}, 0.25)


def with_reference_level(rows: DataFrame, coverage: DataFrame, quantile: float) -> DataFrame:
    """``rows`` with the reference level that all of ``coverage`` gives their bin and band."""
    return rows.join(reference_level(coverage, quantile), BIN_BAND, "left")


def competition_counts(rows: DataFrame, threshold_db: float) -> DataFrame:
    """Competing cells, competing rows and traffic per bin and band.

    A row competes when its signal is within ``threshold_db`` of the reference level.
    """
    competing = F.round(F.col("p90_rsrp_in_grid") - F.col("avg_rsrp"), 9) <= threshold_db
    per_cell = rows.groupBy(*BIN_BAND, "cell_name").agg(
        F.sum(F.when(competing, 1).otherwise(0)).alias("_rows"), F.sum("event_count").alias("_events")
    )
    return per_cell.groupBy(*BIN_BAND).agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.sum(F.when(F.col("_rows") > 0, 1).otherwise(0)).alias("competing_cells"),
        F.sum("_rows").alias("competing_rows"),
        F.sum("_events").alias("grid_total_traffic"),
    )
