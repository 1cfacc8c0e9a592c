"""Views over the findings of several detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.functions import lattice
from cellscape.functions.scoring import ratio
from cellscape.functions.text import band_from_cell
from cellscape.operators.spatial import radius_join

UNIFIED = ["detector", "cell_name", "band", "severity_category", "severity_score", "action"]


def detector_counts(**findings: DataFrame) -> DataFrame:
    """Number of rows per detector."""
    parts = [df.agg(F.lit(name).alias("detector"), F.count(F.lit(1)).alias("findings")) for name, df in findings.items()]
    return reduce(DataFrame.unionByName, parts)


def severity_statistics(findings: DataFrame) -> DataFrame:
    """Counts by severity, band and environment, each alone and overall; the overall count is 0 without findings."""
    dims = [c for c in ("severity_category", "band", "environment") if c in findings.columns]
    whole = F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))
    sets = F.array(
        whole,
        *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dims],
    )
    rows = findings.select(sets.alias("_sets"), F.lit(1).cast("long").alias("_n"))
    # one row of count 0 keeps the overall count where nothing was found
    none = findings.sparkSession.range(1).select(F.array(whole).alias("_sets"), F.lit(0).cast("long").alias("_n"))
    counted = rows.unionByName(none).select(F.explode("_sets").alias("s"), "_n")
    return counted.groupBy("s.dimension", "s.value").agg(F.sum("_n").alias("findings"))


def detector_statistics(**findings: DataFrame) -> DataFrame:
    """Findings of every detector by severity, band and environment and in all, with mean tilt change and area.

    (detector, dimension, value, findings, mean_change, area_km2).  The mean is of ``recommended_tilt_change`` or
    ``recommended_uptilt_deg`` and the area the sum of ``area_km2``, null for detectors without them.  A detector without
    findings has one row of count 0.
    """
    parts = []
    for name, df in findings.items():
        dims = [c for c in ("severity_category", "band", "environment") if c in df.columns]
        change = next((F.col(c).cast("double") for c in ("recommended_tilt_change", "recommended_uptilt_deg") if c in df.columns), F.lit(None).cast("double"))
        area = F.col("area_km2").cast("double") if "area_km2" in df.columns else F.lit(None).cast("double")
        pair = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
        sets = F.array(*[pair(d, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))) for d in dims]) if dims else F.array().cast("array<struct<dimension:string,value:string>>")
        figures = [F.count("_one").alias("findings"), F.avg("_change").alias("mean_change"), F.sum("_area").alias("area_km2")]
        rows = df.select(F.lit(1).alias("_one"), change.alias("_change"), area.alias("_area"), sets.alias("_sets"))
        whole = rows.agg(*figures).select(F.lit("all").alias("dimension"), F.lit("all").alias("value"), "findings", "mean_change", "area_km2")
        split = rows.select("*", F.explode("_sets").alias("_s")).groupBy("_s.dimension", "_s.value").agg(*figures)
        parts.append(whole.unionByName(split).select(F.lit(name).alias("detector"), "*"))
    return reduce(DataFrame.unionByName, parts)


def unified_rows(findings: DataFrame, detector: str, action: Column, cell: str = "cell_name") -> DataFrame:
    """Findings of one detector in the common schema."""
    band = F.col("band") if "band" in findings.columns else band_from_cell(F.col(cell))
    return findings.select(
        F.lit(detector).alias("detector"),
        F.col(cell).alias("cell_name"),
        band.alias("band"),
        F.col("severity_category"),
        F.col("severity_score").cast("double").alias("severity_score"),
        action.cast("string").alias("action"),
    )


def unified_recommendations(overshooters=None, undershooters=None, collisions=None, imbalance=None, feeders=None, confusions=None, blacklist=None) -> DataFrame:
    """One list of recommendations over all detectors.

    A confusion is listed with its number of neighbours; their names are rows of ``pci.confusion_members``.  Blacklist
    entries have no score and the lowest class but one, as they need a review only.
    """
    parts = []
    if confusions is not None:
        action = F.format_string("separate %d neighbours with identity %d", F.col("group_size").cast("int"), F.col("confusion_pci").cast("int"))
        parts.append(unified_rows(confusions, "pci_confusion", action, "serving"))
    if blacklist is not None:
        rated = blacklist.withColumns({"severity_category": F.lit("LOW"), "severity_score": F.lit(None).cast("double")})
        parts.append(unified_rows(rated, "pci_blacklist", F.concat(F.lit("blacklist "), "neighbor", F.lit(": "), "reason"), "serving"))
    if overshooters is not None:
        parts.append(unified_rows(overshooters, "overshooting", F.format_string("downtilt %d deg", F.col("recommended_tilt_change").cast("int"))))
    if undershooters is not None:
        parts.append(unified_rows(undershooters, "undershooting", F.format_string("uptilt %d deg", F.col("recommended_uptilt_deg").cast("int"))))
    if collisions is not None:
        parts.append(unified_rows(collisions, "pci", F.concat(F.lit("change identity: "), "conflict_type", F.lit(" with "), "cell_b"), "cell_a"))
    if imbalance is not None:
        band = imbalance.withColumn("band", F.col("capacity_band"))
        parts.append(unified_rows(band, "ca_imbalance", F.col("recommendation"), "capacity_cell_name"))
    if feeders is not None:
        odd = feeders.where(F.col("confidence_level") != "NONE")
        parts.append(unified_rows(odd, "crossed_feeders", F.col("recommendation")))
    return reduce(DataFrame.unionByName, parts)


def flag_bins(coverage: DataFrame, **flagged: DataFrame) -> DataFrame:
    """A boolean column per set of flagged (cell, bin) rows."""
    for name, bins in flagged.items():
        known = bins.select("cell_name", "ix", "iy").distinct().withColumn(name, F.lit(True))
        coverage = coverage.join(known, ["cell_name", "ix", "iy"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return coverage


def issue_matrix(cells: DataFrame, **issues: DataFrame) -> DataFrame:
    """Yes or No per cell and issue."""
    out = cells.select("cell_name").distinct()
    for name, df in issues.items():
        known = df.select("cell_name").distinct().withColumn(name, F.lit("Yes"))
        out = out.join(known, "cell_name", "left").withColumn(name, F.coalesce(name, F.lit("No")))
    count = sum((F.when(F.col(n) == "Yes", 1).otherwise(0) for n in issues), F.lit(0))
    return out.withColumn("n_issues", count)


def issue_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in both sets, in one only, and the shares of the union."""
    left = a.select("cell_name").distinct().withColumn("_a", F.lit(1))
    right = b.select("cell_name").distinct().withColumn("_b", F.lit(1))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = left.join(right, "cell_name", "full").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(both, 1)).alias("both"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
    )
    return out.withColumn("both_pct", F.round(ratio(F.col("both"), F.col("total")) * 100, 2))


def market_contributors(gis: DataFrame, radius_m: float = 15_000.0) -> DataFrame:
    """Cells of another market within reach of each cell, one row per pair."""
    left = gis.select("cell_name", "market", F.col("latitude").alias("llat"), F.col("longitude").alias("llon"))
    right = gis.select(F.col("cell_name").alias("other_cell"), F.col("market").alias("other_market"), F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"))
    pairs = radius_join(left, right, radius_m).where(F.col("market") != F.col("other_market"))
    return pairs.select("cell_name", "market", "other_cell", "other_market", "distance_m")


def first_tilt_per_cell(recommendations: DataFrame, change: str) -> DataFrame:
    """One tilt change per cell: the one with the highest score, else the largest."""
    return recommendations.groupBy("cell_name").agg(F.max_by(change, F.struct("severity_score", change)).alias(change))


def cell_bin_documents(coverage: DataFrame, highlight: DataFrame | None = None, size: int = 5000) -> DataFrame:
    """Bins of every cell as JSON lists with bounds, cut into documents of about ``size`` bins."""
    rows = coverage.select("cell_name", "ix", "iy", "avg_rsrp", "event_count", "distance_to_cell")
    if highlight is not None:
        rows = flag_bins(rows, highlighted=highlight)
    else:
        rows = rows.withColumn("highlighted", F.lit(False))
    counts = rows.groupBy("cell_name").agg(F.count(F.lit(1)).alias("_n"))
    pieces = F.ceil(F.col("_n") / F.lit(float(size))).cast("long")
    rows = rows.join(counts, "cell_name").withColumn("document", F.pmod(F.xxhash64("ix", "iy"), pieces).cast("int"))
    item = F.struct(
        "ix", "iy", lattice.encode(F.col("ix"), F.col("iy")).alias("grid"), lattice.bounds(F.col("ix"), F.col("iy")).alias("bounds"),
        "avg_rsrp", "event_count", "distance_to_cell", "highlighted",
    )
    out = rows.groupBy("cell_name", "document").agg(F.count(F.lit(1)).alias("n_bins"), F.array_sort(F.collect_list(item)).alias("bins"))
    return out.select("cell_name", "document", "n_bins", F.to_json("bins").alias("json"))
