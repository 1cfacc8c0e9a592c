"""Results that must not depend on a prefix, a first page of candidates or another band."""

import pytest
from pyspark.sql import functions as F

from cellscape.operators import combine, environment, feeders, gaps, hulls, interference, lowcoverage, outline, overshoot, pci, reports, undershoot, validate
from cellscape.params import EnvironmentRules, LowCoverage


def test_close_sites_do_not_hide_the_next(spark):
    """Forty sites within metres of each other: the nearest site far enough away still counts."""
    rows = [(f"c{i:02d}", 50.0 + i * 1e-5, 6.0) for i in range(40)] + [("far1", 50.02, 6.0), ("far2", 50.0, 6.02), ("far3", 50.02, 6.02)]
    gis = spark.createDataFrame(rows, "cell_name string, latitude double, longitude double")
    rules = EnvironmentRules()
    got = {r.cell_name: r.intersite_distance_km for r in environment.classify_environment(gis, rules).collect()}
    for name, lat, lon in rows:
        spacing = sorted(d for d in (rules.km_per_degree * ((lat - a) ** 2 + (lon - b) ** 2) ** 0.5 for _, a, b in rows) if d >= rules.min_km)[: rules.nearest_sites]
        assert got[name] == pytest.approx(sum(spacing) / len(spacing), abs=2e-3)


def test_repeated_cells_do_not_use_up_the_places(spark):
    points = [(f"p{i}", 50.0 + i * 1e-5, 6.0, "near" if i < 400 else f"cell{i % 7}") for i in range(900)]
    queries = spark.createDataFrame([(1, 50.0, 6.0), (2, 50.005, 6.0)], "qid int, llat double, llon double")
    df = spark.createDataFrame(points, "pid string, rlat double, rlon double, cell_name string")
    got = gaps.nearest_distinct(queries, df, 3).collect()
    for q, lat in ((1, 50.0), (2, 50.005)):
        best = {}
        for _, plat, _, cell in points:
            best[cell] = min(abs(plat - lat), best.get(cell, 9.0))
        want = sorted(best, key=best.get)[:3]
        assert [r.cell_name for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == want


def test_low_coverage_severity_is_per_band_and_uses_all_cells(spark):
    clusters = spark.createDataFrame(
        [("A", 1, 100, 1.0, 2), ("A", 2, 10, 1.0, 4), ("B", 3, 7, 1.0, 30)], "band string, cluster_id long, n_points long, area_km2 double, n_serving_cells long"
    )
    members = [("A", 1, "a1"), ("A", 2, "a2"), *[("B", 3, f"b{i:02d}") for i in range(30)]]
    weak = [("A", "a1", -120.0), ("A", "a2", -120.0), *[("B", f"b{i:02d}", -120.0 - (10 if i >= 10 else 0)) for i in range(30)]]
    p = LowCoverage()
    got = {r.cluster_id: r for r in lowcoverage.severity(
        clusters, spark.createDataFrame(members, "band string, cluster_id long, cell_name string"), spark.createDataFrame(weak, "band string, cell_name string, avg_rsrp double"), p
    ).collect()}
    assert got[3].avg_rsrp_dbm == pytest.approx((10 * -120 + 20 * -130) / 30)
    area, depth = min(1.0 / p.norm_area_km2, 1), lambda d: min(max(p.rsrp_dbm - d, 0) / p.norm_deficit_db, 1)
    want = lambda n, d, s: sum(w * x for w, x in zip(p.weights, (area, n, depth(d), s), strict=True))
    assert got[3].severity_score == pytest.approx(want(1.0, got[3].avg_rsrp_dbm, 0.0))  # the only cluster of its band
    assert got[1].severity_score == pytest.approx(want(1.0, -120.0, 0.5)) and got[2].severity_score == pytest.approx(want(0.0, -120.0, 0.0))


def test_regions_are_clipped_after_clustering(spark):
    bins = spark.createDataFrame([("L800", 1, x, y) for x in range(100_000, 100_010) for y in range(100_000, 100_010)], "band string, cluster_id long, ix long, iy long")
    keys = ["band", "cluster_id"]
    whole = outline.region_summary(bins, keys).join(outline.region_outlines(bins, keys), keys)
    box = whole.select("shape").first()["shape"][0].ring
    low, high, left, right = min(p.lat for p in box), max(p.lat for p in box), min(p.lon for p in box), max(p.lon for p in box)
    middle = (left + right) / 2
    ring = [(left - 1e-6, low - 1e-6), (middle, low - 1e-6), (middle, high + 1e-6), (left - 1e-6, high + 1e-6), (left - 1e-6, low - 1e-6)]
    boundary = spark.createDataFrame([(ring,)], "ring array<struct<lon:double,lat:double>>")
    cut, full = outline.clip_regions(whole, bins, keys, boundary).first(), whole.first()
    assert cut.n_points == full.n_points and 0.3 * full.area_km2 < cut.area_km2 < 0.6 * full.area_km2 and cut.centroid_lon < full.centroid_lon
    away = spark.createDataFrame([([(x + 5, y) for x, y in ring],)], "ring array<struct<lon:double,lat:double>>")
    assert outline.clip_regions(whole, bins, keys, away).count() == 0


def test_only_measured_bins_count_for_an_uptilt(spark):
    extension = spark.createDataFrame([("c", 1, 0, y) for y in range(10)] + [("d", 1, 5, 5)], "cell_name string, degree int, ix long, iy long")
    coverage = spark.createDataFrame([(0, y, f"s{k}") for y in range(6) for k in range(4 if y == 0 else 1)], "ix long, iy long, cell_name string")
    shares = hulls.expansion_interference(extension, coverage)
    got = {r.cell_name: r for r in shares.collect()}
    assert got.keys() == {"c"} and (got["c"].extension_bins, got["c"].interfering_bins) == (6, 1) and got["c"].interference_share == pytest.approx(1 / 6)
    grids = spark.createDataFrame([("c", 100)], "cell_name string, grid_count long")
    assert hulls.final_uptilt_candidates(shares, grids).count() == 1
    assert hulls.final_uptilt_candidates(shares, grids, max_share=0.1).count() == 0
    assert hulls.final_uptilt_candidates(shares, grids.withColumn("grid_count", F.lit(200))).count() == 0


def test_confusion_of_four_gives_three_rows(spark):
    cells = ["s", "a", "b", "c", "d"]
    gis = spark.createDataFrame([(n, 50.0 + i / 100, 6.0, i) for i, n in enumerate(cells)], "cell_name string, latitude double, longitude double, cell_cilac long")
    relations = spark.createDataFrame([("s", n, 10.0, 1.0, 0.0, 5.0, "Y") for n in cells[1:]], "cell_name string, to_cell_name string, weight double, traffic_data double, drops_voice double, distance double, neighbor_relation string")
    members = spark.createDataFrame([("s", n, "L800", 7) for n in cells[1:]], "serving string, neighbour string, band string, pci int")
    collisions = spark.createDataFrame([], "cell_a string, cell_b string, pci_a int, pci_b int, hop_type string")
    decisions = spark.createDataFrame([], "serving string, neighbor string")
    import datetime

    got = reports.pci_level2(collisions, members, decisions, relations, gis, datetime.date(2025, 3, 9)).collect()
    assert sorted((r.cilac, r.nextcilac) for r in got) == [(1, 2), (2, 3), (3, 4)]


def test_detectors_name_the_columns_they_lack(spark):
    cov = spark.createDataFrame([(1, 2, "a")], "ix int, iy int, cell_name string")
    shaped = spark.createDataFrame([("a", "L800", 1)], "cell_name string, band string, pci int")
    calls = [
        lambda: overshoot.detect_overshooting(cov, cov), lambda: undershoot.detect_undershooting(cov, cov), lambda: interference.detect_interference(cov),
        lambda: lowcoverage.detect_low_coverage(cov), lambda: gaps.detect_coverage_gaps(shaped), lambda: hulls.detect_pci_overlaps(shaped),
        lambda: hulls.detect_ca_imbalance(shaped), lambda: pci.build_network(cov), lambda: feeders.detect_crossed_feeders(cov, cov),
    ]
    for call, lacks in zip(calls, ["avg_rsrp", "avg_rsrp", "perc_grid_events", "event_count", "shape or ring", "shape or ring", "shape or ring", "to_cell_name", "weight"], strict=True):
        with pytest.raises(ValueError, match=lacks):
            call()


def test_a_pattern_that_reads_too_few_names_is_an_error(spark):
    ring = [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.0)]
    df = spark.createDataFrame([("X1", "L800", ring), ("SITE1LS1", "L800", ring), ("X2", "L1800", ring)], "cell_name string, band string, ring array<struct<lon:double,lat:double>>")
    with pytest.raises(ValueError, match="33.3%"):
        hulls.detect_ca_imbalance(df)
    assert hulls.detect_ca_imbalance(df.limit(0)).count() == 0


def test_input_quality_counts_every_problem(spark):
    cov = spark.createDataFrame([("A", -90.0, 3, 10.0), ("A", -20.0, 0, None), ("B", None, 2, 5.0)], "cell_name string, avg_rsrp double, event_count long, distance_to_cell double")
    gis = spark.createDataFrame([("A", 1.0, 2.0), ("C9", None, 2.0)], "cell_name string, latitude double, longitude double")
    ring = [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.0)]
    shaped = spark.createDataFrame([("A", ring), ("A", None), ("B", [(0.0, 0.0)] * 4)], "cell_name string, ring array<struct<lon:double,lat:double>>")
    got = {r.check: (r.rows, r.problems, r.ok) for r in validate.input_quality(cov, gis, shaped, r"^[A-Z]$", 0.9, None).collect()}
    assert got == {
        "signal_range": (3, 2, True), "event_count": (3, 1, True), "distance": (3, 1, True), "inventory_missing": (2, 1, True), "position": (2, 1, True),
        "name_pattern": (2, 1, False), "polygon_missing": (3, 1, True), "polygon_area": (2, 1, True), "polygon_repeated": (2, 1, True),
    }


def test_statistics_of_all_detectors(spark):
    over = spark.createDataFrame([("a", "L800", "HIGH", 1), ("b", "L800", "LOW", 2), ("c", None, "LOW", 2)], "cell_name string, band string, severity_category string, recommended_tilt_change int")
    areas = spark.createDataFrame([("L800", 1.5), ("L1800", 2.0)], "band string, area_km2 double")
    got = {(r.detector, r.dimension, r.value): (r.findings, r.mean_change, r.area_km2) for r in combine.detector_statistics(over=over, gaps=areas, none=areas.limit(0)).collect()}
    assert got == {
        ("over", "all", "all"): (3, pytest.approx(5 / 3), None), ("over", "severity_category", "HIGH"): (1, 1.0, None), ("over", "severity_category", "LOW"): (2, 2.0, None),
        ("over", "band", "L800"): (2, 1.5, None), ("over", "band", "unknown"): (1, 2.0, None), ("gaps", "all", "all"): (2, None, 3.5),
        ("gaps", "band", "L800"): (1, None, 1.5), ("gaps", "band", "L1800"): (1, None, 2.0), ("none", "all", "all"): (0, None, None),
    }
