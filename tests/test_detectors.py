"""Hand-made cases with known outcomes for every detector."""

import math

import pytest
from pyspark.sql import functions as F

from cellscape import params as P
from cellscape.functions import antenna, geo, lattice, rings, scoring
from cellscape.operators import (
    competition, environment, feeders, gaps, hulls, interference, lowcoverage, overshoot, pci, rootcause, undershoot,
)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_candidates_and_traffic(spark):
    rows = [(1, 1, "1", 1000.0, 100), (2, 1, "1", 3000.0, 80), (3, 1, "1", 5000.0, 60), (1, 1, "2", 2000.0, 1), (2, 1, "2", 6000.0, 1), (3, 1, "2", 12000.0, 1), (1, 1, "3", 1500.0, 1), (2, 1, "3", 7500.0, 1)]
    cov = spark.createDataFrame(rows, "ix int, iy int, cell_name string, distance_to_cell double, event_count long")
    stats = {r.cell_name: r for r in undershoot.cell_statistics(cov).where("max_distance_m <= 8000").collect()}
    assert set(stats) == {"1", "3"}
    assert (stats["1"].max_distance_m, stats["1"].total_traffic, stats["1"].total_grids) == (5000.0, 240, 3)


def test_competition_counts(spark):
    rows = [(1, "1", -70.0), (1, "2", -72.0), (1, "3", -90.0), (2, "1", -75.0), (2, "2", -100.0), (3, "3", -80.0)]
    cov = spark.createDataFrame([(x, 0, "B", c, r, 1) for x, c, r in rows], "ix int, iy int, band string, cell_name string, avg_rsrp double, event_count long")
    levelled = competition.with_reference_level(cov, cov, 0.9)
    level = {r.ix: r.p90_rsrp_in_grid for r in levelled.collect()}
    assert level[1] == pytest.approx(-70.4) and level[2] == pytest.approx(-77.5)
    got = {r.ix: r.competing_rows for r in competition.competition_counts(levelled, 7.5).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_uptilt_gain_matches_the_formula(spark):
    def gain(d, tilt, h, n):
        e = antenna.distance_after_uptilt(F.lit(d), F.lit(tilt), F.lit(h), n, 3.5)
        return (one(spark, e.alias("d")).d - d) / d if d else one(spark, e.alias("d")).d

    assert gain(5000.0, 8.0, 30.0, 1.0) == pytest.approx(0.306607, abs=1e-5)
    assert gain(5000.0, 8.0, 30.0, 2.0) == pytest.approx(0.644600, abs=1e-5)
    assert gain(5000.0, 0.0, 30.0, 1.0) == 0 and gain(5000.0, 8.0, -1.0, 1.0) == 0 and gain(0.0, 8.0, 30.0, 1.0) == 0
    row = one(spark, antenna.vertical_attenuation(F.lit(5.0), F.lit(5.0)).alias("a"), antenna.vertical_attenuation(F.lit(90.0), F.lit(0.0)).alias("b"))
    assert (row.a, row.b) == (0, 30)


def test_circular_mean_and_severity(spark):
    def mean(pairs):
        df = spark.createDataFrame(pairs, "a double, w double")
        s, c = geo.circular_mean_terms(F.col("a"), F.col("w"))
        return df.agg(geo.circular_mean(F.sum(s), F.sum(c), F.sum("w")).alias("m")).first().m

    assert mean([(80.0, 1.0), (100.0, 1.0)]) == pytest.approx(90)
    assert math.isclose(math.cos(math.radians(mean([(350.0, 1.0), (10.0, 1.0)]))), 1, abs_tol=1e-9)
    assert mean([(0.0, 3.0), (90.0, 1.0)]) < 45
    assert mean([(0.0, 0.0)]) is None
    df = spark.createDataFrame([(x,) for x in (0.8, 0.6, 0.4, 0.2, 0.1)], "s double")
    assert [r.c for r in df.select(scoring.severity_category(F.col("s")).alias("c")).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MINIMAL"]
    assert df.select(scoring.severity_category(F.col("s"), strict=True).alias("c")).first().c == "HIGH"


def _shooting_network(spark):
    """One cell reaching 9 km over bins that four near cells serve better."""
    rows = []
    for i in range(100):
        d = 100.0 + 90 * i
        rows.append((i, 0, "FAR", "L800", -75.0 - i * 0.3, 10, d))
        for c in range(4):
            rows.append((i, 0, f"N{c}", "L800", -98.0 - c * 0.1, 10, 2500.0 + (10 * i if i > 50 else 0) + 100 * c))
    cov = spark.createDataFrame(rows, "ix int, iy int, cell_name string, band string, avg_rsrp double, event_count long, distance_to_cell double")
    gis = spark.createDataFrame([(c, "L800", 52.0, -8.0, 4.0, 1.0, 30.0) for c in ("FAR", "N0", "N1", "N2", "N3")], "cell_name string, band string, latitude double, longitude double, tilt_elc double, tilt_mech double, antenna_height double")
    return cov, gis


def test_overshooting_finds_the_far_cell(spark):
    cov, gis = _shooting_network(spark)
    p = P.Overshoot(min_overshooting_grids=5, percentage_overshooting_grids=0.05, interference_threshold_db=40.0, min_cell_count_in_grid=1)
    found = overshoot.detect_overshooting(cov, gis, p)
    rows = found.cells.collect()
    assert [r.cell_name for r in rows] == ["FAR"]
    row = rows[0]
    assert row.total_grids == 100 and row.overshooting_grids == 15
    assert row.recommended_tilt_change in (1, 2) and 0 <= row.severity_score <= 1
    assert row.new_interference_grids == row.overshooting_grids - row.removed_interference_grids
    unknown = overshoot.detect_overshooting(cov, gis, p, None, {e: p for e in ("URBAN", "SUBURBAN", "RURAL")})
    assert [(r.cell_name, r.environment) for r in unknown.cells.collect()] == [("FAR", "SUBURBAN")]


def test_environment_of_a_small_town(spark):
    sites = [(f"C{i}", 52.0 + 0.006 * i, -8.0) for i in range(4)] + [("R", 53.0, -9.0)]
    got = {r.cell_name: r for r in environment.classify_environment(spark.createDataFrame(sites, "cell_name string, latitude double, longitude double")).collect()}
    assert got["C1"].environment == "URBAN" and got["C1"].intersite_distance_km == pytest.approx((0.666 + 0.666 + 1.332) / 3, abs=1e-3)
    assert got["R"].environment == "RURAL"
    alone = environment.classify_environment(spark.createDataFrame([("A", 52.0, -8.0)], "cell_name string, latitude double, longitude double")).first()
    assert (alone.environment, alone.intersite_distance_km) == ("SUBURBAN", 2.0)


def _feeder_case(spark, edges):
    gis = [("A", "S", "L800", 0.0), ("B", "S", "L800", 120.0), ("C", "S", "L800", 240.0)]
    place = {"N": (52.05, -8.0), "SE": (51.975, -7.93), "SW": (51.975, -8.07)}
    cells = [(n, s, b, a, 65.0, 52.0, -8.0) for n, s, b, a in gis]
    cells += [(f"{k}{i}", f"{k}{i}", "L800", 0.0, 65.0, lat, lon) for k, (lat, lon) in place.items() for i in range(3)]
    inventory = spark.createDataFrame(cells, "cell_name string, site string, band string, bearing double, hbw double, latitude double, longitude double")
    rel = [(c, f"{k}{i}", 5000.0, "L800", "L800", "n", "n", w) for c, k in edges for i, w in enumerate((50.0, 40.0, 30.0))]
    relations = spark.createDataFrame(rel, "cell_name string, to_cell_name string, distance double, band string, to_band string, intra_site string, intra_cell string, weight double")
    out = feeders.detect_crossed_feeders(relations, inventory, P.Feeders(anomaly_relations=3))
    return {r.cell_name: r.confidence_level for r in out.cells.collect()}, out.pairs.collect()


def test_feeders(spark):
    levels, pairs = _feeder_case(spark, [("A", "SE"), ("B", "N")])
    assert levels == {"A": "HIGH_POTENTIAL_SWAP", "B": "HIGH_POTENTIAL_SWAP"}
    assert [(p.cell_a, p.cell_b) for p in pairs] == [("A", "B")]
    assert _feeder_case(spark, [("A", "SE")])[0] == {"A": "SINGLE_ANOMALY"}
    levels, pairs = _feeder_case(spark, [("A", "SW"), ("B", "SW")])
    assert levels == {"A": "POSSIBLE_SWAP", "B": "POSSIBLE_SWAP"} and not pairs
    assert _feeder_case(spark, [("A", "N")])[0] == {"A": "NONE"}


def test_blacklist_stops_before_the_last_member(spark):
    rel = [("S", n, 5, 10, "L800", "L800", w, 1000.0, "n", "n") for n, w in (("A", 0.0), ("B", 0.0), ("C", 0.0))]
    rel += [("S", f"X{i}", 5, 20 + i, "L800", "L800", 9.0, 1000.0, "n", "n") for i in range(3)]
    rel += [("S", "BAD", 5, 504, "L800", "L800", 9.0, 1000.0, "n", "n"), ("S", "S", 5, 5, "L800", "L800", 9.0, 0.0, "n", "n")]
    relations = spark.createDataFrame(rel, "cell_name string, to_cell_name string, pci int, to_pci int, band string, to_band string, weight double, distance double, intra_site string, intra_cell string")
    net = pci.build_network(relations)
    assert {r.neighbour for r in net.edges.collect()} == {"A", "B", "C", "X0", "X1", "X2"}
    conf = pci.detect_confusions(net).collect()
    assert [(r.serving, r.confusion_pci, r.group_size, r.neighbors) for r in conf] == [("S", 10, 3, "A,B,C")]
    decisions = pci.suggest_blacklist(net)
    assert {(r.neighbor, r.reason) for r in decisions.collect()} == {("A", "AUTO_DEAD_RELATION"), ("B", "AUTO_DEAD_RELATION")}
    after = pci.apply_blacklist(relations, decisions)
    assert {r.neighbour for r in after.edges.collect()} == {"C", "X0", "X1", "X2"}


def square(lon, lat, side=0.02):
    pts = [(0, 0), (side, 0), (side, side), (0, side), (0, 0)]
    return [{"lon": lon + x, "lat": lat + y} for x, y in pts]


def test_outline_conflicts(spark):
    def run(rows, with_site=False, **kw):
        schema = f"cell_name string, band string, pci int, ring {rings.RING_TYPE}" + (", site string" if with_site else "")
        return hulls.detect_pci_overlaps(spark.createDataFrame(rows, schema), P.PciOverlap(**kw)).collect()

    near, far = square(-8.5, 53.0), square(-8.5, 53.005)
    hit = run([("a", "L800", 100, near), ("b", "L800", 100, far)])
    assert [r.conflict_type for r in hit] == ["exact"] and hit[0].overlap_percentage == pytest.approx(75, abs=0.1)
    assert not [r for r in run([("a", "L800", 100, near), ("b", "L800", 200, far)]) if r.conflict_type == "exact"]
    assert not run([("a", "L800", 100, near), ("b", "L800", 100, square(-8.5, 54.0))])
    assert [r.conflict_type for r in run([("a", "L800", 100, near), ("b", "L800", 103, far)])] == ["mod3"]
    assert not run([("a", "L800", 100, near, "S"), ("b", "L800", 100, far, "S")], with_site=True)


def test_carrier_aggregation(spark):
    rows = []
    for n, side in ((1, 0.5), (2, 0.8), (3, 0.95)):
        rows.append((f"SITE00{n}L800S1", "L800", square(-8.5, 53.0, 0.02)))
        rows.append((f"SITE00{n}L1800S1", "L1800", square(-8.5, 53.0, 0.02 * side)))
    rows.append(("SITE009L800S1", "L800", square(-8.5, 53.0)))
    out = hulls.detect_ca_imbalance(spark.createDataFrame(rows, f"cell_name string, band string, ring {rings.RING_TYPE}")).collect()
    assert {r.site_sector: r.coverage_ratio for r in out} == {"SITE001_1": pytest.approx(0.25, abs=0.002), "SITE002_1": pytest.approx(0.64, abs=0.002)}


def test_coverage_gap_between_outlines(spark):
    def box(w, e, s, n):
        return [{"lon": x, "lat": y} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]

    rows = [("A", box(-8.50, -8.40, 51.90, 52.00)), ("B", box(-8.35, -8.25, 51.90, 52.00)), ("C", box(-8.45, -8.35, 51.85, 51.89))]
    df = spark.createDataFrame(rows, f"cell_name string, ring {rings.RING_TYPE}")
    found = gaps.detect_coverage_gaps(df, P.Gaps(eps_m=15_000.0, max_aspect=50.0))
    regions = found.gaps.collect()
    assert regions and max(r.area_km2 for r in regions) > 10
    inside = found.bins.withColumn("lon", lattice.ix_to_lon(F.col("ix"))).withColumn("lat", lattice.iy_to_lat(F.col("iy")))
    bad = ((F.col("lon") > -8.50) & (F.col("lon") < -8.40) | (F.col("lon") > -8.35) & (F.col("lon") < -8.25)) & (F.col("lat") > 51.90) & (F.col("lat") < 52.0)
    assert inside.where(bad).count() == 0
    strip = [{"lon": x, "lat": y} for x, y in ((-8.41, 51.80), (-8.34, 51.80), (-8.34, 51.95), (-8.41, 51.95), (-8.41, 51.80))]
    clipped = gaps.detect_coverage_gaps(df, P.Gaps(eps_m=15_000.0, max_aspect=50.0), boundary=spark.createDataFrame([(strip,)], f"ring {rings.RING_TYPE}"))
    assert clipped.bins.agg(F.max(lattice.iy_to_lat(F.col("iy")))).first()[0] < 51.95


def _interference_rows(spark):
    codes = ["gc7x9r7", "gc7x9re", "gc7x9rk", "gc7x9rs", "gc7x9r5", "gc7x9rd", "gc7x9r6", "gc7x9rf", "gc7x9r4", "gc7x9rh"]
    rows = [(g, f"C{c}", -95.0 + c - 2, "L1800", 50, 0.2) for g in codes for c in range(5)]
    df = spark.createDataFrame(rows, "grid string, cell_name string, avg_rsrp double, band string, event_count long, perc_grid_events double")
    spot = lattice.decode(F.col("grid"))
    return df.withColumn("_b", spot).select("*", "_b.ix", "_b.iy").drop("_b")


def test_interference_filters_and_density(spark):
    rows = interference.interfering_bins(_interference_rows(spark))
    assert rows.select("ix", "iy").distinct().count() == 10 and rows.count() == 50
    bins = {tuple(r) for r in rows.select("ix", "iy").distinct().collect()}
    for k in (1, 3):
        p = P.Interference(ring=k)
        kept = {tuple(r) for r in interference.dense_bins(rows, p).select("ix", "iy").distinct().collect()}
        near = {b: sum(max(abs(b[0] - c[0]), abs(b[1] - c[1])) <= k for c in bins) - 1 for b in bins}
        assert kept == {b for b in bins if near[b] > (2 * k + 1) ** 2 * 0.33}


def test_level_groups_split_beyond_the_width(spark):
    gaps_db = [0.0, 1.0, 4.9, 5.5, 6.0]
    rows = spark.createDataFrame([("L800", 1, 1, f"C{i}", g) for i, g in enumerate(gaps_db)], "band string, ix int, iy int, cell_name string, rsrp_dist_max double")
    got = {r.rsrp_dist_max: r.grid_cluster_no for r in interference.level_groups(rows).collect()}
    assert got == {0.0: 1, 1.0: 1, 4.9: 1, 5.5: 2, 6.0: 2}
    linked = interference.level_groups(rows, P.Interference(clustering="linked", linkage_width_db=1.0))
    assert {r.rsrp_dist_max: r.grid_cluster_no for r in linked.collect()} == {0.0: 1, 1.0: 1, 4.9: 2, 5.5: 2, 6.0: 2}


def test_root_cause_facts_match_brute_force(spark):
    cells = [("k", "a", 52.00, -8.00, 10.0, 2.0, 0.0, 80.0), ("k", "b", 52.01, -8.00, 350.0, 6.0, 0.0, 25.0), ("k", "c", 52.05, -8.02, 180.0, 7.0, 1.0, 25.0), ("k", "d", 52.05, -8.02, 181.0, 8.0, 1.0, 25.0)]
    gis = spark.createDataFrame([c[1:] for c in cells], "cell_name string, latitude double, longitude double, bearing double, tilt_elc double, tilt_mech double, antenna_height double")
    members = spark.createDataFrame([(c[0], c[1]) for c in cells], "cluster_id string, cell_name string")
    clusters = spark.createDataFrame([("k", 9, 4)], "cluster_id string, n_grids int, n_cells int")
    out = rootcause.analyse_root_causes(clusters, members, gis)
    row = out.clusters.first()

    def km(p, q):
        a, b = math.radians(p[2]), math.radians(q[2])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    pairs = [km(p, q) for i, p in enumerate(cells) for q in cells[i + 1 :]]
    assert row.min_cell_distance_km == 0 and row.avg_cell_distance_km == pytest.approx(sum(pairs) / 6)
    assert row.min_azimuth_diff_deg == 1.0
    assert {r.cell_name for r in out.converging.collect()} == {"a", "b", "c", "d"}
    assert list(row.causes) == ["tall_site_overshoot", "low_tilt", "very_close_proximity", "azimuth_convergence", "inconsistent_tilt"]
    assert (row.root_cause, row.priority) == ("tall_site_overshoot", "high")
    assert {r.cell_name: r.suggested_tilt for r in out.tilt_advice.collect()} == {"a": 3.1}


def test_low_coverage_region_and_advice(spark):
    ix0, iy0 = 124882, 103328
    rows = [(ix0 + x, iy0 + y, "C1", "L800", -121.0, 12, 3000.0) for x in range(8) for y in range(8)]
    cov = spark.createDataFrame(rows, "ix int, iy int, cell_name string, band string, avg_rsrp double, event_count long, distance_to_cell double")
    found = lowcoverage.detect_low_coverage(cov, None, P.LowCoverage(min_cluster_bins=4, min_area_km2=0.1), min_outline_km2=0.1)
    row = found.clusters.first()
    assert (row.n_points, row.n_serving_cells, row.serving_cells, row.confidence_category) == (64, 1, "C1", "MEDIUM")
    assert row.avg_rsrp_dbm == pytest.approx(-121) and row.rsrp_deficit_db == pytest.approx(6)
    lat, lon = row.centroid_lat, row.centroid_lon
    schema = "cell_name string, band string, latitude double, longitude double, tilt_elc double, tilt_mech double, antenna_height double"
    gis = spark.createDataFrame([("C1", "L800", lat + 0.02, lon, 6.0, 0.0, 30.0), ("C2", "L1800", lat, lon, 6.0, 0.0, 30.0), ("C3", "L800", lat + 0.01, lon, 0.0, 0.0, 30.0)], schema)
    advice = {r.recommended_cell: r for r in lowcoverage.recommend(found, gis, cov).collect()}
    assert set(advice) == {"C1", "C3"}
    assert advice["C1"].recommended_uptilt_deg == 2 and advice["C3"].note.startswith("PHYSICAL_CONSTRAINT")
    nowhere = spark.createDataFrame([("Z", "L800", 10.0, 10.0, 6.0, 0.0, 30.0)], schema)
    assert [r.note for r in lowcoverage.recommend(found, nowhere, cov).collect()] == ["NEW_SITE_REQUIRED"]


def test_impact_risk_of_the_worked_example(spark):
    rows = [("C", 500.0 + 100 * i, -100.0) for i in range(7)] + [("C", 1500.0, -115.0), ("C", 2000.0, -115.0), ("C", 2500.0, -115.0)]
    cov = spark.createDataFrame(rows, "cell_name string, distance_to_cell double, avg_rsrp double")
    cand = spark.createDataFrame([("L800", 1, "C", 2000.0, 6.0)], "band string, cluster_id int, cell_name string, distance_m double, current_tilt_deg double")
    assert lowcoverage.impact_risk(cand, cov).first().neighbor_impact_risk == "MEDIUM"


def test_hull_of_a_cell_drops_the_furthest_bins(spark):
    rows = [(124882 + i % 10, 103328 + i // 10, "C", 10.0 + i, 1) for i in range(50)] + [(125000, 103500, "C", 99999.0, 1)]
    cov = spark.createDataFrame(rows, "ix int, iy int, cell_name string, distance_to_cell double, event_count long")
    gis = spark.createDataFrame([("C", 51.9, -8.5)], "cell_name string, latitude double, longitude double")
    row = hulls.build_hulls(cov, gis).first()
    assert max(p.lon for p in row.ring) < -8.48 and row.sample_count == 51
