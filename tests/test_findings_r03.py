"""Findings of the third round."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cellscape import params as P
from cellscape.operators import combine, enrich, gaps, hulls, interference, validate
from cellscape.operators.spatial import knn_join


def test_rsrp_share_on_a_rounding_tie(spark):
    """51.33 of 120 is 0.42775, whose double lies just below; the SQL rounds the scaled value, which is on the tie."""
    rows = spark.createDataFrame([(1, 1, "a", -98.67), (1, 1, "b", -81.33)], "ix int, iy int, cell_name string, avg_rsrp double")
    got = {r.cell_name: r.perc_grid_events for r in enrich.rsrp_share(rows).collect()}
    assert got == {"a": 0.4278, "b": 0.5723}


def test_severity_statistics_without_findings(spark):
    """The SQL counts in all also where no detector found a cell: one row of 0."""
    def got(rows):
        found = spark.createDataFrame(rows, "cell_name string, band string, severity_category string")
        return sorted(tuple(r) for r in combine.severity_statistics(found).collect())

    assert got([]) == [("all", "all", 0)]
    assert got([("a", "L800", "HIGH"), ("b", None, "HIGH")]) == [
        ("all", "all", 2), ("band", "L800", 1), ("band", "unknown", 1), ("severity_category", "HIGH", 2),
    ]


def test_interference_shuffles_a_table_by_bin_no_more(spark):
    """All figures of a bin come from one partitioning; joins back per figure shuffled the whole table several times."""
    cells = [(0, 0, f"c{i}", "L800", -80.0 - i, 10, 0.2) for i in range(5)] + [(0, 1, "c0", "L800", -70.0, 90, 0.9), (0, 1, "c1", "L800", -99.0, 10, 0.1)]
    rows = spark.createDataFrame(cells, "ix int, iy int, cell_name string, band string, avg_rsrp double, event_count long, perc_grid_events double").repartition(3, "ix", "iy")
    close = interference.close_to_strongest(rows, P.Interference())
    plan = close._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    found = interference.interfering_bins(rows, P.Interference(min_cells=3))
    assert {(r.ix, r.iy, r.cell_name) for r in found.collect()} == {(0, 0, f"c{i}") for i in range(5)}


def test_outlines_of_conflict_pairs_are_not_broadcast(spark, tmp_path):
    shapes = spark.range(20).selectExpr("concat('c', id) cell_name", "array(named_struct('ring', array(named_struct('lon', 1D, 'lat', 2D)))) shape")
    shapes.write.parquet(str(tmp_path / "shapes"))
    pairs = spark.createDataFrame([("c1", "c2"), ("c3", "c4")], "cell1_name string, cell2_name string")
    both = hulls._with_outlines(pairs, spark.read.parquet(str(tmp_path / "shapes")))
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.cell1_name, r.cell2_name) for r in both.collect()) == [("c1", "c2"), ("c3", "c4")]


def test_nearest_points_are_searched_by_position(spark):
    """Thirty points on each of 36 positions: a query meets positions, not points, and ties go to the least id."""
    points = [(n * 36 + i * 6 + j, i * 0.001, j * 0.001) for i in range(6) for j in range(6) for n in range(30 if (i + j) % 3 else 2)]
    queries = [(q, 0.001 * q, 0.002) for q in range(6)]
    found = knn_join(spark.createDataFrame(queries, "qid int, llat double, llon double"), spark.createDataFrame(points, "pid int, rlat double, rlon double"), 24, "planar", finest_deg=0.0015)
    got = {(r.qid, r["rank"]): r.pid for r in found.collect()}
    for q, lat, lon in queries:
        order = sorted((((b - lon) ** 2 + (a - lat) ** 2) ** 0.5, pid) for pid, a, b in points)
        assert [got[q, n] for n in range(1, 25)] == [pid for _, pid in order[:24]]
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]
    assert scans and not any("pid" in line for line in scans)


def _built_outlines(spark, seen):
    """Square outlines from a step that counts how many rows it makes."""
    rows = [(f"S{i // 6:04d}{'LH'[i // 3 % 2]}{i % 3 + 1}", ("L800", "L1800")[i // 3 % 2], i * 0.01) for i in range(12)]

    def build(batches):
        for pdf in batches:
            seen.add(len(pdf))
            pdf["ring"] = [[{"lon": x + a, "lat": 52.0 + b} for a, b in ((0, 0), (0.02, 0), (0.02, 0.02), (0, 0.02), (0, 0))] for x in pdf["lon"]]
            yield pdf.drop(columns="lon")

    plain = spark.createDataFrame(rows, "cell_name string, band string, lon double")
    return plain.mapInPandas(build, "cell_name string, band string, ring array<struct<lon:double,lat:double>>")


def test_outlines_are_built_once(spark):
    pattern = P.CarrierAggregation(cell_pattern=r"^(S\d+)[LH](\d)$", pairs=(("L800-L1800", "L800", "L1800"),), threshold=0.999)
    gis = spark.createDataFrame([("S0000L1", 52.0, 0.0)], "cell_name string, latitude double, longitude double")
    coverage = spark.createDataFrame([("S0000L1", -80.0, 5, 100.0)], "cell_name string, avg_rsrp double, event_count long, distance_to_cell double")
    steps = {
        "ca_imbalance": lambda h: hulls.detect_ca_imbalance(h, pattern),
        "input_quality": lambda h: validate.input_quality(coverage, gis, h, r"^S", 0.7, datetime.date(2025, 1, 1)),
        "coverage_gaps": lambda h: gaps.detect_coverage_gaps(h, P.Gaps(), by_band=True).gaps,
    }
    for name, step in steps.items():
        seen = spark.sparkContext.accumulator(0)
        step(_built_outlines(spark, seen)).collect()
        assert seen.value == 12, name
