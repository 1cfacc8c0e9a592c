"""Findings of the fourth round."""

from __future__ import annotations

import math
import random

from cellscape import params as P
from cellscape.operators import enrich, gaps, hulls, spans
from cellscape.operators.components import lattice_components
from cellscape.operators.spatial import dbscan, knn_join


def test_rsrp_share_where_the_total_is_not_positive(spark):
    """Signals below -150 make a bin's total negative or zero; the SQL divides by it all the same."""
    cells = [(1, 1, "a", -160.0), (1, 1, "b", -180.0), (1, 2, "a", -140.0), (1, 2, "b", -160.0), (1, 3, "a", -150.0), (1, 4, "a", None)]
    rows = enrich.rsrp_share(spark.createDataFrame(cells, "ix int, iy int, cell_name string, avg_rsrp double")).collect()
    share = {(r.iy, r.cell_name): r.perc_grid_events for r in rows}
    assert {k: share[k] for k in ((1, "a"), (1, "b"), (2, "a"), (2, "b"), (4, "a"))} == {
        (1, "a"): 0.25, (1, "b"): 0.75, (2, "a"): math.inf, (2, "b"): -math.inf, (4, "a"): 0.0,
    }
    assert math.isnan(share[3, "a"])
    assert {r.avg_rsrp_grid for r in rows if r.iy == 1} == {-175.0}


def test_boxes_of_conflict_pairs_are_not_broadcast(spark, tmp_path):
    """Outlines that share many coarse bins meet once, and their boxes' bins are merged, not sent to the driver."""
    rows = [(f"c{i}", "L800", (0, 0, 3)[i % 3], 0.05 * i) for i in range(6)]
    corners = "transform(array(0D, 1D, 1D, 0D, 0D), (x, i) -> named_struct('lon', lon + x * 0.3, 'lat', 50 + if(i in (2, 3), 0.3, 0)))"
    squares = spark.createDataFrame(rows, "cell_name string, band string, pci int, lon double")
    squares.selectExpr("cell_name", "band", "pci", f"array(named_struct('part', 0, 'hole', false, 'ring', {corners})) shape").write.parquet(str(tmp_path / "hulls"))
    pairs = hulls._candidate_pairs(spark.read.parquet(str(tmp_path / "hulls")), P.PciOverlap(), with_site=False)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    zeros, threes = ["c0", "c1", "c3", "c4"], ["c2", "c5"]
    exact = {(a, b) for own in (zeros, threes) for a in own for b in own if a < b}
    mod3 = {(min(a, b), max(a, b)) for a in zeros for b in threes}
    found = [(r.conflict_type, r.cell1_name, r.cell2_name) for r in pairs.collect()]
    assert sorted(found) == sorted([("exact", *p) for p in exact] + [("mod3", *p) for p in mod3])


def test_buckets_of_nearest_points_are_not_broadcast(spark):
    """A written table of positions is small, but its buckets on all levels are not."""
    points = spark.range(200).selectExpr("id pid", "id % 20 * 0.001D rlat", "id div 20 * 0.001D rlon")
    queries = spark.range(5).selectExpr("id qid", "id * 0.0031D llat", "0.0043D llon")
    found = knn_join(queries, points.repartition(2), 3, "planar", finest_deg=0.0015)
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = [line for line in plan.splitlines() if "HashJoin" in line and "_bx" in line]
    assert "SortMergeJoin" in plan and not buckets
    got = {(r.qid, r["rank"]): r.pid for r in found.collect()}
    for q in range(5):
        order = sorted((((p // 20 * 0.001 - 0.0043) ** 2 + (p % 20 * 0.001 - q * 0.0031) ** 2) ** 0.5, p) for p in range(200))
        assert [got[q, n] for n in (1, 2, 3)] == [p for _, p in order[:3]]
    none = knn_join(queries.where("qid < 0"), points, 3, "planar", finest_deg=0.0015)
    assert none.count() == 0


def test_spans_have_the_density_and_regions_of_their_bins(spark):
    draw = random.Random(4)
    bins = {(k, 100 + x, 200 + y) for k in "ab" for x in range(26) for y in range(90) if (x * 7 + y // 9) % 5 and draw.random() < 0.85}
    table = spark.createDataFrame(sorted(bins), "k string, ix int, iy int")
    covered = spans.spans_of(table, ["k"])
    for reach, least in ((3, 30), (3, 24), (1, 8), (2, 0)):
        near = {b for b in bins if sum((b[0], b[1] + i, b[2] + j) in bins for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)) > least}
        assert {tuple(r) for r in spans.bins_of(spans.dense(covered, ["k"], reach, least)).select("k", "ix", "iy").collect()} == near, (reach, least)
    sparse = table.where("(ix * 31 + iy * 17 + ix * iy) % 11 = 0")
    for link in (1, 2):
        whole = {tuple(r) for r in lattice_components(sparse, ["k"], link).select("k", "ix", "iy", "component").collect()}
        found = spans.bins_of(spans.components(spans.spans_of(sparse, ["k"]), ["k"], link))
        assert {tuple(r) for r in found.select("k", "ix", "iy", "component").collect()} == whole and len({w[3] for w in whole}) > 1


def test_wide_gaps_are_never_bins(spark):
    """Four small outlines 8 degrees apart leave 34 million bins uncovered between them, but 6,000 spans."""
    ring = "transform(array(0, 1, 1, 0, 0), (v, i) -> named_struct('lon', lon + v * 0.02, 'lat', lat + if(i in (2, 3), 0.02, 0)))"
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("b", 8.0, 0.0), ("c", 8.0, 8.0), ("d", 0.0, 8.0)], "cell_name string, lon double, lat double")
    found = gaps.detect_coverage_gaps(rows.selectExpr("cell_name", f"{ring} ring"), P.Gaps(eps_m=2e6)).gaps.collect()
    assert len(found) == 1 and found[0].n_points > 33_000_000
    assert 780_000 < found[0].area_km2 < 800_000


def test_cells_of_one_name_do_not_multiply(spark):
    points = spark.range(40).selectExpr("concat('c', id % 4) pid", "50 + id % 2 * 0.001 + id div 2 * 0.0001 lat", "0D lon")
    assert dbscan(points, 5000.0, 3).count() == 40
