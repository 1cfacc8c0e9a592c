"""Shapes with parts and holes, span algebra and exact outlines against brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellscape.functions import lattice, rings, shapes
from cellscape.operators import gaps, hulls, lowcoverage, outline, spans
from cellscape.operators.spatial import cover_convex, nearest_owners, touch_spans
from cellscape.params import PciOverlap
from cellscape.sources import readers, writers

X0, Y0 = 124_000, 103_000
W, H = 360.0 / 2**18, 180.0 / 2**17


def lon(x):
    """Longitude of a place in bins from the corner of (X0, Y0)."""
    return (X0 + x) * W - 180.0


def lat(y):
    return (Y0 + y) * H - 90.0


def ring(points):
    return [(lon(x), lat(y)) for x, y in [*points, points[0]]]


def wkt(*polygons):
    text = lambda r: "(" + ", ".join(f"{a!r} {b!r}" for a, b in ring(r)) + ")"
    bodies = ["(" + ", ".join(map(text, p)) + ")" for p in polygons]
    return f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


def shaped(spark, rows, keys="id int"):
    df = spark.createDataFrame(rows, f"{keys}, wkt string")
    return df.withColumn("shape", shapes.parse_wkt(F.col("wkt")))


def inside(polygons, x, y):
    """Even-odd over all rings, in bin units."""
    n = 0
    for r in (r for p in polygons for r in p):
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
            if (ax <= x) != (bx <= x) and ay + (by - ay) * (x - ax) / (bx - ax) < y:
                n += 1
    return n % 2 == 1


def star(rng, cx, cy, radius, n=9):
    """A simple polygon that is not convex."""
    turns = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n
    return [(float(cx + d * np.cos(t)), float(cy + d * np.sin(t))) for t, d in zip(turns.tolist(), rng.uniform(0.3 * radius, radius, n).tolist())]


HOLED = [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 7), (3, 7)]], [[(20.5, 1), (30, 1), (25.1, 8)]]]


def bins(df):
    return {(r.ix - X0, r.iy - Y0) for r in spans.bins_of(df).collect()}


def test_shape_round_trip_area_and_holes(spark):
    df = shaped(spark, [(1, wkt(*HOLED)), (2, wkt(HOLED[0])), (3, "POINT (1 2)"), (4, None), (5, "POLYGON ((0 0, 1 x, 1 1, 0 0))"), (6, "POLYGON EMPTY")])
    first, second, *rest = df.orderBy("id").collect()
    assert [(r.part, r.hole, len(r.ring)) for r in first["shape"]] == [(0, False, 5), (0, True, 5), (1, False, 4)]
    assert all(r["shape"] is None for r in rest)
    again = df.where("shape is not null").select("id", shapes.parse_wkt(shapes.to_wkt(F.col("shape"))).alias("shape")).orderBy("id").collect()
    assert [r["shape"] for r in again] == [first["shape"], second["shape"]]
    text = F.to_json(shapes.to_geojson_geometry(F.col("shape")))
    read = df.where("shape is not null").select("id", F.explode(shapes.parse_geojson(text)).alias("shape")).orderBy("id").collect()
    assert [r["shape"] for r in read] == [first["shape"], second["shape"]]
    unit = 111.195**2 * W * H * np.cos(np.radians(lat(4)))
    area = {r.id: r.a for r in df.where("shape is not null").select("id", shapes.area_km2(F.col("shape")).alias("a")).collect()}
    assert area[2] == pytest.approx(88 * unit, rel=0.01) and area[1] - area[2] == pytest.approx(33.25 * unit, rel=0.01)
    at = lambda x, y: df.where("id = 1").select(shapes.contains(F.col("shape"), F.lit(lon(x)), F.lit(lat(y)))).first()[0]
    assert at(1, 1) and at(25, 3) and not at(4, 5) and not at(15, 5) and not at(25, 9)
    c = df.where("id = 2").select(shapes.centroid(F.col("shape")).alias("c")).first().c
    assert c.x == pytest.approx(lon((100 * 5 - 12 * 4.5) / 88), abs=1e-9) and c.y == pytest.approx(lat(5), abs=1e-9)


def test_hulls_keep_all_parts(spark, tmp_path):
    raw = spark.createDataFrame([("a", wkt(*HOLED)), ("b", wkt(HOLED[1])), ("b", wkt([[(0, 0), (1, 0), (1, 1)]])), ("c", "POINT (1 1)")], "cell_name string, wkt string")
    kept = {r.cell_name: r for r in hulls.valid_hulls(readers.with_shapes(raw)).collect()}
    assert set(kept) == {"a", "b"} and len(kept["a"]["shape"]) == 3
    unit = 111.195**2 * W * H * np.cos(np.radians(lat(4)))
    assert kept["a"].area_km2 == pytest.approx(121.25 * unit, rel=0.01) and kept["b"].area_km2 == pytest.approx(33.25 * unit, rel=0.01)
    writers.write_geojson(hulls.valid_hulls(readers.with_shapes(raw)), str(tmp_path / "h"))
    features = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert sorted(len(f["geometry"]["coordinates"]) for f in features) == [1, 2]
    path = str(tmp_path / "b.txt")
    with open(path, "w") as f:
        f.write(wkt(*HOLED) + "\n")
    rows = readers.load_boundary(spark, path).collect()
    assert sorted(len(r["shape"]) for r in rows) == [1, 2]


def test_overlap_of_any_shapes(spark):
    """Random concave rings, parts and holes against a fine raster."""
    rng = np.random.default_rng(4)
    cases = [([[star(rng, 10, 10, 9)]], [[star(rng, 13, 9, 8)]]) for _ in range(12)]
    cases += [(HOLED, [[star(rng, 12, 5, 12)]]), (HOLED, HOLED), (HOLED, [[[(3.5, 4), (5, 4), (5, 6), (3.5, 6)]]])]
    df = shaped(spark, [(i, wkt(*a)) for i, (a, _) in enumerate(cases)]).withColumnRenamed("shape", "a").drop("wkt")
    df = df.join(shaped(spark, [(i, wkt(*b)) for i, (_, b) in enumerate(cases)]).withColumnRenamed("shape", "b").drop("wkt"), "id")
    plane = lambda c: F.transform(c, lambda r: F.struct(r["hole"].alias("hole"), F.transform(r["ring"], lambda p: F.struct(((p["lon"] - lon(0)) / W).alias("x"), ((p["lat"] - lat(0)) / H).alias("y"))).alias("points")))
    got = [r.m for r in df.select("id", shapes.overlap_m2(plane(F.col("a")), plane(F.col("b"))).alias("m")).orderBy("id").collect()]
    step = 0.1
    grid = np.arange(-5, 35, step) + step / 2 + 1e-6
    for (a, b), area in zip(cases, got):
        both = np.ones((len(grid), len(grid)), bool)
        for shape in (a, b):
            odd = np.zeros_like(both)
            for r in (r for p in shape for r in p):
                for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]]):
                    if ax != bx:
                        at = (ax <= grid) != (bx <= grid)
                        odd ^= at[:, None] & ((ay + (by - ay) * (grid - ax) / (bx - ax))[:, None] < grid[None, :])
            both &= odd
        assert area == pytest.approx(both.sum() * step * step, abs=1.2)
    assert got[-1] == pytest.approx(0, abs=1e-6) and got[-2] == pytest.approx(121.25, abs=1e-6)


def test_conflicts_between_outlines_with_holes(spark):
    ring_cell, core = wkt(HOLED[0]), wkt([[(3.5, 4), (5, 4), (5, 6), (3.5, 6)]])
    df = shaped(spark, [("A", "L800", 5, ring_cell), ("B", "L800", 5, core)], "cell_name string, band string, pci int").drop("wkt")
    assert hulls.detect_pci_overlaps(df, PciOverlap(min_area_km2=0.001)).count() == 0
    filled = shaped(spark, [("A", "L800", 5, wkt(HOLED[0][:1])), ("B", "L800", 5, core)], "cell_name string, band string, pci int").drop("wkt")
    row = hulls.detect_pci_overlaps(filled, PciOverlap(min_area_km2=0.001)).first()
    assert row.overlap_percentage == pytest.approx(100, abs=0.01)


def test_cover_spans_match_brute_force(spark):
    rng = np.random.default_rng(7)
    cases = {i: [[star(rng, 12, 12, 11, 15)]] for i in range(6)} | {6: HOLED, 7: [[[(0.2, 0.3), (0.4, 0.3), (0.4, 0.4)]]]}
    df = shaped(spark, [(i, wkt(*p)) for i, p in cases.items()] + [(6, wkt(*HOLED))])
    covered = spans.cover_spans(df, ["id"])
    assert covered.where("lo > hi").count() == 0
    got = {i: set() for i in cases}
    for r in spans.bins_of(spans.union(covered, ["id"])).collect():
        got[r.id].add((r.ix - X0, r.iy - Y0))
    for i, p in cases.items():
        assert got[i] == {(x, y) for x in range(-3, 40) for y in range(-3, 40) if inside(p, x + 0.5, y + 0.5)}
    assert covered.where("id = 6").count() == 4 + 2 * 3 + 3 + spans.cover_spans(shaped(spark, [(6, wkt(HOLED[1]))]), ["id"]).count()


def span_rows(spark, cells, keys="k string"):
    return spark.createDataFrame([(k, X0 + x, Y0 + a, Y0 + b) for k, x, a, b in cells], f"{keys}, ix int, lo int, hi int")


def test_span_algebra_matches_sets(spark):
    rng = random.Random(2)
    draw = lambda n: [(rng.choice("pq"), rng.randrange(4), a, a + rng.randrange(6)) for a in (rng.randrange(30) for _ in range(n))]
    a, b = draw(60), draw(40)
    flat = lambda cells: {(k, x, y) for k, x, lo, hi in cells for y in range(lo, hi + 1)}
    left, right = span_rows(spark, a), span_rows(spark, b)

    def check(df, want):
        rows = [(r.k, r.ix - X0, r.lo - Y0, r.hi - Y0) for r in df.collect()]
        assert flat(rows) == want and sum(hi - lo + 1 for _, _, lo, hi in rows) == len(want)
        assert not any((k, x, hi + 1) in want for k, x, _, hi in rows), "spans are maximal"

    check(spans.union(left, ["k"]), flat(a))
    check(spans.intersection(left, right, ["k"]), flat(a) & flat(b))
    check(spans.difference(left, right, ["k"]), flat(a) - flat(b))
    check(spans.spans_of(spans.bins_of(left), ["k"]), flat(a))
    check(spans.difference(left, left, ["k"]), set())
    kept = spans.bins_inside(spans.bins_of(spans.union(left, ["k"])), spans.union(right, ["k"]), ["k"])
    assert {(r.k, r.ix - X0, r.iy - Y0) for r in kept.collect()} == flat(a) & flat(b) and kept.count() == len(flat(a) & flat(b))


def test_sole_owner_matches_sets(spark):
    rng = random.Random(8)
    cells = [("L", f"c{rng.randrange(6)}", rng.randrange(4), a, a + rng.randrange(8)) for a in (rng.randrange(40) for _ in range(60))]
    df = spark.createDataFrame([(b, c, X0 + x, Y0 + lo, Y0 + hi) for b, c, x, lo, hi in cells], "band string, cell_name string, ix int, lo int, hi int")
    owners = {}
    for _, c, x, lo, hi in cells:
        for y in range(lo, hi + 1):
            owners.setdefault((x, y), set()).add(c)
    got = {(r.ix - X0, r.iy - Y0): r.cell_name for r in spans.bins_of(spans.sole_owner(df, ["band"], "cell_name")).collect()}
    assert got == {k: next(iter(v)) for k, v in owners.items() if len(v) == 1}


def test_single_server_bins(spark):
    df = shaped(spark, [("L", "a", wkt(*HOLED)), ("L", "b", wkt([[(5, 0), (12, 0), (12, 10), (5, 10)]])), ("H", "c", wkt(HOLED[0]))], "band string, cell_name string").drop("wkt")
    got = {(r.band, r.cell_name, r.ix - X0, r.iy - Y0) for r in lowcoverage.single_server_bins(df).collect()}
    want = set()
    for x in range(35):
        for y in range(12):
            a, b = inside(HOLED, x + 0.5, y + 0.5), 5 <= x < 12 and y < 10
            if a != b:
                want.add(("L", "a" if a else "b", x, y))
            if inside(HOLED[:1], x + 0.5, y + 0.5):
                want.add(("H", "c", x, y))
    assert got == want


def outlined(spark, cells):
    df = spark.createDataFrame([("r", X0 + x, Y0 + y) for x, y in cells], "k string, ix int, iy int")
    return outline.region_outlines(df, ["k"]).first()


def test_exact_outlines(spark):
    """Blocks with holes, islands in holes, corners that only touch: area and membership are those of the bins."""
    rng = random.Random(6)
    block = {(x, y) for x in range(9) for y in range(9)}
    cases = [
        {(0, 0)}, {(0, 0), (1, 1)}, {(0, 1), (1, 0)}, block - {(3, 3), (4, 4), (4, 3)}, block - {(3, 3), (4, 4)},
        block - {(x, y) for x in range(2, 7) for y in range(2, 7)} | {(4, 4)}, block - {(1, 1), (2, 2)} | {(12, 3), (13, 4)},
        {(x, y) for x in range(14) for y in range(14) if rng.random() < 0.6},
    ]
    for cells in cases:
        row = outlined(spark, cells)
        polygons = {}
        for r in row["shape"]:
            points = [((p.lon + 180.0) / W - X0, (p.lat + 90.0) / H - Y0) for p in r.ring]
            assert points[0] == points[-1] and len(points) >= 5
            assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(np.round(points, 6).tolist(), np.round(points[1:], 6).tolist())), "sides alternate"
            polygons.setdefault(r.part, []).append((r.hole, points[:-1]))
        shape = [[p for _, p in part] for part in polygons.values()]
        for x in range(-1, 16):
            for y in range(-1, 16):
                assert inside(shape, x + 0.5, y + 0.5) == ((x, y) in cells)
        for part in polygons.values():
            assert [h for h, _ in part][0] is False and sum(not h for h, _ in part) == 1
            for hole, p in part[1:]:
                assert hole and inside([[part[0][1]]], p[0][0] + 1e-3, p[0][1] - 1e-3) or inside([[part[0][1]]], p[0][0] - 1e-3, p[0][1] + 1e-3) or inside([[part[0][1]]], p[0][0] + 1e-3, p[0][1] + 1e-3)
        one = 111.195**2 * W * H * np.cos(np.radians(lat(7)))
        assert row.area_km2 == pytest.approx(len(cells) * one, rel=0.01, abs=1e-3)


def test_area_of_spans_matches_the_projected_area(spark):
    df = spark.createDataFrame([(X0, Y0, Y0 + 200)], "ix int, lo int, hi int")
    corners = [(0, 0), (1, 0), (1, 201), (0, 201)]
    got = df.select(spans.area_km2(F.col("lo"), F.col("hi"))).first()[0]
    want = shaped(spark, [(1, wkt([corners]))]).select(shapes.area_km2(F.col("shape"))).first()[0]
    assert got == pytest.approx(want, rel=2e-3)


def test_cycles():
    following = np.array([1, 2, 0, 3, 7, 4, 6, 5])
    least, step = outline.cycles(following)
    assert least.tolist() == [0, 0, 0, 3, 4, 4, 6, 4] and step.tolist() == [0, 1, 2, 0, 0, 2, 0, 1]


def test_clip_by_a_concave_border_with_a_hole(spark):
    cells = [(x, y) for x in range(20) for y in range(12)]
    df = spark.createDataFrame([("r", X0 + x, Y0 + y) for x, y in cells], "k string, ix int, iy int")
    whole = outline.region_summary(df, ["k"]).join(outline.region_outlines(df, ["k"]), ["k"])
    border = shaped(spark, [(1, wkt([[(0, 0), (20, 0), (20, 12), (12, 12), (12, 3), (8, 3), (8, 12), (0, 12)], [(2, 5), (5, 5), (5, 9), (2, 9)]])), (2, wkt([[(0, 0), (3, 0), (3, 3), (0, 3)]]))]).drop("wkt")
    cut = outline.clip_regions(whole, df, ["k"], border).first()
    want = {c for c in cells if not (8 <= c[0] < 12 and c[1] >= 3) and not (2 <= c[0] < 5 and 5 <= c[1] < 9)}
    assert cut.n_points == 240 and cut.area_km2 == pytest.approx(len(want) / 240 * whole.first().area_km2, rel=1e-3)
    assert cut.centroid_lon == pytest.approx(np.mean([lon(x + 0.5) for x, _ in want]), abs=1e-9)
    assert {(r.ix - X0, r.iy - Y0) for r in outline.clip_to_boundary(df, border).collect()} == want
    ring_only = outline.clip_regions(whole, df, ["k"], border.drop("id").withColumn("ring", F.col("shape")[0]["ring"]).drop("shape")).first()
    assert ring_only.area_km2 > cut.area_km2


def test_uncovered_bins_match_brute_force(spark):
    rng = np.random.default_rng(11)
    cells = {f"c{i}": [[star(rng, cx, cy, 5)]] for i, (cx, cy) in enumerate([(5, 5), (25, 6), (8, 24), (24, 25)])}
    df = shaped(spark, [(c, wkt(*p)) for c, p in cells.items()], "cell_name string").drop("wkt")
    clusters = df.select("cell_name", F.lit("c0").alias("hull_cluster"))
    got = {(r.ix - X0, r.iy - Y0) for r in gaps.uncovered_bins(df, clusters).collect()}
    from cellscape.operators.spatial import hull_of

    outer = [hull_of(np.array([p for c in cells.values() for r in c[0] for p in r])).tolist()]
    want = {(x, y) for x in range(-2, 35) for y in range(-2, 35) if inside([outer], x + 0.5, y + 0.5) and not any(inside(p, x + 0.5, y + 0.5) for p in cells.values())}
    assert got == want and len(want) > 200


def test_wide_region_is_spread_by_column(spark):
    """A region of ten million bins is a few thousand spans over all tasks; its difference makes only the rim."""
    size = 3200
    df = shaped(spark, [(1, wkt([[(0, 0), (size, 0), (size, size), (0, size)]]))])
    inner = shaped(spark, [(1, wkt([[(1, 1), (size - 1, 1), (size - 1, size - 1), (1, size - 1)]]))])
    covered = spans.cover_spans(df, ["id"])
    assert covered.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] == size * size and covered.count() == size
    rim = spans.difference(covered, spans.cover_spans(inner, ["id"]), ["id"])
    assert spans.bins_of(rim).count() == 4 * size - 4
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in rim.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_touch_spans_are_the_touching_bins(spark):
    df = shaped(spark, [(1, wkt([[(0.5, 0.5), (9.3, 2.2), (4.1, 7.9)]]))]).withColumn("ring", F.col("shape")[0]["ring"]).select("id", "ring")
    assert bins(touch_spans(df)) == {(r.ix - X0, r.iy - Y0) for r in cover_convex(df).collect()}
    assert lattice.bits() == (18, 17) and rings.RING_TYPE


def test_nearest_owners_against_brute_force(spark):
    """Dense owners, far owners, a pole and the antimeridian; fewer owners than asked for end after one search."""
    rng = np.random.default_rng(3)
    points = [(f"c{i % 5}", float(50 + rng.uniform(0, 0.001)), float(6 + rng.uniform(0, 0.001))) for i in range(300)]
    points += [(f"f{i}", float(rng.uniform(40, 60)), float(rng.uniform(-10, 20))) for i in range(40)]
    points += [("west", 10.0, -179.99), ("east", 10.0, 179.98), ("pole", 89.9, 10.0), ("south", -70.0, 3.0)]
    queries = [(1, 50.0005, 6.0005), (2, 45.0, 0.0), (3, 10.0, 179.999), (4, 89.95, -170.0), (5, -80.0, 100.0)]
    q = spark.createDataFrame(queries, "qid int, llat double, llon double")
    df = spark.createDataFrame(points, "cell_name string, rlat double, rlon double")

    def metres(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return 2 * 6_371_000.0 * np.arctan2(np.sqrt(h), np.sqrt(max(1 - h, 0)))

    for k in (1, 4, 30, 100):
        got = {}
        for r in nearest_owners(q, df, "cell_name", k).collect():
            got.setdefault(r.qid, []).append((r["rank"], r.cell_name, r.distance))
        for i, la, lo in queries:
            best = {}
            for c, a, b in points:
                best[c] = min(metres(la, lo, a, b), best.get(c, 1e9))
            want = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
            assert [(c, pytest.approx(d, abs=1e-3)) for _, c, d in sorted(got[i])] == want
    assert nearest_owners(q, df.limit(0), "cell_name", 3).count() == 0
