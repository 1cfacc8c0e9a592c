"""Shared operators against brute force on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellscape.functions import geo, lattice, rings, shapes
from cellscape.operators.components import connected_components, lattice_components
from cellscape.operators.quantile import attach_percentile_range, group_quantiles
from cellscape.operators.ring import expand_ring, ring_density
from cellscape.operators.spatial import (
    convex_hulls,
    cover_centres,
    cover_convex,
    dbscan,
    hull_of,
    knn_join,
    radius_join,
)


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def union_find(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("bounded", [True, False])
def test_group_quantiles_match_numpy_on_every_path(spark, bounded):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 300, p=[0.6, 0.39, 0.01]), "v": rng.normal(-90, 9, 300).round(1)})
    pdf.loc[:30, "v"] = -90.0
    got = group_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.9}, 0.7, bounded)
    got = got.toPandas().set_index("k")
    want = pdf.groupby("k")["v"].quantile([0.05, 0.5, 0.9]).unstack()
    for name, p in (("lo", 0.05), ("mid", 0.5), ("hi", 0.9)):
        assert np.allclose(got.loc[want.index, name], want[p])


def test_percentile_range_is_attached_as_scalars(spark):
    df = spark.range(101).withColumn("v", F.col("id").cast("double"))
    row = attach_percentile_range(df, {"v": 10.0}).first()
    assert (row["_p_v"]["low"], row["_p_v"]["high"]) == (5.0, 95.0)


def test_haversine_and_bearing(spark):
    lit = F.lit
    row = one(
        spark,
        geo.haversine_m(lit(53.0), lit(-6.0), lit(53.0), lit(-6.0)).alias("same"),
        geo.haversine_m(lit(0.0), lit(0.0), lit(0.0), lit(1.0)).alias("east"),
        geo.haversine_m(lit(53.0), lit(-6.0), lit(54.0), lit(-6.0)).alias("north"),
        geo.bearing_deg(lit(0.0), lit(0.0), lit(0.0), lit(1.0)).alias("b"),
        geo.angle_diff(lit(10.0), lit(350.0)).alias("d"),
        geo.in_sector(lit(355.0), lit(10.0), 65.0).alias("inside"),
        geo.destination(lit(0.0), lit(0.0), lit(90.0), lit(111_195.0)).alias("p"),
    )
    assert row.same == 0
    assert row.east == pytest.approx(111_320, rel=0.01)
    assert row.north == pytest.approx(111_190, rel=0.01)
    assert row.b == pytest.approx(90)
    assert row.d == pytest.approx(20)
    assert row.inside
    assert row.p.lon == pytest.approx(1.0, abs=1e-3)


def test_geohash_round_trip_and_known_code(spark):
    df = spark.range(200).select(
        ((F.col("id") * 1311) % 2**18).cast("int").alias("ix"), ((F.col("id") * 653) % 2**17).cast("int").alias("iy")
    )
    df = df.withColumn("g", lattice.encode(F.col("ix"), F.col("iy"))).withColumn("d", lattice.decode(F.col("g")))
    assert df.where((F.col("d.ix") != F.col("ix")) | (F.col("d.iy") != F.col("iy"))).count() == 0
    row = one(spark, lattice.encode(lattice.lon_to_ix(F.lit(-5.6)), lattice.lat_to_iy(F.lit(42.6))).alias("g"))
    assert row.g == "ezs42e4"
    assert one(spark, lattice.decode(F.lit("gc7abc0")).alias("d")).d is None


def test_ring_is_symmetric_and_clipped_at_the_border(spark):
    df = spark.createDataFrame([(100, 100), (0, 0)], "ix int, iy int")
    sizes = {r.ix: r["count"] for r in expand_ring(df, 3).groupBy("ix").count().collect()}
    assert sizes == {100: 49, 0: 16}


def test_ring_density_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    bins = {tuple(x) for x in rng.integers(0, 15, (90, 2)).tolist()}
    df = spark.createDataFrame([("L", x, y) for x, y in bins], "band string, ix int, iy int")
    for k in (1, 3):
        got = {(r.ix, r.iy): r.n for r in ring_density(df, ["band"], k, "n").collect()}
        want = {b: sum(max(abs(b[0] - c[0]), abs(b[1] - c[1])) <= k for c in bins) - 1 for b in bins}
        assert got == want


def test_connected_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 120, (90, 2)).tolist() + [[i, i + 1] for i in range(200, 240)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    label = union_find(300, pairs)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: label[n] for n in {x for p in pairs for x in p if p[0] != p[1]}}


@pytest.mark.parametrize("link", [1, 2])
def test_lattice_components_cross_tiles(spark, link):
    rng = np.random.default_rng(4)
    bins = sorted({tuple(x) for x in rng.integers(50, 80, (260, 2)).tolist()})
    pairs = [
        (i, j)
        for i, a in enumerate(bins)
        for j, b in enumerate(bins[:i])
        if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= link
    ]
    label = union_find(len(bins), pairs)
    df = spark.createDataFrame([("L", *b) for b in bins], "band string, ix int, iy int")
    got = {(r.ix, r.iy): r.component for r in lattice_components(df, ["band"], link).collect()}
    want = {b: bins[label[i]][0] * 2**18 + bins[label[i]][1] for i, b in enumerate(bins)}
    assert got == want


def test_radius_join_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    a = np.column_stack([rng.uniform(51, 52, 60), rng.uniform(-9, -8, 60)])
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "l int, llat double, llon double")
    right = left.toDF("r", "rlat", "rlon")
    got = {(r.l, r.r) for r in radius_join(left, right, 15_000).collect()}
    want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(a) if hav(*p, *q) <= 15_000}
    assert got == want


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_knn_join_is_exact_with_uneven_density(spark, metric):
    rng = np.random.default_rng(6)
    dense = np.column_stack([rng.normal(52, 0.004, 150), rng.normal(-8, 0.004, 150)])
    sparse = np.column_stack([rng.uniform(48, 56, 40), rng.uniform(-12, -3, 40)])
    pts = np.vstack([dense, sparse])
    queries = np.vstack([pts[::7], [[60.0, 10.0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid int, rlat double, rlon double")
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(queries)], "qid int, llat double, llon double")
    got = {}
    for r in knn_join(asked, points, 5, metric).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.distance
    for i, q in enumerate(queries):
        d = sorted(hav(*q, *p) if metric == "haversine" else math.hypot(*(q - p)) for p in pts)[:5]
        assert np.allclose([got[i][n] for n in range(1, 6)], d, rtol=1e-6)


def test_knn_join_with_fewer_points_than_k(spark):
    points = spark.createDataFrame([(1, 50.0, 0.0), (2, -40.0, 170.0)], "pid int, rlat double, rlon double")
    asked = spark.createDataFrame([(9, 50.0, 0.1)], "qid int, llat double, llon double")
    assert [r.pid for r in knn_join(asked, points, 4).orderBy("rank").collect()] == [1, 2]


def brute_dbscan(pts, eps, least):
    n = len(pts)
    near = [[j for j in range(n) if hav(*pts[i], *pts[j]) <= eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label = union_find(n, [(i, j) for i in range(n) for j in near[i] if core[i] and core[j]])
    return [
        label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=None) for i in range(n)
    ]


@pytest.mark.parametrize("least", [3, 6])
def test_dbscan_matches_brute_force(spark, least):
    rng = np.random.default_rng(7)
    blobs = [np.column_stack([rng.normal(a, 0.03, 40), rng.normal(b, 0.04, 40)]) for a, b in ((51.9, -8.5), (52.3, -8.4))]
    pts = np.vstack([*blobs, np.column_stack([rng.uniform(51, 53, 40), rng.uniform(-9.5, -7.5, 40)])])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid int, lat double, lon double")
    got = {r.pid: r.cluster for r in dbscan(df, 5_000, least).collect()}
    assert [got[i] for i in range(len(pts))] == brute_dbscan(pts.tolist(), 5_000, least)


def overlaps(spark, pairs):
    """Overlap of plane polygons given as open vertex arrays."""
    points = lambda v: [{"x": float(x), "y": float(y)} for x, y in [*v, v[0]]]
    kind = "array<struct<hole:boolean,points:array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame([(i, [(False, points(a))], [(False, points(b))]) for i, (a, b) in enumerate(pairs)], f"i int, a {kind}, b {kind}")
    return [r.m for r in df.select("i", shapes.overlap_m2(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()]


def convex_overlap(subject, clip):
    """Area of a convex polygon inside a convex counter-clockwise one, by cutting off half-planes."""
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in subject]
        out = []
        for i, p in enumerate(subject):
            j = (i + 1) % len(subject)
            if side[i] >= 0:
                out.append(p)
            if side[i] * side[j] < 0:
                out.append(p + (subject[j] - p) * (side[i] / (side[i] - side[j])))
        subject = out
        if len(subject) < 3:
            return 0.0
    x, y = np.array(subject).T
    return abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) / 2


def ring_of(points):
    return [{"lon": float(a), "lat": float(b)} for a, b in points]


def test_hull_and_pieces_agree(spark):
    rng = np.random.default_rng(8)
    xy = rng.normal(0, 1, (500, 2))
    df = spark.createDataFrame([("g", *map(float, p)) for p in xy], "g string, lon double, lat double")
    whole = {(p.lon, p.lat) for p in convex_hulls(df, ["g"], bounded=True).first().ring}
    cut = {(p.lon, p.lat) for p in convex_hulls(df, ["g"], piece=50).first().ring}
    assert whole == cut == {tuple(p) for p in hull_of(xy)}
    flat = spark.createDataFrame([("g", 0.0, 0.0), ("g", 1.0, 1.0), ("g", 2.0, 2.0)], "g string, lon double, lat double")
    assert convex_hulls(flat, ["g"]).first().ring is None


def test_area_of_small_square(spark):
    ring = ring_of([(-8.5, 53.0), (-8.48, 53.0), (-8.48, 53.02), (-8.5, 53.02), (-8.5, 53.0)])
    df = spark.createDataFrame([(ring,)], f"ring {rings.RING_TYPE}")
    side = hav(53.0, -8.5, 53.02, -8.5) * hav(53.01, -8.5, 53.01, -8.48) / 1e6
    assert df.select(rings.area_km2(F.col("ring"))).first()[0] == pytest.approx(side, rel=0.01)


def test_overlap_of_convex_and_of_concave_polygons(spark):
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    shifted = square + [1, 2]
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    assert overlaps(spark, [
        (square, shifted), (square[::-1], shifted), (ell, ell[::-1]), (ell, square + [0.5, 0.5]), (square, square + [9, 9]),
    ]) == pytest.approx([6, 6, 7, 7 - 4 * 0.5 - 3.5 * 0.5, 0])


def test_wkt_and_geojson_round_trip(spark):
    wkt = "POLYGON ((-8.5 51.9, -8.4 51.9, -8.4 52.0, -8.5 51.9))"
    geojson = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[-8.5,51.9],[-8.4,51.9],[-8.4,52.0],[-8.5,51.9]]]}}'
    df = spark.createDataFrame([(wkt, geojson)], "w string, g string")
    row = df.select(
        rings.parse_wkt_polygon(F.col("w")).alias("a"),
        rings.parse_geojson_polygon(F.col("g")).alias("b"),
        rings.to_wkt(rings.parse_wkt_polygon(F.col("w"))).alias("w"),
        rings.parse_wkt_polygon(F.lit("POINT (1 2)")).alias("none"),
    ).first()
    assert row.a == row.b and row.w == wkt and row.none is None


def test_covers_match_brute_force(spark):
    w, h = 360 / 2**18, 180 / 2**17
    ring = ring_of([(-8.5, 51.9), (-8.47, 51.905), (-8.455, 51.93), (-8.49, 51.94), (-8.5, 51.9)])
    df = spark.createDataFrame([(1, ring)], f"id int, ring {rings.RING_TYPE}")
    touched = {(r.ix, r.iy) for r in cover_convex(df).collect()}
    centred = {(r.ix, r.iy) for r in cover_centres(df).collect()}
    poly = np.array([(p["lon"], p["lat"]) for p in ring[:-1]])
    want_touch, want_centre = set(), set()
    for ix in range(int((-8.51 + 180) / w), int((-8.44 + 180) / w) + 1):
        for iy in range(int((51.89 + 90) / h), int((51.95 + 90) / h) + 1):
            box = np.array([(ix, iy), (ix + 1, iy), (ix + 1, iy + 1), (ix, iy + 1)]) * [w, h] - [180, 90]
            if convex_overlap(poly * 1e3, box * 1e3) > 0:
                want_touch.add((ix, iy))
            c = box.mean(0)
            nxt = np.roll(poly, -1, axis=0)
            if all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0 for a, b in zip(poly, nxt)):
                want_centre.add((ix, iy))
    assert touched == want_touch
    assert centred == want_centre
