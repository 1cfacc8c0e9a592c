
from collections import defaultdict
from math import asin, cos, log1p, radians, sin, sqrt

import numpy as np
import pytest

from cellscape.functions.geo import EARTH_RADIUS_M
from cellscape.operators import pci
from cellscape.operators.spatial import dbscan, knn_join, radius_join

RELATIONS = "cell_name string, to_cell_name string, pci int, to_pci int, band string, to_band string, weight double, distance double, intra_site string, intra_cell string"


def test_pair_weights_hold_every_two_hop_pair(spark):
    """A hub of twelve cells of different bands and identities, against the loops of the definition."""
    identity = {"H1": (0, "L800")} | {f"C{i:02d}1": (i % 7, "L800" if i % 2 else "L1800") for i in range(12)}
    links = {("H1", c): 3.0 + i for i, c in enumerate(identity) if c != "H1"} | {(c, "H1"): 1.0 + i % 3 for i, c in enumerate(identity) if c != "H1"}
    links |= {("C001", "C011"): 5.0, ("C021", "C031"): 0.0, ("C031", "C041"): 2.0}
    far = {("C041", "C051"): 9.0}
    rows = [(a, b, identity[a][0], identity[b][0], identity[a][1], identity[b][1], w, d, "n", "n") for d, x in ((100.0, links), (50_000.0, far)) for (a, b), w in x.items()]
    w1, w2 = {}, defaultdict(float)
    for a, b in links:
        w1[min(a, b), max(a, b)] = log1p(links[a, b] + links.get((b, a), 0.0))
    for i, k in links:
        for x, j in links:
            if x == k and j != i and (one := w1[min(i, k), max(i, k)]) > 0 and (two := w1[min(k, j), max(k, j)]) > 0:
                w2[min(i, j), max(i, j)] += 0.25 * min(one, two)
    want = {pair: w1.get(pair, 0.0) + w2.get(pair, 0.0) for pair in w1.keys() | w2.keys()}
    net = pci.build_network(spark.createDataFrame(rows, RELATIONS))
    got = {(r.a, r.b): r.pair_weight for r in pci.pair_weights(net).collect()}
    assert got == pytest.approx(want) and len(got) == 78
    pieces = {(r.a, r.b): r.w for r in pci.two_hop_pairs(net, pci.one_hop_pairs(net), piece=4).collect()}
    assert pieces == pytest.approx(dict(w2))


def test_one_row_per_confusion_of_any_size(spark):
    """10,050 neighbours with one identity are one confusion with all their names."""
    many = spark.range(10_050).selectExpr("'S1' cell_name", "format_string('N%05d1', id) to_cell_name", "0 pci", "7 to_pci", "'L800' band", "'L800' to_band", "1D weight", "10D distance", "'n' intra_site", "'n' intra_cell")
    few = spark.createDataFrame([("T1", f"N0000{i}1", 0, 7, "L800", "L800", 1.0, 10.0, "n", "n") for i in range(2)], RELATIONS)
    net = pci.build_network(many.unionByName(few))
    got = {r.serving: r for r in pci.detect_confusions(net).collect()}
    assert len(got) == pci.detect_confusions(net).count() == 2
    assert got["S1"].group_size == 10_050 and got["S1"].neighbors.split(",") == [f"N{i:05d}1" for i in range(10_050)]
    assert "chunk" not in pci.detect_confusions(net).columns


@pytest.fixture(scope="module")
def round_the_globe():
    """Points on both sides of the antimeridian, on it, and round both poles."""
    rng = np.random.default_rng(5)
    edge = [(rng.uniform(-20.3, -20.0), (180.0 + x) if x < 0 else (x - 180.0)) for x in rng.uniform(-0.2, 0.2, 60)]
    poles = [(s * rng.uniform(89.6, 90.0), rng.uniform(-180, 180)) for s in (1, -1) for _ in range(40)]
    return [(float(a), float(b)) for a, b in [*edge, (-20.1, 180.0), (-20.1, -180.0), (90.0, 12.0), *poles]]


def globe_m(a, b):
    la, lb, dl = radians(a[0]), radians(b[0]), radians(a[1] - b[1])
    return 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(sin((la - lb) / 2) ** 2 + cos(la) * cos(lb) * sin(dl / 2) ** 2)))


def test_radius_join_across_the_antimeridian_and_poles(spark, round_the_globe):
    rows = [(i, *p) for i, p in enumerate(round_the_globe)]
    left, right = spark.createDataFrame(rows, "l int, llat double, llon double"), spark.createDataFrame(rows, "r int, rlat double, rlon double")
    for radius in (700.0, 9_000.0):
        pairs = radius_join(left, right, radius).select("l", "r").collect()
        want = {(i, j) for i, a in enumerate(round_the_globe) for j, b in enumerate(round_the_globe) if globe_m(a, b) <= radius}
        assert {(r.l, r.r) for r in pairs} == want and len(pairs) == len(want)
    pair = spark.createDataFrame([(1, 0.0, 179.999)], "l int, llat double, llon double"), spark.createDataFrame([(2, 0.0, -179.999)], "r int, rlat double, rlon double")
    assert radius_join(*pair, 300.0).count() == 1


@pytest.mark.parametrize("k", [1, 6, 30])
def test_knn_join_across_the_antimeridian_and_poles(spark, round_the_globe, k):
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(round_the_globe)], "pid int, rlat double, rlon double")
    asked = [(-20.15, 179.9999), (-20.15, -179.9999), (-20.15, 179.9), (-20.15, 180.0), (89.8, 100.0), (90.0, 0.0), (-89.95, -170.0), (89.3, -60.0)]
    queries = spark.createDataFrame([(i, *q) for i, q in enumerate(asked)], "qid int, llat double, llon double")
    got = knn_join(queries, points, k).collect()
    for i, q in enumerate(asked):
        mine = [r.distance for r in sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])]
        assert mine == pytest.approx(sorted(globe_m(q, p) for p in round_the_globe)[:k], abs=1e-3)


@pytest.mark.parametrize("least", [2, 5])
def test_dbscan_across_the_antimeridian_and_poles(spark, round_the_globe, least):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(round_the_globe)], "pid int, lat double, lon double")
    n = len(round_the_globe)
    for eps in (2_500.0, 9_000.0):
        near = [[j for j in range(n) if globe_m(round_the_globe[i], round_the_globe[j]) <= eps] for i in range(n)]
        core, name = [len(x) >= least for x in near], {}
        for i in range(n):
            todo = [i] if core[i] and i not in name else []
            while todo:
                x = todo.pop()
                name[x] = i
                todo += [j for j in near[x] if core[j] and j not in name]
        want = [name[i] if core[i] else min((name[j] for j in near[i] if core[j]), default=None) for i in range(n)]
        got = {r.pid: r.cluster for r in dbscan(df, eps, least).collect()}
        assert [got[i] for i in range(n)] == want
