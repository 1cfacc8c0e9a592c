"""Readers, sinks, the whole run and partition independence."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from cellscape.functions import rings
from cellscape.params import CarrierAggregation
from cellscape.plans import daily
from cellscape.plans.oracle import ORACLE
from cellscape.plans.queries import QUERIES
from cellscape.sources import readers, writers
from cellscape.sources import bench_tables as tables

SF = "/root/testdata/sf0.001"


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "cell_coverage.csv", "geohash7,cilac,Band,avg_rsrp,event_count,distance_to_cell\nezs42e4,1,L800,-90.5,10,1200\ngc7abc0,1,L800,-91,3,1300\nezs42e5,9,L1800,,x,700\n")
    write(tmp_path / "gis.csv", "Name,Latitude,Longitude,Band,Scr_Freq,SiteID,on_air\n1,42.6,-5.6,L800,7,S1,true\n9,42.7,-5.7,L1800,8,S2,false\n")
    write(tmp_path / "cell_hulls.csv", 'cell_name,geometry\n1,"POLYGON ((-5.7 42.5, -5.5 42.5, -5.5 42.7, -5.7 42.5))"\n2,POINT (1 2)\n')
    write(tmp_path / "cell_impacts.csv", "cell_name,cell_impact_name,cell_pci,cell_impact_pci,cell_band,cell_impact_band,co_site\n1,9,7,N/A,L800,L1800,y\n1,5,7,8,L800,L800,n\n")
    return str(tmp_path)


def test_files_become_canonical_tables(spark, folder):
    source = readers.open_source(spark, "mixed", folder=folder)
    cov = source.coverage().collect()
    assert [(r.grid, r.cell_name, r.band, r.event_count) for r in cov] == [("ezs42e4", "1", "L800", 10), ("ezs42e5", "9", "L1800", None)]
    assert cov[0].latitude == pytest.approx(42.6, abs=0.01)
    assert source.coverage("L1800").count() == 1
    assert [r.cell_name for r in source.gis(on_air_only=True).collect()] == ["1"]
    assert [(r.cell_name, r.band, r.pci) for r in source.hulls().collect()] == [("1", "L800", 7)]
    assert {r.to_cell_name for r in source.relations(known_only=True).collect()} == {"9"}
    assert [r.to_cell_name for r in source.planning_relations().collect()] == ["5"]


def test_missing_columns_and_bad_options_fail_early(spark, folder):
    with pytest.raises(ValueError, match="avg_rsrp"):
        readers.canonical(spark.createDataFrame([("a", "b", 1)], "grid string, cell_name string, event_count int"), "coverage")
    with pytest.raises(ValueError):
        readers.open_source(spark, "postgres")
    with pytest.raises(FileNotFoundError):
        readers.load_coverage(spark, folder + "/none")


def test_aliases_never_replace_a_canonical_column(spark):
    df = spark.createDataFrame([("x", "y")], "cell_name string, cilac string")
    assert readers.rename_aliases(df, "coverage").columns == ["cell_name", "cilac"]


def test_sinks_overwrite_even_with_nothing(spark, tmp_path):
    ring = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))]
    df = spark.createDataFrame([("k", "L800", ["a", "b"], ring)], f"cluster_id string, band string, cells array<string>, ring {rings.RING_TYPE}")
    path = str(tmp_path / "g")
    writers.write_geojson(df, path)
    feature = json.loads(spark.read.text(path).first().value)
    assert feature["geometry"]["type"] == "Polygon" and feature["properties"]["cells"] == ["a", "b"]
    writers.write_geojson(df.limit(0), path)
    assert spark.read.text(path).count() == 0
    writers.write_geojson(df, path + "b", by_band=True)
    assert os.path.isdir(path + "b/band=L800")
    writers.write_table(df, path + "t")
    assert spark.read.csv(path + "t", header=True).first().cells == "a,b"
    boundary = str(tmp_path / "b.txt")
    write(boundary, "POLYGON ((0 0, 1 0, 1 1, 0 0))\n" + json.dumps(feature) + "\n")
    assert readers.load_boundary(spark, boundary).count() == 2


def test_environment_cache_is_refreshed_for_a_new_cell(spark, tmp_path):
    path = str(tmp_path / "env")
    gis = tables.cell_gis(spark, SF)
    first = writers.cached_environment(spark, gis.limit(3), path)
    assert first.count() == 3
    assert writers.cached_environment(spark, gis, path).count() == gis.count()


def test_whole_run(spark, tmp_path):
    from cellscape.operators import hulls

    cov, gis = tables.coverage(spark, SF), tables.cell_gis(spark, SF)
    cov = cov.withColumn("perc_grid_events", F.lit(0.2))
    inputs = daily.Inputs(cov, gis, tables.relations(spark, SF), hulls.build_hulls(cov, gis))
    settings = daily.Settings(carrier_aggregation=CarrierAggregation(cell_pattern=r"^(S\d+)[LH](\d)$"))
    found = daily.run_detectors(inputs, datetime.date(2025, 1, 2), settings)
    assert {"overshooting", "undershooting", "interference", "low_coverage_advice", "coverage_gaps_by_band", "pci_combined", "crossed_feeders", "ca_imbalance", "daily_resolution", "tier3_neighbours"} <= set(found)
    some = {k: found[k] for k in ("environment", "pci_confusions", "coverage_gaps")}
    assert daily.summary(some).count() == 3
    daily.write_findings(some, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "environment"), header=True).count() == gis.count()


@pytest.mark.parametrize("name", ["undershoot_candidates", "pci_confusions"])
def test_partition_count_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_every_polygon_is_read(spark, tmp_path):
    square = lambda x: [[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 0.0]]
    multi = {"type": "MultiPolygon", "coordinates": [[square(0), square(0.2)], [square(5)]]}
    collection = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {}, "geometry": multi}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [square(9)]}},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]}
    for text, rings_there in (
        (json.dumps(collection, indent=2), 3), (json.dumps(collection), 3), (json.dumps(multi), 2), (json.dumps(collection["features"][1], indent=1), 1),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0.1 0, 0.2 0, 0.2 0.1, 0.1 0)), ((5 0, 6 0, 6 1, 5 0)))\nPOLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0, 0.2 0, 0.2 0.1, 0.1 0))", 3),
    ):
        path = str(tmp_path / f"b{abs(hash(text))}.txt")
        write(path, text)
        got = readers.load_boundary(spark, path).collect()
        assert len(got) == rings_there and all(len(r.ring) == 4 for r in got)
    empty = str(tmp_path / "none.txt")
    write(empty, "no polygon here\n")
    with pytest.raises(ValueError):
        readers.load_boundary(spark, empty)
    hulls = spark.createDataFrame([("a", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 0, 6 0, 6 1, 5 0)))"), ("b", "POINT (1 1)"), ("c", None)], "cell_name string, wkt string")
    assert [r.cell_name for r in readers.with_rings(hulls).collect()] == ["a", "a"]


def test_rejected_geohashes_are_counted(spark):
    df = spark.createDataFrame([("gc7x9r7",), ("gc7x9ra",), ("gc7",), (None,), ("gc7",)], "grid string")
    assert readers.with_lattice(df).count() == 1
    assert {r.grid: r.rows for r in readers.rejected_grids(df).collect()} == {"gc7x9ra": 1, "gc7": 2, None: 1}
