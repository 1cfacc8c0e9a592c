"""Readers that turn files and database tables into the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellscape.functions import lattice, rings, shapes
from cellscape.sources.schema import ALIASES, REQUIRED, SCHEMAS

FILES = {"coverage": ["cell_coverage"], "cell_gis": ["cell_gis", "gis"], "hulls": ["cell_hulls"], "relations": ["cell_impacts", "relations"]}


def rename_aliases(df: DataFrame, table: str) -> DataFrame:
    """Give aliased columns their canonical name, unless that name is already there."""
    names = {}
    for canonical, aliases in ALIASES[table].items():
        hit = next((a for a in aliases if a in df.columns and a not in names), None)
        if canonical not in df.columns and hit:
            names[hit] = canonical
    return df.withColumnsRenamed(names)


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")
    return df


def canonical(df: DataFrame, table: str) -> DataFrame:
    """Canonical names and types; columns that are not in the schema stay as they are."""
    df = require(rename_aliases(df, table), REQUIRED[table], table)
    kinds = {f.name: f.dataType for f in SCHEMAS[table].fields}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def with_lattice(coverage: DataFrame) -> DataFrame:
    """Bin coordinates and centre from the geohash; rows with an undecodable one are dropped (``rejected_grids`` counts them)."""
    if not {"ix", "iy"} <= set(coverage.columns):
        coverage = coverage.withColumn("_b", lattice.decode(F.col("grid"))).where(F.col("_b").isNotNull())
        coverage = coverage.withColumns({"ix": F.col("_b.ix"), "iy": F.col("_b.iy")}).drop("_b")
    if "latitude" not in coverage.columns:
        coverage = coverage.withColumns({"latitude": lattice.iy_to_lat(F.col("iy")), "longitude": lattice.ix_to_lon(F.col("ix"))})
    return coverage


def rejected_grids(coverage: DataFrame) -> DataFrame:
    """Geohashes that ``with_lattice`` cannot place, with their rows."""
    bad = coverage.where(F.col("grid").isNull() | lattice.decode(F.col("grid")).isNull())
    return bad.groupBy("grid").agg(F.count(F.lit(1)).alias("rows"))


def _read(spark: SparkSession, folder: str, table: str, kind: str) -> DataFrame:
    problem: Exception | None = None
    for name in FILES[table]:
        path = f"{folder}/{name}.{kind}"
        try:
            return spark.read.csv(path, header=True) if kind == "csv" else spark.read.format(kind).load(path)
        except Exception as error:  # a missing first choice falls through to the next file name
            if "PATH_NOT_FOUND" not in str(error):
                raise
            problem = error
    raise FileNotFoundError(f"{table}: none of {FILES[table]} in {folder}") from problem


def load_coverage(spark: SparkSession, folder: str, kind: str = "csv", sample_rows: int | None = None) -> DataFrame:
    df = with_lattice(canonical(_read(spark, folder, "coverage", kind), "coverage"))
    return df.limit(sample_rows) if sample_rows else df


def load_gis(spark: SparkSession, folder: str, kind: str = "csv", on_air_only: bool = False) -> DataFrame:
    df = canonical(_read(spark, folder, "cell_gis", kind), "cell_gis")
    return df.where(F.col("on_air")) if on_air_only and "on_air" in df.columns else df


def with_rings(hulls: DataFrame) -> DataFrame:
    """One row per outer ring: a cell with a MULTIPOLYGON has several."""
    return hulls.withColumn("ring", F.explode(rings.parse_wkt_polygons(F.col("wkt")))).drop("wkt")


def with_shapes(hulls: DataFrame) -> DataFrame:
    """One row per outline with all its parts and holes as ``shape``; rows without a readable polygon are dropped."""
    return hulls.withColumn("shape", shapes.parse_wkt(F.col("wkt"))).where(F.col("shape").isNotNull()).drop("wkt")


def load_hulls(spark: SparkSession, folder: str, kind: str = "csv") -> DataFrame:
    return with_shapes(canonical(_read(spark, folder, "hulls", kind), "hulls"))


def known_relations(relations: DataFrame, gis: DataFrame) -> DataFrame:
    """Relations whose two ends are in the inventory."""
    cells = gis.select("cell_name").distinct()
    out = relations.join(cells, "cell_name", "left_semi")
    return out.join(cells.withColumnRenamed("cell_name", "to_cell_name"), "to_cell_name", "left_semi")


def load_relations(spark: SparkSession, folder: str, kind: str = "csv", gis: DataFrame | None = None) -> DataFrame:
    df = canonical(_read(spark, folder, "relations", kind), "relations")
    return known_relations(df, gis) if gis is not None else df


def load_boundary(spark: SparkSession, path: str) -> DataFrame:
    """Boundary polygons, one row per part with its outer ring and its shape with holes: a GeoJSON document over any
    number of lines, or lines of WKT or GeoJSON.

    A file without any polygon is an error, because clipping to it would remove everything.
    """
    files = spark.read.text(path, wholetext=True)  # boundaries are small
    line = F.explode(F.split("value", r"\r?\n")).alias("line")
    wkt = shapes.parse_wkt(F.col("line"))
    of_line = F.coalesce(F.when(wkt.isNotNull(), F.array(wkt)), shapes.parse_geojson(F.col("line")))
    of_lines = files.select("value", line).select(F.explode(of_line).alias("shape"))
    of_files = files.select(F.explode(shapes.parse_geojson(F.col("value"))).alias("shape"))
    for found in (of_lines, of_files):
        if not found.isEmpty():
            part = F.explode(F.array_distinct(F.transform("shape", lambda r: r["part"])))
            parts = found.withColumn("_p", part).withColumn("shape", F.filter("shape", lambda r: r["part"] == F.col("_p"))).drop("_p")
            return parts.withColumn("ring", F.col("shape")[0]["ring"])
    raise ValueError(f"boundary: no polygon in {path}")


def load_jdbc(
    spark: SparkSession, url: str, query: str, table: str, properties: dict | None = None,
    partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32,
) -> DataFrame:
    """Canonical table from a database; large tables are read in parallel by a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) t")
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return canonical(reader.load(), table)


def load_jdbc_hulls(spark: SparkSession, url: str, relation: str, geometry: str = "geometry", **options) -> DataFrame:
    """Outlines from a spatial database; the geometry travels as WKT."""
    query = f"SELECT cell_name, ST_AsText({geometry}) AS wkt FROM {relation}"
    return with_shapes(load_jdbc(spark, url, query, "hulls", **options))


class Source:
    """The four tables from files or from a database, narrowed for each detector."""

    def __init__(self, spark: SparkSession, kind: str = "csv", folder: str | None = None, url: str | None = None, queries: dict | None = None, **options):
        if kind not in ("csv", "parquet", "postgres", "mixed"):
            raise ValueError(f"unknown source kind {kind!r}")
        self.spark, self.folder, self.url, self.queries, self.options = spark, folder, url, queries or {}, options
        self.kind = "csv" if kind == "mixed" else kind
        if self.kind == "postgres" and not url:
            raise ValueError("a postgres source needs a url")
        if self.kind != "postgres" and not folder:
            raise ValueError("a file source needs a folder")

    def _query(self, table: str) -> str:
        return f"SELECT * FROM {self.queries.get(table, table)}"

    def coverage(self, band: str | None = None) -> DataFrame:
        if self.kind == "postgres":
            df = with_lattice(load_jdbc(self.spark, self.url, self._query("coverage"), "coverage", **self.options))
        else:
            df = load_coverage(self.spark, self.folder, self.kind)
        return df.where(F.col("band") == band) if band else df

    def gis(self, on_air_only: bool = False) -> DataFrame:
        if self.kind == "postgres":
            df = load_jdbc(self.spark, self.url, self._query("cell_gis"), "cell_gis", **self.options)
            return df.where(F.col("on_air")) if on_air_only and "on_air" in df.columns else df
        return load_gis(self.spark, self.folder, self.kind, on_air_only)

    def relations(self, known_only: bool = False) -> DataFrame:
        gis = self.gis() if known_only else None
        if self.kind == "postgres":
            df = load_jdbc(self.spark, self.url, self._query("relations"), "relations", **self.options)
            return known_relations(df, gis) if gis is not None else df
        return load_relations(self.spark, self.folder, self.kind, gis)

    def planning_relations(self) -> DataFrame:
        """Relations with a numeric identity at both ends."""
        return self.relations().where(F.col("pci").isNotNull() & F.col("to_pci").isNotNull())

    def hulls(self) -> DataFrame:
        """Outlines with band, identity and site from the inventory."""
        if self.kind == "postgres":
            df = load_jdbc_hulls(self.spark, self.url, self.queries.get("hulls", "cell_hulls"), **self.options)
        else:
            df = load_hulls(self.spark, self.folder, self.kind)
        known = [c for c in ("band", "pci", "site") if c in self.gis().columns]
        return df.drop(*known).join(self.gis().select("cell_name", *known), "cell_name", "left")


def open_source(spark: SparkSession, kind: str, **options) -> Source:
    """csv, parquet or postgres; mixed is read as csv."""
    return Source(spark, kind, **options)
