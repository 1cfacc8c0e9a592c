"""Sinks: tables as CSV or Parquet, regions as GeoJSON lines, cached environment classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellscape.functions import rings, shapes
from cellscape.operators.environment import classify_environment
from cellscape.params import EnvironmentRules


def flat(df: DataFrame) -> DataFrame:
    """Lists joined with commas and rings as WKT, for text formats."""
    columns = []
    for name, kind in df.dtypes:
        if name == "ring":
            columns.append(rings.to_wkt(F.col(name)).alias("geometry"))
        elif name == "shape":
            columns.append(shapes.to_wkt(F.col(name)).alias("geometry"))
        elif kind.startswith("array<string"):
            columns.append(F.array_join(name, ",").alias(name))
        elif kind.startswith(("array", "struct", "map")):
            columns.append(F.to_json(name).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def write_table(df: DataFrame, path: str, kind: str = "csv", by: list[str] | None = None) -> None:
    """Overwrite a table; CSV gets a header even when there are no rows."""
    writer = (flat(df) if kind == "csv" else df).write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    if kind == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(kind).save(path)


def _feature(columns: list[str]) -> Column:
    """GeoJSON text of a row; the geometry comes from ``shape`` or ``ring``."""
    geometry = shapes.to_geojson_geometry(F.col("shape")) if "shape" in columns else rings.to_geojson_geometry(F.col("ring"))
    properties = F.struct(*[F.col(c) for c in columns if c not in ("ring", "shape")])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def to_feature(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    return df.select(_feature(df.columns).alias("value"))


def write_geojson(df: DataFrame, path: str, by_band: bool = False) -> None:
    """GeoJSON lines; an empty result still replaces what was there before."""
    if by_band:
        lines = df.select("band", _feature(df.columns).alias("value"))
        lines.write.mode("overwrite").partitionBy("band").text(path)
    else:
        to_feature(df).write.mode("overwrite").text(path)


def cached_environment(spark: SparkSession, gis: DataFrame, path: str, rules: EnvironmentRules = EnvironmentRules()) -> DataFrame:
    """Stored environment classes, derived anew when the inventory has a cell they lack."""
    try:
        stored = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        stored = None
    if stored is not None and gis.join(stored, "cell_name", "left_anti").isEmpty():
        return stored
    classify_environment(gis, rules).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
