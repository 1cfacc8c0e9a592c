"""Polygon outlines as array<struct<lon,lat>> columns: parsing, area, movement.

Rings are closed (first point repeated last) and hold the outer boundary only; ``shapes`` has parts and holes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS84 ellipsoid and UTM scale.
SEMI_MAJOR_M = 6_378_137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
RING_TYPE = "array<struct<lon:double,lat:double>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; lambda bodies are not optimised for repeated terms."""
    return F.transform(F.array(value), body)[0]


def parse_wkt_polygon(wkt: Column) -> Column:
    """Outer ring of a WKT POLYGON; null for anything else."""
    return ring_of(F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*Z?\s*\(\s*\(([^()]*)\)", 1))


def parse_wkt_polygons(wkt: Column) -> Column:
    """Outer rings of a WKT POLYGON or MULTIPOLYGON; null for anything else, also if one of the rings is broken."""
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(\s*\(([^()]*)\)"), 1)
    found = F.transform(bodies, ring_of)
    good = wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\b") & (F.size(found) > 0) & F.forall(found, lambda r: r.isNotNull())
    return F.when(good, found)


def ring_of(body: Column) -> Column:
    points = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(
        points,
        lambda p: F.struct(p[0].try_cast("double").alias("lon"), F.get(p, F.lit(1)).try_cast("double").alias("lat")),
    )
    good = F.forall(ring, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull()) & (F.size(ring) >= 4)
    return F.when((body != "") & good, ring)


def parse_geojson_polygons(text: Column) -> Column:
    """Outer rings of all Polygons and MultiPolygons of a GeoJSON geometry, Feature or FeatureCollection; null for other text."""
    shape = "struct<type:string,coordinates:string>"
    doc = F.from_json(text, f"type string, coordinates string, geometry {shape}, features array<struct<geometry:{shape}>>")
    own = F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates")), doc["geometry"])
    every = F.concat(own, F.coalesce(F.transform(doc["features"], lambda f: f["geometry"]), F.array().cast(f"array<{shape}>")))
    points = lambda polygon: F.transform(polygon[0], lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    none = F.array().cast(f"array<{RING_TYPE}>")

    def outer(g: Column) -> Column:
        single, several = F.from_json(g["coordinates"], "array<array<array<double>>>"), F.from_json(g["coordinates"], "array<array<array<array<double>>>>")
        return F.coalesce(F.when(g["type"] == "Polygon", F.array(points(single))).when(g["type"] == "MultiPolygon", F.transform(several, points)), none)

    found = F.filter(F.flatten(F.transform(every, outer)), lambda r: r.isNotNull())
    return F.when(F.size(found) > 0, found)


def parse_geojson_polygon(text: Column) -> Column:
    """Outer ring of a GeoJSON Polygon geometry or of a feature holding one."""
    coordinates = F.coalesce(
        F.get_json_object(text, "$.geometry.coordinates[0]"), F.get_json_object(text, "$.coordinates[0]")
    )
    ring = F.from_json(coordinates, "array<array<double>>")
    return F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def to_wkt(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))


def to_geojson_geometry(ring: Column) -> Column:
    """struct that serialises as a GeoJSON Polygon geometry."""
    return F.struct(
        F.lit("Polygon").alias("type"),
        F.array(F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))).alias("coordinates"),
    )


def edges(ring: Column) -> Column:
    """array<struct<a,b>> of the consecutive vertex pairs."""
    return F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1),
        F.slice(ring, 2, F.size(ring) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def utm_central_meridian(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 6.0) * 6.0 - 177.0


def transverse_mercator(lon: Column, lat: Column, central_meridian: Column) -> Column:
    """struct(x, y) in metres: ellipsoidal transverse Mercator, third-order series in n."""
    n = FLATTENING / (2 - FLATTENING)
    rectifying = SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    ecc = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(lat))
    scale = UTM_SCALE * rectifying

    def angles(p):
        return F.struct(
            F.atan2(p["t"], F.cos(p["dl"])).alias("xi"),
            F.atanh(F.sin(p["dl"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta"),
        )

    def plane(p):
        x, y = p["eta"], p["xi"]
        for j, a in enumerate(alphas, start=1):
            x = x + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            y = y + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return F.struct((scale * x).alias("x"), (scale * y).alias("y"))

    start = let(sin_lat, lambda v: F.struct(
        F.sinh(F.atanh(v) - ecc * F.atanh(ecc * v)).alias("t"), F.radians(lon - central_meridian).alias("dl")
    ))
    return let(let(start, angles), plane)


def mean_lon(ring: Column) -> Column:
    open_ring = F.slice(ring, 1, F.size(ring) - 1)
    return total(F.transform(open_ring, lambda p: p["lon"])) / F.size(open_ring)


def project(ring: Column, central_meridian: Column) -> Column:
    return F.transform(ring, lambda p: transverse_mercator(p["lon"], p["lat"], central_meridian))


def shoelace(points: Column) -> Column:
    """Absolute area of a projected ring of struct(x, y), taken about its first point."""

    def area(ring):
        origin = ring[0]

        def term(e):
            ax, ay = e["a"]["x"] - origin["x"], e["a"]["y"] - origin["y"]
            bx, by = e["b"]["x"] - origin["x"], e["b"]["y"] - origin["y"]
            return ax * by - bx * ay

        return F.abs(total(F.transform(edges(ring), term))) / 2

    return let(points, area)


def area_km2(ring: Column) -> Column:
    """Area in the UTM zone of the ring, in square kilometres."""
    return shoelace(let(utm_central_meridian(mean_lon(ring)), lambda m: project(ring, m))) / 1e6


def planar_centroid(points: Column) -> Column:
    """Area centroid of a ring of struct(x, y)."""

    def moments(ring):
        origin = ring[0]

        def part(weigh):
            def term(e):
                ax, ay = e["a"]["x"] - origin["x"], e["a"]["y"] - origin["y"]
                bx, by = e["b"]["x"] - origin["x"], e["b"]["y"] - origin["y"]
                return (ax * by - bx * ay) * weigh(ax, ay, bx, by)

            return total(F.transform(edges(ring), term))

        return F.struct(
            origin.alias("o"),
            part(lambda ax, ay, bx, by: F.lit(1.0)).alias("twice"),
            part(lambda ax, ay, bx, by: ax + bx).alias("cx"),
            part(lambda ax, ay, bx, by: ay + by).alias("cy"),
        )

    def centre(m):
        def shift(c):
            return F.when(F.abs(m["twice"]) < 1e-12, 0.0).otherwise(m[c] / (3 * m["twice"]))

        return F.struct((m["o"]["x"] + shift("cx")).alias("x"), (m["o"]["y"] + shift("cy")).alias("y"))

    return let(let(points, moments), centre)


def centroid(ring: Column) -> Column:
    """Area centroid in degrees as struct(x=lon, y=lat)."""
    return planar_centroid(F.transform(ring, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))


def ring_bounds(ring: Column) -> Column:
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("min_lon"),
        F.array_max(lons).alias("max_lon"),
        F.array_min(lats).alias("min_lat"),
        F.array_max(lats).alias("max_lat"),
    )


def scale_about(ring: Column, lon: Column, lat: Column, factor: Column) -> Column:
    return F.transform(
        ring,
        lambda p: F.struct(
            (lon + (p["lon"] - lon) * factor).alias("lon"), (lat + (p["lat"] - lat) * factor).alias("lat")
        ),
    )


def rotate_about(ring: Column, lon: Column, lat: Column, clockwise_deg: Column) -> Column:
    """Planar rotation about a point in local metres."""
    shrink = F.cos(F.radians(lat))
    angle = F.radians(-clockwise_deg)

    def turn(p):
        x, y = (p["lon"] - lon) * shrink, p["lat"] - lat
        return F.struct(
            (lon + (x * F.cos(angle) - y * F.sin(angle)) / shrink).alias("lon"),
            (lat + x * F.sin(angle) + y * F.cos(angle)).alias("lat"),
        )

    return F.transform(ring, turn)
