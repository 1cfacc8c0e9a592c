"""Areas of several parts with holes: one column type, read and written as WKT and GeoJSON.

A shape is an array of rings, each with the number of its part and a hole flag.  A point is inside if a ray from
it crosses the rings an odd number of times, so holes count as outside and parts need no order.  Rings are
closed; their direction does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellscape.functions import rings
from cellscape.functions.rings import RING_TYPE, let, total

RING_STRUCT = f"struct<part:int,hole:boolean,ring:{RING_TYPE}>"
SHAPE_TYPE = f"array<{RING_STRUCT}>"


def _entry(part, hole, ring: Column) -> Column:
    """Struct of one ring; its field types are cast so that all sources agree."""
    return F.struct(part.alias("part"), hole.alias("hole"), ring.alias("ring")).cast(RING_STRUCT)


def of_ring(ring: Column) -> Column:
    """Shape of one part without holes; null for a null ring."""
    return F.when(ring.isNotNull(), F.array(_entry(F.lit(0), F.lit(False), ring)))


def with_shape(df: DataFrame) -> DataFrame:
    """``df`` with column ``shape``; tables that hold one outer ring per row get it from ``ring``."""
    return df if "shape" in df.columns else df.withColumn("shape", of_ring(F.col("ring"))).drop("ring")


def _polygons(rings_by_part: Column) -> Column:
    """Array of polygons, each an array of rings, as one shape."""
    return F.flatten(F.transform(rings_by_part, lambda polygon, p: F.transform(polygon, lambda ring, r: _entry(p, r > 0, ring))))


def parse_wkt(wkt: Column) -> Column:
    """Shape of a WKT POLYGON or MULTIPOLYGON; null for anything else, also if one of its rings is broken."""
    polygon = r"(\(\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*\))"
    parts = F.regexp_extract_all(wkt, F.lit(polygon), 1)
    shape = _polygons(F.transform(parts, lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"\(([^()]*)\)"), 1), rings.ring_of)))
    good = wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\b") & (F.size(shape) > 0) & F.forall(shape, lambda r: r["ring"].isNotNull())
    return F.when(good, shape)


def parse_geojson(text: Column) -> Column:
    """All Polygons and MultiPolygons of a geometry, Feature or FeatureCollection as array of shapes; null for other text."""
    geometry = "struct<type:string,coordinates:string>"
    doc = F.from_json(text, f"type string, coordinates string, geometry {geometry}, features array<struct<geometry:{geometry}>>")
    own = F.array(F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates")), doc["geometry"])
    every = F.concat(own, F.coalesce(F.transform(doc["features"], lambda f: f["geometry"]), F.array().cast(f"array<{geometry}>")))
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    outlines = lambda polygon: F.transform(polygon, points)

    def shape(g: Column) -> Column:
        single, several = F.from_json(g["coordinates"], "array<array<array<double>>>"), F.from_json(g["coordinates"], "array<array<array<array<double>>>>")
        return F.when(g["type"] == "Polygon", _polygons(F.array(outlines(single)))).when(g["type"] == "MultiPolygon", _polygons(F.transform(several, outlines)))

    found = F.filter(F.transform(every, shape), lambda s: s.isNotNull() & (F.size(s) > 0))
    return F.when(F.size(found) > 0, found)


def _by_part(shape: Column) -> Column:
    """Rings of each part, the outer one first."""
    parts = F.array_sort(F.array_distinct(F.transform(shape, lambda r: r["part"])))
    own = lambda p, hole: F.transform(F.filter(shape, lambda r: (r["part"] == p) & (r["hole"] == hole)), lambda r: r["ring"])
    return F.transform(parts, lambda p: F.concat(own(p, F.lit(False)), own(p, F.lit(True))))


def to_wkt(shape: Column) -> Column:
    points = lambda ring: F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    polygon = lambda part: F.concat(F.lit("("), F.array_join(F.transform(part, lambda r: F.concat(F.lit("("), points(r), F.lit(")"))), ", "), F.lit(")"))
    texts = F.transform(_by_part(shape), polygon)
    return F.when(F.size(texts) == 1, F.concat(F.lit("POLYGON "), texts[0])).when(
        F.size(texts) > 1, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(texts, ", "), F.lit(")"))
    )


def to_geojson_geometry(shape: Column) -> Column:
    """struct that serialises as a GeoJSON MultiPolygon geometry."""
    points = lambda ring: F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.struct(F.lit("MultiPolygon").alias("type"), F.transform(_by_part(shape), lambda part: F.transform(part, points)).alias("coordinates"))


def edges(shape: Column) -> Column:
    """array<struct<a,b>> of the edges of all rings."""
    return F.flatten(F.transform(shape, lambda r: rings.edges(r["ring"])))


def corners(shape: Column) -> Column:
    return F.flatten(F.transform(shape, lambda r: r["ring"]))


def bounds(shape: Column) -> Column:
    return rings.ring_bounds(corners(shape))


def contains(shape: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule; a point on a border may count either way."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]
        return ((ax <= lon) != (bx <= lon)) & (ay + (by - ay) * (lon - ax) / F.when(ax != bx, bx - ax) < lat)

    return F.size(F.filter(edges(shape), crosses)) % 2 == 1


def meridian(shape: Column) -> Column:
    """Central meridian of the UTM zone of the mean corner of the first ring."""
    return rings.utm_central_meridian(rings.mean_lon(shape[0]["ring"]))


def project(shape: Column, central_meridian: Column) -> Column:
    """array<struct<hole,points>> in metres."""
    return F.transform(shape, lambda r: F.struct(r["hole"].alias("hole"), rings.project(r["ring"], central_meridian).alias("points")))


def planar_area(projected: Column) -> Column:
    return total(F.transform(projected, lambda r: F.when(r["hole"], -1.0).otherwise(1.0) * rings.shoelace(r["points"])))


def area_km2(shape: Column) -> Column:
    """Area in the UTM zone of the shape, in square kilometres, without the holes."""
    return planar_area(let(meridian(shape), lambda m: project(shape, m))) / 1e6


def planar_centroid(projected: Column) -> Column:
    """Area centroid as struct(x, y)."""

    def weighed(r: Column) -> Column:
        def part(c: Column) -> Column:
            w = F.when(r["hole"], -1.0).otherwise(1.0) * rings.shoelace(r["points"])
            return F.struct(w.alias("w"), (w * c["x"]).alias("x"), (w * c["y"]).alias("y"))

        return let(rings.planar_centroid(r["points"]), part)

    def centre(t: Column) -> Column:
        whole = total(F.transform(t, lambda v: v["w"]))
        return F.struct((total(F.transform(t, lambda v: v["x"])) / whole).alias("x"), (total(F.transform(t, lambda v: v["y"])) / whole).alias("y"))

    # a single ring without area still has a centre, its first point
    flat = F.forall(projected, lambda r: rings.shoelace(r["points"]) < 1e-12)
    return F.when(flat, rings.planar_centroid(projected[0]["points"])).otherwise(let(F.transform(projected, weighed), centre))


def centroid(shape: Column) -> Column:
    """Area centroid in degrees as struct(x=lon, y=lat)."""
    plane = F.transform(shape, lambda r: F.struct(r["hole"].alias("hole"), F.transform(r["ring"], lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("points")))
    return planar_centroid(plane)


def _slabs(projected: Column, origin: Column) -> Column:
    """Edges as array<struct<l,r,yl,yr,s>> from left to right; s is +1 for upper edges and -1 for lower ones.

    At every x the edges' heights, added with their signs, give the length of the shape's cut.
    """

    def of_ring(r: Column) -> Column:
        # twice the signed area decides the direction, a hole is turned round
        signed = total(F.transform(rings.edges(r["points"]), lambda e: (e["a"]["x"] - origin["x"]) * (e["b"]["y"] - origin["y"]) - (e["b"]["x"] - origin["x"]) * (e["a"]["y"] - origin["y"])))
        turn = F.signum(signed) * F.when(r["hole"], -1.0).otherwise(1.0)

        def slab(e: Column, t: Column) -> Column:
            ax, ay, bx, by = (e[p][c] - origin[c] for p in "ab" for c in "xy")
            left = ax < bx
            pick = lambda u, v: F.when(left, u).otherwise(v)
            return F.struct(pick(ax, bx).alias("l"), pick(bx, ax).alias("r"), pick(ay, by).alias("yl"), pick(by, ay).alias("yr"), (t * pick(F.lit(-1.0), F.lit(1.0))).alias("s"))

        return let(turn, lambda t: F.transform(F.filter(rings.edges(r["points"]), lambda e: e["a"]["x"] != e["b"]["x"]), lambda e: slab(e, t)))

    return F.flatten(F.transform(projected, of_ring))


def _shared_under(e: Column, f: Column, floor: Column) -> Column:
    """Area above ``floor`` and below both of two edges."""
    at = lambda g, x: g["yl"] + (g["yr"] - g["yl"]) * (x - g["l"]) / (g["r"] - g["l"])

    def ends(x: Column) -> Column:
        return F.struct((x["b"] - x["a"]).alias("w"), *[at(g, x[c]).alias(n + c) for n, g in (("e", e), ("f", f)) for c in "ab"])

    def area(v: Column) -> Column:
        lower = (F.least(v["ea"], v["fa"]) + F.least(v["eb"], v["fb"])) / 2 - floor
        da, db = v["ea"] - v["fa"], v["eb"] - v["fb"]
        # where the edges cross, the lower of both is bent: its ends' chord misses a triangle
        bend = F.when((da > 0) & (db < 0) | (da < 0) & (db > 0), F.abs(da * db) / (2 * (F.abs(da) + F.abs(db)))).otherwise(0.0)
        return v["w"] * (lower + bend)

    shared = F.struct(F.greatest(e["l"], f["l"]).alias("a"), F.least(e["r"], f["r"]).alias("b"))
    return let(shared, lambda x: F.when(x["a"] < x["b"], let(ends(x), area)).otherwise(0.0))


def overlap_m2(a: Column, b: Column) -> Column:
    """Area that two projected shapes share, in square metres; any simple rings, several parts, holes.

    A shape is the signed sum of the strips below its edges, so the overlap is the signed sum over pairs of edges
    of the area below both: trapezoids in closed form, without building the clipped polygon.
    """

    def over(s: Column) -> Column:
        floor = F.least(F.array_min(F.transform(s["a"], lambda g: F.least(g["yl"], g["yr"]))), F.array_min(F.transform(s["b"], lambda g: F.least(g["yl"], g["yr"]))))

        def summed(floor: Column) -> Column:
            row = lambda e: F.aggregate(s["b"], F.lit(0.0), lambda t, f: t + f["s"] * _shared_under(e, f, floor))
            return F.aggregate(s["a"], F.lit(0.0), lambda t, e: t + e["s"] * row(e))

        return let(floor, summed)

    origin = a[0]["points"][0]
    slabs = let(origin, lambda o: F.struct(_slabs(a, o).alias("a"), _slabs(b, o).alias("b")))
    return F.greatest(F.coalesce(let(slabs, over), F.lit(0.0)), F.lit(0.0))
