"""Spatial joins, density clustering, hulls and lattice covers without an outside index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from cellscape.functions import lattice, rings, shapes
from cellscape.functions.geo import EARTH_RADIUS_M, haversine_m
from cellscape.operators.components import connected_components
from cellscape.session import cut_lineage

DEGREE_M = EARTH_RADIUS_M * math.pi / 180
MAX_COLUMNS = 720
RING = ArrayType(StructType().add("lon", DoubleType()).add("lat", DoubleType()))


def _columns(row: Column, height_deg: float) -> Column:
    """Number of buckets round the globe in a latitude row, each at least ``height_deg`` wide on the ground; 1 at a pole."""
    highest = F.least(F.greatest(F.abs(row * height_deg), F.abs((row + 1) * height_deg)), F.lit(90.0))
    return F.greatest(F.floor(360.0 / height_deg * F.cos(F.radians(highest))), F.lit(1)).cast("long")


def _lon_span(lat: Column, reach_deg: Column | float) -> Column:
    """Degrees of longitude that a circle can reach to either side; 180 if it holds a pole."""
    far = F.abs(lat) + reach_deg
    return F.when(far < 90.0, F.least(reach_deg / F.cos(F.radians(far)), F.lit(180.0))).otherwise(180.0)


def _column(lon: Column, columns: Column) -> Column:
    """Bucket of a longitude; the last one borders on the first."""
    return F.pmod(F.floor((lon + 180.0) * columns / 360.0), columns)


def _columns_near(lon: Column, span: Column, columns: Column) -> Column:
    """Buckets, each once, that lie within ``span`` degrees of a longitude."""
    first = F.floor((lon + 180.0 - span) * columns / 360.0)
    last = F.least(F.floor((lon + 180.0 + span) * columns / 360.0), first + columns - 1)
    return F.transform(F.sequence(first, last), lambda x: F.pmod(x, columns))


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs within ``radius_m``; both sides carry lat/lon as (llat, llon) and (rlat, rlon).

    Right rows sit in one bucket as wide as the radius; left rows visit the buckets their
    circle can touch, also across the antimeridian and a pole, so the join is an equi-join
    on small buckets.  Adds ``distance_m``.
    """
    keys = keys or []
    h = radius_m / DEGREE_M * 1.0001
    row = F.floor(F.col("rlat") / h)
    right = right.withColumn("_by", row).withColumn("_bx", _column(F.col("rlon"), _columns(row, h)))
    own = F.floor(F.col("llat") / h)
    left = left.withColumn("_by", F.explode(F.sequence(own - 1, own + 1)))
    left = left.withColumn("_bx", F.explode(_columns_near(F.col("llon"), _lon_span(F.col("llat"), h), _columns(F.col("_by"), h))))
    pairs = left.join(right, [*keys, "_by", "_bx"])
    distance = haversine_m(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m).drop("_bx", "_by")


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    metric: str = "haversine",
    tie: str = "pid",
    finest_deg: float = 0.005,
    step: int = 2,
    keys: list[str] | None = None,
) -> DataFrame:
    """The ``k`` nearest points of every query, exactly; ties go to the least ``tie``.

    ``queries`` has (qid, llat, llon), ``points`` (pid, rlat, rlon).  A pyramid of bucket
    counts gives each query the finest level whose 3x3 block already holds k points; that
    bounds the k-th distance, hence the buckets to search.  A dense bucket is visited only
    by the few queries too sparse for the next finer level, so pair counts stay linear.  Points of one
    position meet a query as one row until their position is known to be near enough.
    ``metric`` is haversine metres, where bucket columns go round the globe, or "planar"
    degrees; adds ``distance`` and ``rank``.
    """
    keys, globe = keys or [], metric == "haversine"
    levels = 1 + math.ceil(math.log(360.0 / finest_deg, step))
    level_ids = F.sequence(F.lit(0), F.lit(levels - 1))
    size = F.lit(finest_deg) * F.pow(F.lit(float(step)), F.col("_l"))
    columns = F.greatest(F.floor(360.0 / size), F.lit(1)).cast("long")
    reach = size * (2 * math.sqrt(2) + 1e-6)
    if globe:  # buckets of a whole number of columns can be wider than high
        reach = 2 * F.sqrt(size * size + F.pow(360.0 / columns, 2)) * (1 + 1e-6)

    def bucketed(df: DataFrame, lat: str, lon: str, at: Column = level_ids) -> DataFrame:
        df = df.withColumn("_l", F.explode(at))
        return df.withColumn("_by", F.floor(F.col(lat) / size)).withColumn("_bx", _column(F.col(lon), columns) if globe else F.floor(F.col(lon) / size))

    around = F.sequence(F.lit(-1), F.lit(1))
    beside = F.transform(around, lambda d: F.col("_bx") + d)
    if globe:
        beside = F.array_distinct(F.transform(beside, lambda x: F.pmod(x, columns)))
    # Points of one position are searched as one row with their number; only those of near positions are looked up.
    place = [*keys, "rlat", "rlon"]
    positions = cut_lineage(points.groupBy(*place).agg(F.count(F.lit(1)).alias("_m")))
    counts = bucketed(positions, "rlat", "rlon").groupBy(*keys, "_l", "_by", "_bx").agg(F.sum("_m").alias("_c"))
    blocks = (
        counts.withColumn("_dy", F.explode(around))
        .withColumn("_bx", F.explode(beside))
        .groupBy(*keys, "_l", (F.col("_by") + F.col("_dy")).alias("_by"), "_bx")
        .agg(F.sum("_c").alias("_c"))
    )
    # Positions are written small, their buckets on all levels are not: merged, they never pass through the driver.
    seen = bucketed(queries.select(*keys, "qid", "llat", "llon"), "llat", "llon").join(
        blocks.hint("merge"), [*keys, "_l", "_by", "_bx"], "left"
    )
    enough = F.col("_c") >= k
    if globe:  # a search round a pole visits every column, so it takes a level with few
        enough &= (F.abs(F.col("llat")) + reach < 89.0) | (columns <= MAX_COLUMNS)
    chosen = seen.groupBy(*keys, "qid", "llat", "llon").agg(
        F.coalesce(F.min(F.when(enough, F.col("_l"))), F.lit(levels - 1)).alias("_l")
    )
    chosen = cut_lineage(chosen)
    used = [F.lit(r["_l"]) for r in chosen.select("_l").distinct().collect()]  # at most one row per level
    placed = bucketed(positions, "rlat", "rlon", F.array(*used) if used else F.array().cast("array<int>"))
    search = chosen.withColumn(
        "_by",
        F.explode(F.sequence(F.floor((F.col("llat") - reach) / size), F.floor((F.col("llat") + reach) / size))),
    ).withColumn(
        "_bx",
        F.explode(
            _columns_near(F.col("llon"), _lon_span(F.col("llat"), reach), columns)
            if globe
            else F.sequence(F.floor((F.col("llon") - reach) / size), F.floor((F.col("llon") + reach) / size))
        ),
    )
    if globe:
        distance = haversine_m(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    else:
        dy, dx = F.col("rlat") - F.col("llat"), F.col("rlon") - F.col("llon")
        distance = F.sqrt(dx * dx + dy * dy)
    pairs = search.join(placed.hint("merge"), [*keys, "_l", "_by", "_bx"]).withColumn("distance", distance).drop("_l", "_bx", "_by")
    # a position can hold one of the nearest if fewer than k points lie strictly closer
    upto = Window.partitionBy(*keys, "qid").orderBy("distance")
    own = Window.partitionBy(*keys, "qid", "distance")
    closer = pairs.withColumn("_upto", F.sum("_m").over(upto) - F.sum("_m").over(own)).where(F.col("_upto") < k).drop("_upto", "_m")
    nearest = Window.partitionBy(*keys, "qid").orderBy("distance", tie)
    ranked = closer.join(points, place).withColumn("rank", F.row_number().over(nearest))
    return ranked.where(F.col("rank") <= k)


def nearest_owners(queries: DataFrame, points: DataFrame, owner: str, k: int, finest_deg: float = 0.005, step: int = 2) -> DataFrame:
    """The ``k`` owners with the nearest points to every query, exactly: (qid, llat, llon, owner, distance, rank).

    ``queries`` has (qid, llat, llon), ``points`` (owner, rlat, rlon); distances are great circles in metres, an
    owner counts by its nearest point, ties go to the least owner.  A pyramid counts the distinct owners per bucket.  A
    query takes the finest level where a bucket beside it holds k owners; that bounds the distance of the k-th
    owner, so one search of the buckets in reach is complete, however many points the near owners have.  With fewer
    than k owners in the table all of them are returned.  Only points of searched buckets meet queries, and their
    distances shrink to one per query and owner before the shuffle.
    """
    levels = 1 + math.ceil(math.log(360.0 / finest_deg, step))
    size = F.lit(finest_deg) * F.pow(F.lit(float(step)), F.col("_l"))
    columns = F.greatest(F.floor(360.0 / size), F.lit(1)).cast("long")
    reach = 2 * F.sqrt(size * size + F.pow(360.0 / columns, 2)) * (1 + 1e-6)

    def bucketed(df: DataFrame, lat: str, lon: str) -> DataFrame:
        return df.withColumn("_by", F.floor(F.col(lat) / size)).withColumn("_bx", _column(F.col(lon), columns))

    def at_all_levels(df: DataFrame) -> DataFrame:
        return df.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))

    bucket = ["_l", "_by", "_bx"]
    wanted = min(k, points.select(owner).distinct().count())
    held = bucketed(at_all_levels(points.select(owner, "rlat", "rlon")), "rlat", "rlon").select(*bucket, owner).distinct()
    full = held.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= wanted).drop("_c")
    around = F.sequence(F.lit(-1), F.lit(1))
    beside = F.array_distinct(F.transform(around, lambda d: F.pmod(F.col("_bx") + d, columns)))
    near_full = full.withColumn("_dy", F.explode(around)).withColumn("_bx", F.explode(beside)).select("_l", (F.col("_by") + F.col("_dy")).alias("_by"), "_bx").distinct()
    asked = queries.select("qid", "llat", "llon")
    seen = bucketed(at_all_levels(asked), "llat", "llon").join(near_full, bucket, "left_semi")
    # a search round a pole visits every column, so it takes a level with few
    seen = seen.where((F.abs(F.col("llat")) + reach < 89.0) | (columns <= MAX_COLUMNS))
    chosen = seen.groupBy("qid").agg(F.min("_l").alias("_l"))
    chosen = asked.join(chosen, "qid", "left").withColumn("_l", F.coalesce("_l", F.lit(levels - 1)))
    rows = F.sequence(F.floor((F.col("llat") - reach) / size), F.floor((F.col("llat") + reach) / size))
    search = chosen.withColumn("_by", F.explode(rows)).withColumn("_bx", F.explode(_columns_near(F.col("llon"), _lon_span(F.col("llat"), reach), columns)))
    search = cut_lineage(search)
    used = [F.lit(r["_l"]) for r in search.select("_l").distinct().collect()]  # at most one row per level
    placed = bucketed(points.select(owner, "rlat", "rlon", F.explode(F.array(*used) if used else F.array().cast("array<int>")).alias("_l")), "rlat", "rlon").join(search.select(*bucket).distinct(), bucket, "left_semi")
    distance = haversine_m(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    least = search.join(placed, bucket).groupBy("qid", "llat", "llon", owner).agg(F.min(distance).alias("distance"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", owner)))
    return ranked.where(F.col("rank") <= k)


def dbscan(points: DataFrame, eps_m: float, min_points: int, keys: list[str] | None = None) -> DataFrame:
    """DBSCAN over (pid, lat, lon) by great-circle distance; adds ``cluster`` (null for noise).

    Points fall into cells whose diagonal is below eps, so a cell with ``min_points`` members
    is all core and one cluster piece; only points of sparser cells count their neighbours.
    Cells are linked through bounding circles of an 8x8 sub-division where those decide, and
    through point pairs only where they do not.  A cluster is named by its least core point;
    a border point joins the least cluster in reach.
    """
    keys = keys or []
    h = eps_m / DEGREE_M / math.sqrt(2) * 0.999
    row = F.floor(F.col("lat") / h)
    nearest_lat = F.least(F.abs(row * h), F.abs((row + 1) * h))
    nearest_lat = F.when(F.signum(row) != F.signum(row + 1), F.lit(0.0)).otherwise(nearest_lat)
    columns = F.greatest(F.ceil(360.0 / h * F.cos(F.radians(F.least(nearest_lat, F.lit(90.0))))), F.lit(1))
    w = 360.0 / columns
    lon = F.col("lon")
    inside = F.when((lon < -180.0) | (lon >= 180.0), F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).otherwise(lon)
    col = F.least(F.floor((lon + 180.0) / w), columns - 1)
    placed = points.select(*keys, "pid", "lat", inside.alias("lon")).withColumns({
        "cy": row,
        "cx": col,
        "sy": F.least(F.floor((F.col("lat") - row * h) / (h / 8)), F.lit(7)),
        "sx": F.least(F.floor((lon + 180.0 - col * w) / (w / 8)), F.lit(7)),
        "sh": F.lit(h / 8),
        "sw": w / 8,
    })
    placed = cut_lineage(placed)
    cell = [*keys, "cy", "cx"]
    filled = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    sized = placed.join(filled, cell)
    lonely = sized.where(F.col("_n") < min_points)
    as_left = lonely.select(*keys, F.col("pid").alias("lpid"), F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    as_right = placed.select(*keys, F.col("pid").alias("rpid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    near = cut_lineage(radius_join(as_left, as_right, eps_m, keys).select(*keys, "lpid", "rpid"))
    counted = near.groupBy(*keys, F.col("lpid").alias("pid")).agg(F.count(F.lit(1)).alias("_near"))
    marked = sized.join(counted, [*keys, "pid"], "left").withColumn(
        "core", (F.col("_n") >= min_points) | (F.coalesce("_near", F.lit(0)) >= min_points)
    )
    cores = cut_lineage(marked.where("core"))
    names = cut_lineage(cores.groupBy(*cell).agg(F.min("pid").alias("first")))
    links = _linked_cells(cores, names, keys, eps_m)
    merged = connected_components(links, keys).withColumnRenamed("node", "first")
    labelled = names.join(merged, [*keys, "first"], "left").select(
        *cell, F.coalesce("component", "first").alias("cluster")
    )
    # points of one name are one point with several places
    core_labels = cut_lineage(cores.join(labelled, cell).groupBy(*keys, "pid").agg(F.min("cluster").alias("cluster")))
    reach = near.join(core_labels.withColumnRenamed("pid", "rpid"), [*keys, "rpid"])
    border = reach.groupBy(*keys, F.col("lpid").alias("pid")).agg(F.min("cluster").alias("_border"))
    out = points.join(core_labels, [*keys, "pid"], "left").join(border, [*keys, "pid"], "left")
    return out.withColumn("cluster", F.coalesce("cluster", "_border")).drop("_border")


def _linked_cells(cores: DataFrame, names: DataFrame, keys: list[str], eps_m: float) -> DataFrame:
    """Pairs of cells (src, dst named by first core point) with core points within eps."""
    sub = cores.groupBy(*keys, "cy", "cx", "sy", "sx").agg(
        F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")
    )
    sub = sub.join(names, [*keys, "cy", "cx"]).withColumns({
        "llat": (F.col("a") + F.col("b")) / 2,
        "llon": (F.col("c") + F.col("d")) / 2,
    })
    corner = [haversine_m(F.col("llat"), F.col("llon"), F.col(y), F.col("c")) for y in ("a", "b")]
    sub = sub.withColumn("rho", F.greatest(*corner) * 1.0001).select(
        *keys, "cy", "cx", "sy", "sx", "first", "llat", "llon", "rho"
    )
    other = sub.select(
        *keys,
        *[F.col(c).alias("r" + c) for c in ("cy", "cx", "sy", "sx")],
        F.col("first").alias("dst"),
        F.col("llat").alias("rlat"),
        F.col("llon").alias("rlon"),
        F.col("rho").alias("rrho"),
    )
    pairs = radius_join(sub.withColumnRenamed("first", "src"), other, eps_m * 1.3, keys)
    pairs = cut_lineage(pairs.where(F.col("src") < F.col("dst")))
    slack = F.col("rho") + F.col("rrho")
    certain = pairs.where(F.col("distance_m") + slack <= eps_m).select(*keys, "src", "dst").distinct()
    unsure = pairs.where((F.col("distance_m") + slack > eps_m) & (F.col("distance_m") - slack <= eps_m))
    unsure = unsure.join(certain, [*keys, "src", "dst"], "left_anti").select(
        *keys, "cy", "cx", "sy", "sx", "rcy", "rcx", "rsy", "rsx", "src", "dst"
    )
    place = ["cy", "cx", "sy", "sx"]
    left = cores.select(*keys, *place, F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    right = cores.select(
        *keys, *[F.col(c).alias("r" + c) for c in place], F.col("lat").alias("rlat"), F.col("lon").alias("rlon")
    )
    checked = unsure.join(left, [*keys, *place]).join(right, [*keys, *["r" + c for c in place]])
    found = checked.where(haversine_m(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon")) <= eps_m)
    return certain.unionByName(found.select(*keys, "src", "dst")).distinct()


def convex_hulls(points: DataFrame, keys: list[str], bounded: bool = False, piece: int = 20_000) -> DataFrame:
    """Closed convex outline per group of (lon, lat) points; null with fewer than 3 corners.

    Unless the caller states that groups are bounded, each group is first cut into pieces of
    about ``piece`` points; the hull of the piece hulls is the hull of the group.
    """
    points = points.select(*keys, "lon", "lat").where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    schema = points.select(*keys, "lon", "lat").schema
    if not bounded:
        sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        pieces = F.ceil(F.col("_n") / F.lit(float(piece)))
        cut = points.join(sizes, keys).withColumn("_piece", F.pmod(F.xxhash64("lon", "lat"), pieces))
        points = cut.groupBy(*keys, "_piece").applyInPandas(_hull_points(keys), schema)
    # pieces are bounded, so a group is one array and a batch of groups one call
    corners = F.collect_list(F.struct("lon", "lat"))
    return points.groupBy(*keys).agg(corners.alias("_p")).select(*keys, _hull_rings("_p.lon", "_p.lat").alias("ring"))


def hull_of(xy: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull corners of a point set (monotone chain)."""
    points = sorted(set(map(tuple, np.asarray(xy, float).tolist())))
    if len(points) < 3:
        return np.array(points).reshape(-1, 2)

    def half(seq):
        chain: list[tuple[float, float]] = []
        for p in seq:
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


def _hull_points(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corners = hull_of(pdf[["lon", "lat"]].to_numpy())
        out = pd.DataFrame(corners, columns=["lon", "lat"])
        for i, key in enumerate(keys):
            out.insert(i, key, pdf[key].iloc[0])
        return out

    return run


@F.pandas_udf(RING)
def _hull_rings(lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Closed hull of every row's points; null with fewer than 3 corners."""
    out = []
    for x, y in zip(lon, lat):
        corners = hull_of(np.column_stack([x, y]))
        out.append([{"lon": float(a), "lat": float(b)} for a, b in [*corners, corners[0]]] if len(corners) >= 3 else None)
    return pd.Series(out, dtype=object)


def touch_spans(polygons: DataFrame, ring: str = "ring", precision: int = lattice.PRECISION) -> DataFrame:
    """The bins that a convex polygon touches as one span (ix, lo, hi) per lattice column."""
    nx, ny = lattice.bits(precision)
    w, h = 360.0 / 2**nx, 180.0 / 2**ny
    box = rings.ring_bounds(F.col(ring))
    out = polygons.withColumn(
        "ix",
        F.explode(F.sequence(lattice.lon_to_ix(box["min_lon"], precision), lattice.lon_to_ix(box["max_lon"], precision))),
    )
    x0, x1 = F.col("ix") * w - 180.0, (F.col("ix") + 1) * w - 180.0

    def clipped(e):
        ax, ay, bx, by = e["a"]["lon"], e["a"]["lat"], e["b"]["lon"], e["b"]["lat"]

        def lat_at(x):
            return F.when(bx == ax, ay).otherwise(ay + (by - ay) * (x - ax) / (bx - ax))

        lo, hi = F.greatest(F.least(ax, bx), x0), F.least(F.greatest(ax, bx), x1)
        upright = F.array(ay, by)
        return F.when(lo > hi, F.array().cast("array<double>")).when(ax == bx, upright).otherwise(
            F.array(lat_at(lo), lat_at(hi))
        )

    lats = F.flatten(F.transform(rings.edges(F.col(ring)), clipped))
    out = out.withColumn("_lats", lats).where(F.size("_lats") > 0)
    lo, hi = lattice.lat_to_iy(F.array_min("_lats"), precision), lattice.lat_to_iy(F.array_max("_lats"), precision)
    return out.withColumns({"lo": lo, "hi": hi}).drop("_lats", ring)


def cover_convex(polygons: DataFrame, ring: str = "ring", precision: int = lattice.PRECISION) -> DataFrame:
    """One row per lattice bin that a convex polygon touches, as (ix, iy)."""
    return touch_spans(polygons, ring, precision).withColumn("iy", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def cover_centres(polygons: DataFrame, keys: list[str] | None = None, precision: int = lattice.PRECISION) -> DataFrame:
    """One row per lattice bin whose centre lies inside a polygon (even-odd rule): (keys, ix, iy)."""
    from cellscape.operators import spans

    keys = keys or []
    covered = spans.cover_spans(shapes.with_shape(polygons), keys, precision)
    return spans.bins_of(spans.union(covered, keys))
