"""Sets of lattice bins as spans per column, and their algebra.

A set is a table (keys, ix, lo, hi): in column ix the bins lo to hi.  A polygon needs two rows per column it
crosses, however high it is.  Every operation is a sweep: spans become events at lo and behind hi, events of equal
place are added on the map side, and a running sum per (keys, ix) tells how many operands hold each stretch.
So the shuffle key holds the column, a region spreads over tasks, and a column has at most as many events
as the lattice has rows.  Bins are made only from a result, if at all.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellscape.functions import lattice, rings, shapes
from cellscape.operators.components import CODE_SHIFT, connected_components
from cellscape.session import cut_lineage

ECCENTRICITY = math.sqrt(rings.FLATTENING * (2 - rings.FLATTENING))


def cover_spans(polygons: DataFrame, keys: list[str], precision: int = lattice.PRECISION) -> DataFrame:
    """Spans of bins whose centre lies inside a shape by the even-odd rule; (keys, ix, lo, hi).

    Spans of different rows of a key can overlap (``union`` merges them); equal rows count once.
    """
    nx, ny = lattice.bits(precision)
    w, h = 360.0 / 2**nx, 180.0 / 2**ny
    slim = polygons.where(F.col("shape").isNotNull()).select(*keys, "shape").withColumn("_poly", F.xxhash64("shape")).dropDuplicates([*keys, "_poly"])
    edge = slim.select(*keys, "_poly", F.explode(shapes.edges(F.col("shape"))).alias("_e"))
    ax, ay, bx, by = (F.col(f"_e.{p}.{c}") for p in "ab" for c in ("lon", "lat"))
    near = lambda lon: F.floor((lon + 180.0) / w)
    columns = F.sequence(F.greatest(near(F.least(ax, bx)) - 1, F.lit(0)), F.least(near(F.greatest(ax, bx)) + 1, F.lit(2**nx - 1)))
    x = lattice.ix_to_lon(F.col("ix"), precision)
    crossed = edge.where(ax != bx).withColumn("ix", F.explode(columns.cast("array<int>"))).where((ax <= x) != (bx <= x))
    # the first bin whose centre is not below the crossing
    first = F.ceil((ay + (by - ay) * (x - ax) / (bx - ax) + 90.0) / h - 0.5)
    place = F.least(F.greatest(first, F.lit(0)), F.lit(2**ny)).cast("int")
    # one shuffle by column serves the toggles here and the sweeps behind them
    toggles = crossed.select(*keys, "_poly", "ix", place.alias("at")).repartition(*keys, "ix").groupBy(*keys, "_poly", "ix", "at").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    column = Window.partitionBy(*keys, "_poly", "ix").orderBy("at")
    paired = toggles.withColumns({"_k": F.row_number().over(column), "_next": F.lead("at").over(column)}).where("_k % 2 = 1")
    return paired.select(*keys, "ix", F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"))


def spans_of(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal spans of a set of bins (ix, iy); repeated bins count once."""
    rows = bins.select(*keys, "ix", "iy").distinct()
    run = F.col("iy") - F.row_number().over(Window.partitionBy(*keys, "ix").orderBy("iy"))
    return rows.withColumn("_run", run).groupBy(*keys, "ix", "_run").agg(F.min("iy").alias("lo"), F.max("iy").alias("hi")).drop("_run")


def _events(spans: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """(keys, ix, at) with the change of every measure at each place."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("s")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("s"))))
    rows = spans.withColumn("_end", ends).select(*keys, "ix", F.col("_end.at").alias("at"), *[(F.col("_end.s") * m).alias(n) for n, m in measures.items()])
    return rows.groupBy(*keys, "ix", "at").agg(*[F.sum(n).alias(n) for n in measures])


def stretches(events: DataFrame, keys: list[str], holds: Column, measures: list[str]) -> DataFrame:
    """Maximal stretches (keys, ix, lo, hi) on which ``holds`` is true of the running sums."""
    column = Window.partitionBy(*keys, "ix").orderBy("at")
    so_far = column.rowsBetween(Window.unboundedPreceding, 0)
    state = events.withColumns({n: F.sum(n).over(so_far) for n in measures}).withColumn("_in", holds)
    turns = state.withColumn("_was", F.coalesce(F.lag("_in").over(column), F.lit(False))).where("_in <> _was")
    ended = turns.withColumn("_next", F.lead("at").over(column)).where("_in")
    return ended.select(*keys, "ix", F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"))


def _combine(keys: list[str], holds: Column, **operands: DataFrame) -> DataFrame:
    parts = [o.select(*keys, "ix", "lo", "hi", *[F.lit(int(m == n)).alias(m) for m in operands]) for n, o in operands.items()]
    events = _events(reduce(DataFrame.unionByName, parts), keys, {n: F.col(n) for n in operands})
    return stretches(events, keys, holds, list(operands))


def union(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint maximal spans of all bins in any span of a key."""
    return _combine(keys, F.col("a") > 0, a=spans)


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _combine(keys, (F.col("a") > 0) & (F.col("b") > 0), a=a, b=b)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _combine(keys, (F.col("a") > 0) & (F.col("b") == 0), a=a, b=b)


def sole_owner(spans: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Stretches (keys, ix, lo, hi, owner) that exactly one owner holds.

    Owners are added up as numbers beside the depth, so where the depth is one the sum is the owner; no list of
    owners is built.
    """
    own = union(spans, [*keys, owner])
    code = F.xxhash64(owner).cast("decimal(20,0)")
    events = _events(own, keys, {"_depth": F.lit(1), "_owner": code})
    column = Window.partitionBy(*keys, "ix").orderBy("at")
    so_far = column.rowsBetween(Window.unboundedPreceding, 0)
    state = events.withColumns({"_d": F.sum("_depth").over(so_far), "_o": F.sum("_owner").over(so_far), "_next": F.lead("at").over(column)}).where("_d = 1")
    names = spans.select(owner).distinct().withColumn("_o", code.cast("long"))
    found = state.select(*keys, "ix", F.col("at").alias("lo"), (F.col("_next") - 1).alias("hi"), F.col("_o").cast("long").alias("_o"))
    return found.join(names, "_o").drop("_o")


def dense(spans: DataFrame, keys: list[str], k: int, at_least: int) -> DataFrame:
    """Bins of disjoint spans with ``at_least`` other bins of the set within ``k`` steps, as maximal spans.

    Along a column the number of bins in the window is linear between events, four per span and column in reach, so every
    stretch is cut where it crosses the limit and no bin becomes a row.
    """
    turns = [("lo", -k, 1), ("hi", 1 - k, -1), ("lo", k + 1, -1), ("hi", k + 2, 1)]
    event = lambda at, turn, own: F.struct(at.alias("at"), F.lit(turn).cast("long").alias("turn"), F.lit(own).cast("long").alias("own"))
    around = F.explode(F.array(*[event(F.col(c) + d, t, 0) for c, d, t in turns]))
    near = spans.withColumn("ix", F.explode(F.sequence(F.col("ix") - k, F.col("ix") + k))).select(*keys, "ix", around.alias("_e"))
    ends = spans.select(*keys, "ix", F.explode(F.array(event(F.col("lo"), 0, 1), event(F.col("hi") + 1, 0, -1))).alias("_e"))
    events = near.unionByName(ends).groupBy(*keys, "ix", F.col("_e.at").alias("at")).agg(F.sum("_e.turn").alias("turn"), F.sum("_e.own").alias("own"))
    column = Window.partitionBy(*keys, "ix").orderBy("at")
    so_far = column.rowsBetween(Window.unboundedPreceding, 0)
    state = events.withColumns({"_slope": F.sum("turn").over(so_far), "_own": F.sum("own").over(so_far), "_next": F.lead("at").over(column)})
    grown = F.sum(F.col("_slope") * (F.col("_next") - F.col("at"))).over(column.rowsBetween(Window.unboundedPreceding, -1))
    state = state.withColumn("_short", at_least + 1 - F.coalesce(grown, F.lit(0))).where("_own > 0")  # a bin is in its own window
    slope, steps = F.col("_slope"), F.col("_short") / F.when(F.col("_slope") != 0, F.col("_slope"))
    held = state.select(
        *keys, "ix",
        F.when(slope > 0, F.greatest(F.col("at"), F.col("at") + F.ceil(steps) - 1)).otherwise(F.col("at")).cast("int").alias("lo"),
        F.when(slope < 0, F.least(F.col("_next") - 1, F.col("at") + F.floor(steps) - 1)).otherwise(F.col("_next") - 1).cast("int").alias("hi"),
        ((slope != 0) | (F.col("_short") <= 0)).alias("_holds"),
    )
    return union(held.where("_holds and lo <= hi").drop("_holds"), keys)


def components(spans: DataFrame, keys: list[str], link: int = 1) -> DataFrame:
    """Disjoint spans with ``component``, the least bin code of their region: bins at most ``link`` steps apart are linked.

    Runs of a column reach ``link`` rows further and are then disjoint, so two columns are compared by one sweep that adds
    up the codes of the runs at a place; only pairs of runs that touch enter the graph step.
    """
    column = Window.partitionBy(*keys, "ix").orderBy("lo")
    code = F.col("ix").cast("long") * CODE_SHIFT + F.col("lo")
    opens = F.coalesce(F.col("lo") > F.lag("hi").over(column) + link, F.lit(True))
    named = spans.withColumn("_open", F.when(opens, code))
    named = cut_lineage(named.withColumn("_run", F.last("_open", ignorenulls=True).over(column)).drop("_open"))
    runs = named.groupBy(*keys, "ix", "_run").agg(F.min("lo").alias("lo"), (F.max("hi") + link + 1).alias("end"))
    ends = lambda a, b: F.explode(F.array(*[F.struct(F.col(at).alias("at"), (s * a).alias("a"), (s * b).alias("b")) for at, s in (("lo", 1), ("end", -1))]))
    zero, own = F.lit(0).cast("long"), F.col("_run")
    sides = runs.withColumn("_dx", F.explode(F.sequence(F.lit(1), F.lit(link))))
    left = sides.select(*keys, "_dx", "ix", ends(own, zero).alias("_e"))
    right = sides.select(*keys, "_dx", (F.col("ix") - F.col("_dx")).alias("ix"), ends(zero, own).alias("_e"))
    line = [*keys, "_dx", "ix"]
    events = left.unionByName(right).groupBy(*line, F.col("_e.at").alias("at")).agg(F.sum("_e.a").alias("a"), F.sum("_e.b").alias("b"))
    so_far = Window.partitionBy(*line).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    both = events.select(*keys, F.sum("a").over(so_far).alias("src"), F.sum("b").over(so_far).alias("dst")).where("src > 0 and dst > 0")
    merged = connected_components(both, keys).withColumnRenamed("node", "_run")
    out = named.join(merged, [*keys, "_run"], "left")
    return out.select(*keys, "ix", "lo", "hi", F.coalesce("component", "_run").alias("component"))


def bins_of(spans: DataFrame) -> DataFrame:
    """One row per bin, with the columns of its span."""
    return spans.withColumn("iy", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def bins_inside(bins: DataFrame, spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``bins`` in a span; spans are disjoint (see ``union``), so rows are not repeated."""
    keys = keys or []
    inside = spans.select(*keys, "ix", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return bins.join(inside, [*keys, "ix"]).where((F.col("iy") >= F.col("_lo")) & (F.col("iy") <= F.col("_hi"))).drop("_lo", "_hi")


def _zone(row: Column, precision: int) -> Column:
    """Area in km2 between the equator and the lower edge of a row, per radian of longitude, on the ellipsoid."""
    e, s = ECCENTRICITY, F.sin(F.radians(row * (180.0 / 2 ** lattice.bits(precision)[1]) - 90.0))
    scale = (rings.SEMI_MAJOR_M / 1000) ** 2 * (1 - e * e)
    return scale * (s / (2 * (1 - e * e * s * s)) + F.atanh(e * s) / (2 * e))


def area_km2(lo: Column, hi: Column, precision: int = lattice.PRECISION) -> Column:
    """Area of the bins of a span in closed form."""
    width = 2 * math.pi / 2 ** lattice.bits(precision)[0]
    return (_zone(hi + 1, precision) - _zone(lo, precision)) * width


def summary(spans: DataFrame, keys: list[str], precision: int = lattice.PRECISION) -> DataFrame:
    """Number of bins, mean bin centre and area per key of disjoint spans."""
    n = (F.col("hi") - F.col("lo") + 1).cast("long")
    lat, lon = lattice.iy_to_lat((F.col("lo") + F.col("hi")) / 2, precision), lattice.ix_to_lon(F.col("ix"), precision)
    return spans.groupBy(*keys).agg(
        F.sum(n).alias("n_points"),
        (F.sum(n * lat) / F.sum(n)).alias("centroid_lat"),
        (F.sum(n * lon) / F.sum(n)).alias("centroid_lon"),
        F.sum(area_km2(F.col("lo"), F.col("hi"), precision)).alias("area_km2"),
    )
