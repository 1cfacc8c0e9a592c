"""Exact grouped quantiles that survive a group holding a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets of one width up to this many from zero; beyond, each is a thousandth wider than the one before.
EVEN_BUCKETS = 1_000


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    width: float,
    bounded: bool | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per group, one column per entry of ``quantiles``.

    The key decides the way, never the data: groups of a lattice bin are bounded and use the built-in
    aggregate (``bounded`` says so for other keys).  Groups of a cell, a band or everything may hold any share of
    the rows; they are counted per distinct value, located through a histogram, and ranked only inside the buckets
    that hold the wanted ranks.  Both ways give the same figures.
    """
    narrow = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if bounded if bounded is not None else "ix" in keys:
        return _plain_quantiles(narrow, keys, quantiles)
    by = keys or ["_all"]
    if not keys:
        narrow = narrow.withColumn("_all", F.lit(0))
    out = _histogram_quantiles(narrow, by, quantiles, width)
    return out if keys else out.drop("_all")


def _bucket(value: Column, width: float) -> Column:
    """Bucket number that grows with the value; few buckets also for values of any size."""
    steps = value / width
    beyond = F.floor(F.log(F.abs(steps) / EVEN_BUCKETS) * EVEN_BUCKETS) + EVEN_BUCKETS
    return F.when(F.abs(steps) < EVEN_BUCKETS, F.floor(steps)).when(steps > 0, beyond).otherwise(-beyond - 1)


def _plain_quantiles(df: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    wanted = F.array(*[F.lit(p) for p in quantiles.values()])
    out = df.groupBy(*by).agg(F.percentile("_v", wanted).alias("_q"))
    return out.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)])


def _histogram_quantiles(df: DataFrame, by: list[str], quantiles: dict[str, float], width: float) -> DataFrame:
    placed = df.select(*by, _bucket(F.col("_v"), width).alias("_b"), "_v")
    in_order = Window.partitionBy(*by).orderBy("_b")
    histogram = placed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn"))  # combined on the map side
    histogram = histogram.select(
        *by,
        "_b",
        "_bn",
        (F.sum("_bn").over(in_order) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(*by)).alias("_total"),
    )
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("p")) for n, p in quantiles.items()])
    rank = F.col("_w.p") * (F.col("_total") - 1)
    located = (
        histogram.withColumn("_w", F.explode(wanted))
        .withColumn("_lo", F.floor(rank))
        .withColumn("_hi", F.ceil(rank))
        .withColumn("_rank", rank)
        .where((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_bn") > F.col("_lo")))
    )
    # only rows of the wanted buckets are kept, and equal values are counted before they are ranked
    inside = placed.join(located, [*by, "_b"]).groupBy(*by, "_b", "_w", "_before", "_lo", "_hi", "_rank", "_v").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by, "_b", "_w.name").orderBy("_v")
    start = F.col("_before") + F.sum("_n").over(running) - F.col("_n")
    ranked = inside.withColumn("_start", start).withColumn("_end", F.col("_start") + F.col("_n"))

    def holds(r: str):
        return (F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end"))

    ends = ranked.groupBy(*by, F.col("_w.name").alias("_name")).agg(
        F.max(F.when(holds("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(holds("_hi"), F.col("_v"))).alias("_vhi"),
        F.max("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.max("_rank").alias("_rank"),
    )
    # the arithmetic of the built-in aggregate
    between = (F.col("_hi") - F.col("_rank")) * F.col("_vlo") + (F.col("_rank") - F.col("_lo")) * F.col("_vhi")
    value = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_vlo") == F.col("_vhi")), F.col("_vlo")).otherwise(between)
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, value)).alias(n) for n in quantiles])


def attach_percentile_range(df: DataFrame, columns: dict[str, float], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Add ``_p_<column>`` = struct(low, high): dataset percentiles of each column, as scalar subqueries.

    ``columns`` maps each column to the histogram bucket width to use for it.
    """

    def add(acc: DataFrame, item) -> DataFrame:
        name, width = item
        spread = group_quantiles(df, [], name, {"low": low, "high": high}, width, bounded=True)  # one row per cell
        one = spread.agg(F.max(F.struct("low", "high")).alias("r"))
        return acc.withColumn(f"_p_{name}", one.scalar())

    return reduce(add, columns.items(), df)
