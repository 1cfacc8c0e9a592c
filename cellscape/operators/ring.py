"""Neighbourhood operators on the bin lattice (square k-rings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellscape.functions.lattice import on_lattice


def expand_ring(bins: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    """Each row once per lattice bin within k steps; the neighbour is (nx, ny)."""
    steps = F.sequence(F.lit(-k), F.lit(k))
    out = (
        bins.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .withColumn("nx", F.col("ix") + F.col("_dx"))
        .withColumn("ny", F.col("iy") + F.col("_dy"))
        .where(on_lattice(F.col("nx"), F.col("ny")))
    )
    if not include_self:
        out = out.where((F.col("_dx") != 0) | (F.col("_dy") != 0))
    return out.drop("_dx", "_dy")


def ring_totals(bins: DataFrame, keys: list[str], measures: list[str], k: int) -> DataFrame:
    """Sum of each measure over the (2k+1) x (2k+1) block around every reachable bin.

    The square window separates into a row pass and a column pass, so each bin is copied
    2(2k+1) times instead of (2k+1)^2, and both passes combine on the map side.
    """

    def one_pass(df: DataFrame, axis: str) -> DataFrame:
        other = "iy" if axis == "ix" else "ix"
        spread = df.select(
            *keys,
            F.explode(F.sequence(F.col(axis) - k, F.col(axis) + k)).alias(axis),
            other,
            *measures,
        )
        return spread.groupBy(*keys, "ix", "iy").agg(*[F.sum(m).alias(m) for m in measures])

    return one_pass(one_pass(bins.select(*keys, "ix", "iy", *measures), "ix"), "iy")


def ring_density(bins: DataFrame, keys: list[str], k: int, count_as: str, include_self: bool = False) -> DataFrame:
    """Every distinct bin with the number of listed bins inside its k-ring."""
    unique = bins.select(*keys, "ix", "iy").distinct().withColumn(count_as, F.lit(1).cast("long"))
    totals = ring_totals(unique, keys, [count_as], k)
    out = unique.drop(count_as).join(totals, [*keys, "ix", "iy"])
    return out if include_self else out.withColumn(count_as, F.col(count_as) - 1)
