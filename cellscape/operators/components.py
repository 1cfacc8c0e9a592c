"""Connected components of edge lists and of lattice bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellscape.session import cut_lineage

TILE = 64
CODE_SHIFT = 2**18


def connected_components(edges: DataFrame, keys: list[str] | None = None, max_rounds: int = 60) -> DataFrame:
    """Label every endpoint of ``edges(src, dst)`` with the least node of its component.

    Alternates the large-star and small-star steps; each is a grouped minimum plus a join,
    so a hub node is combined on the map side and split by the skew-join rule.  ``keys``
    separates independent graphs that share node ids.
    """
    keys = keys or []
    links = (
        edges.where(F.col("src") != F.col("dst"))
        .select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    links = cut_lineage(links)
    seen = None
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links, keys), keys))
        mark = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (mark.n, mark.h) == seen:
            break
        seen = (mark.n, mark.h)
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    members = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _large_star(links: DataFrame, keys: list[str]) -> DataFrame:
    both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hops = both.where(F.col("v") > F.col("u")).join(least, [*keys, "u"])
    return hops.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(links: DataFrame, keys: list[str]) -> DataFrame:
    least = links.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    hops = links.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(*keys, "u", F.col("m").alias("v"))
    return hops.unionByName(own).where(F.col("u") != F.col("v")).distinct()


def lattice_components(bins: DataFrame, keys: list[str], link: int = 1) -> DataFrame:
    """Components of bins whose lattice distance is at most ``link`` steps.

    Bins are first merged inside fixed tiles (at most TILE^2 bins per group, whatever the
    data), then only the tile fragments that touch a neighbouring tile enter the iterative
    graph step.  Adds ``component``, the least bin code of the region.
    """
    tiled = bins.select(*keys, "ix", "iy").distinct()
    tiled = tiled.withColumn("_tx", F.floor(F.col("ix") / TILE)).withColumn("_ty", F.floor(F.col("iy") / TILE))
    schema = tiled.select(*keys, "ix", "iy").schema.add("fragment", "long")
    fragments = cut_lineage(
        tiled.groupBy(*keys, "_tx", "_ty").applyInPandas(_fragmenter(keys, link), schema)
    )
    column, row = F.pmod("ix", F.lit(TILE)), F.pmod("iy", F.lit(TILE))
    border = fragments.where(
        (column < link) | (column >= TILE - link) | (row < link) | (row >= TILE - link)
    )
    forward = [(dx, dy) for dx in range(0, link + 1) for dy in range(-link, link + 1) if dx > 0 or dy > 0]
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in forward])
    reach = border.withColumn("_o", F.explode(offsets)).select(
        *keys,
        (F.col("ix") + F.col("_o.dx")).alias("ix"),
        (F.col("iy") + F.col("_o.dy")).alias("iy"),
        F.col("fragment").alias("src"),
    )
    edges = reach.join(border.withColumnRenamed("fragment", "dst"), [*keys, "ix", "iy"])
    merged = connected_components(edges.select(*keys, "src", "dst"), keys)
    merged = merged.withColumnRenamed("node", "fragment")
    out = fragments.join(merged, [*keys, "fragment"], "left")
    return out.select(*keys, "ix", "iy", F.coalesce("component", "fragment").alias("component"))


def _fragmenter(keys: list[str], link: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["ix"].to_numpy(np.int64), pdf["iy"].to_numpy(np.int64)
        x0, y0 = x.min() - link, y.min() - link
        grid = np.full((x.max() - x0 + link + 1, y.max() - y0 + link + 1), np.iinfo(np.int64).max)
        grid[x - x0, y - y0] = x * CODE_SHIFT + y
        here = grid[x - x0, y - y0]
        steps = [(a, b) for a in range(-link, link + 1) for b in range(-link, link + 1) if a or b]
        while True:
            best = here
            for a, b in steps:
                best = np.minimum(best, grid[x - x0 + a, y - y0 + b])
            if np.array_equal(best, here):
                break
            grid[x - x0, y - y0] = best
            here = best
        return pdf[[*keys, "ix", "iy"]].assign(fragment=here)

    return run
