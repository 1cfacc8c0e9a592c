"""Geohash bins as integer lattice coordinates.

A geohash of precision p interleaves ceil(5p/2) longitude bits with floor(5p/2)
latitude bits, so the code and the pair (ix, iy) determine each other.  Joins and
neighbourhood counts use the integers; the text form appears only at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PRECISION = 7
# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
# Approximate bin size in metres (width, height) by precision.
BIN_SIZE_M = {
    1: (5_000_000, 5_000_000),
    2: (1_250_000, 625_000),
    3: (156_000, 156_000),
    4: (39_100, 19_500),
    5: (4_890, 4_890),
    6: (1_220, 610),
    7: (153, 153),
    8: (38, 19),
    9: (5, 5),
}


def bits(precision: int = PRECISION) -> tuple[int, int]:
    return (5 * precision + 1) // 2, (5 * precision) // 2


def lon_to_ix(lon, precision: int = PRECISION) -> Column:
    n = 2 ** bits(precision)[0]
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)), F.lit(n - 1)).cast("int")


def lat_to_iy(lat, precision: int = PRECISION) -> Column:
    n = 2 ** bits(precision)[1]
    return F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * n), F.lit(0)), F.lit(n - 1)).cast("int")


def ix_to_lon(ix, precision: int = PRECISION) -> Column:
    """Longitude of the bin centre."""
    return (ix + F.lit(0.5)) * (360.0 / 2 ** bits(precision)[0]) - 180.0


def iy_to_lat(iy, precision: int = PRECISION) -> Column:
    """Latitude of the bin centre."""
    return (iy + F.lit(0.5)) * (180.0 / 2 ** bits(precision)[1]) - 90.0


def _bit_of(t: int, ix: Column, iy: Column, precision: int) -> Column:
    nx, ny = bits(precision)
    source, shift = (ix, nx - 1 - t // 2) if t % 2 == 0 else (iy, ny - 1 - t // 2)
    return F.shiftright(source, shift).bitwiseAND(F.lit(1))


def encode(ix: Column, iy: Column, precision: int = PRECISION) -> Column:
    """Geohash text of a lattice bin."""
    letters = []
    for c in range(precision):
        value = sum(F.shiftleft(_bit_of(5 * c + k, ix, iy, precision), 4 - k) for k in range(5))
        letters.append(F.substr(F.lit(BASE32), value + 1, F.lit(1)))
    return F.concat(*letters)


def decode(code: Column, precision: int = PRECISION) -> Column:
    """struct(ix, iy) of a geohash; null where a character is not in the alphabet."""
    nx, ny = bits(precision)
    code = F.lower(code)
    values = [F.instr(F.lit(BASE32), F.substring(code, c + 1, 1)) - 1 for c in range(precision)]
    ix, iy = F.lit(0), F.lit(0)
    for t in range(5 * precision):
        bit = F.shiftright(values[t // 5], 4 - t % 5).bitwiseAND(F.lit(1))
        if t % 2 == 0:
            ix = ix + F.shiftleft(bit, nx - 1 - t // 2)
        else:
            iy = iy + F.shiftleft(bit, ny - 1 - t // 2)
    valid = code.rlike(f"^[{BASE32}]{{{precision}}}$")
    return F.when(valid, F.struct(ix.cast("int").alias("ix"), iy.cast("int").alias("iy")))


def bounds(ix: Column, iy: Column, precision: int = PRECISION) -> Column:
    """Bounding box of a bin."""
    w, h = 360.0 / 2 ** bits(precision)[0], 180.0 / 2 ** bits(precision)[1]
    return F.struct(
        (iy * h - 90.0).alias("min_lat"),
        ((iy + 1) * h - 90.0).alias("max_lat"),
        (ix * w - 180.0).alias("min_lon"),
        ((ix + 1) * w - 180.0).alias("max_lon"),
    )


def bin_ring(ix: Column, iy: Column, precision: int = PRECISION) -> Column:
    """Closed outline of a bin, five corners."""
    w, h = 360.0 / 2 ** bits(precision)[0], 180.0 / 2 ** bits(precision)[1]
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return F.array(*[
        F.struct(((ix + dx) * w - 180.0).alias("lon"), ((iy + dy) * h - 90.0).alias("lat")) for dx, dy in corners
    ])


def bin_size(precision: int = PRECISION) -> tuple[int, int]:
    return BIN_SIZE_M[precision]


def on_lattice(ix: Column, iy: Column, precision: int = PRECISION) -> Column:
    nx, ny = bits(precision)
    return ix.between(0, 2**nx - 1) & iy.between(0, 2**ny - 1)
