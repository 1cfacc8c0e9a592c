"""Checks at the entry of a detector."""

from __future__ import annotations

from pyspark.sql import DataFrame

COVERAGE = ("ix", "iy", "band", "cell_name", "avg_rsrp", "event_count")
RELATIONS = ("cell_name", "to_cell_name", "weight", "distance")


def require(df: DataFrame, detector: str, *columns: str, one_of: tuple[str, ...] = ()) -> None:
    """Raise a ValueError that names the columns a detector lacks; nothing is read."""
    missing = [c for c in columns if c not in df.columns]
    if one_of and not set(one_of) & set(df.columns):
        missing.append(" or ".join(one_of))
    if missing:
        raise ValueError(f"{detector} needs column(s) {', '.join(missing)}; the table has {', '.join(df.columns)}")
