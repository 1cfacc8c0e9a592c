"""Severity classes, normalised scores and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower bounds of the severity classes.
SEVERITY_BOUNDS = (("CRITICAL", 0.80), ("HIGH", 0.60), ("MEDIUM", 0.40), ("LOW", 0.20))
LOWEST_SEVERITY = "MINIMAL"


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def severity_category(score: Column, strict: bool = False) -> Column:
    """Class of a 0-1 score; ``strict`` puts a score equal to a bound into the class below."""
    out = F.lit(LOWEST_SEVERITY)
    for name, bound in reversed(SEVERITY_BOUNDS):
        out = F.when(score > bound if strict else score >= bound, F.lit(name)).otherwise(out)
    return out


def range_score(value: Column, low: Column, high: Column, degenerate: float | None = 0.5) -> Column:
    """Position of a value between two percentiles, clipped to 0-1.

    With no spread the score is ``degenerate``; None keeps the formula with a tiny range.
    """
    if degenerate is None:
        return clip((value - low) / F.greatest(high - low, F.lit(1e-9)))
    return F.when(high > low, clip((value - low) / (high - low))).otherwise(F.lit(degenerate))


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient that is ``default`` when the denominator is zero or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(default))


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def log1p_safe(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def round_half_even(value: Column) -> Column:
    return F.rint(value).cast("long")
