"""Column expressions over scores: sigmoid, verdict, severity bands, rounding order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import as_col

# Decision threshold and severity bands.
THRESHOLD = 0.5
BAND_EDGES = (0.05, 0.15)
BAND_NAMES = ("low", "moderate", "high")


def sigmoid(col: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(col).cast("double")))


def at_least(p: Column | str, threshold: float) -> Column:
    """Whether a score reaches the threshold; NaN, which Spark sorts above all, does not."""
    x = as_col(p).cast("double")
    return (x >= F.lit(threshold)) & ~F.isnan(x)


def verdict(p: Column | str, threshold: float = THRESHOLD,
            names: tuple[str, str] = ("GENUINE", "FAKE")) -> Column:
    """Second name at or above the threshold, first name below it and for NaN."""
    return F.when(at_least(p, threshold), names[1]).otherwise(names[0])


def band(col: Column | str, edges: Sequence[float] = BAND_EDGES,
         names: Sequence[str] = BAND_NAMES) -> Column:
    """Name of the first band whose upper edge lies above the value; last name beyond."""
    if len(names) != len(edges) + 1:
        raise ValueError("need one more name than edges")
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(as_col(col) < F.lit(edge), F.lit(name)).otherwise(out)
    return out


def rounded_delta(a: Column | str, b: Column | str, digits: int) -> Column:
    """Absolute difference of the rounded operands, rounded again."""
    left, right = F.round(as_col(a), digits), F.round(as_col(b), digits)
    return F.round(F.abs(left - right), digits)


def rounded_diff(ours: Column | str, published: Column | str, digits: int = 2) -> Column:
    """``ours - published`` rounded; NULL when either side is."""
    return F.round(as_col(ours) - as_col(published), digits)
