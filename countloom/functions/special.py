"""Scalar functions that Spark lacks, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published Lanczos coefficients for g = 7, nine terms.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
HALF_LOG_TWO_PI = 0.9189385332046727


def lgamma(x: Column) -> Column:
    """log-gamma of x > 0; below 0.5 by lgamma(x + 1) - ln(x)."""
    low = x < 0.5
    y = F.when(low, x + 1).otherwise(x) - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    value = F.lit(HALF_LOG_TWO_PI) + (y + 0.5) * F.log(t) - t + F.log(series)
    return F.when(low, value - F.log(x)).otherwise(value)


#: Names that a transformation may have; any function Column -> Column is taken too.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"sqrt": F.sqrt, "log": F.log, "log2": F.log2, "log10": F.log10, "log1p": F.log1p}


def transform(name: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(name):
        return name
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transformation {name!r}; known: {', '.join(TRANSFORMS)}")
    return TRANSFORMS[name]


def clip(x: Column, low: float, high: float) -> Column:
    """x between two bounds given in any order."""
    low, high = sorted((low, high))
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
