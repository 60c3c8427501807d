"""Features of signal windows, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(col: str) -> Column:
    return F.sqrt(F.avg(F.col(col) * F.col(col)))


def kurtosis_unbiased(col: str) -> Column:
    """Bias-corrected excess kurtosis (G2); null for fewer than four values, 0 for a constant."""
    n = F.count(col).cast("double")
    g = F.try_divide((n - 1) * ((n + 1) * F.kurtosis(col) + 6), (n - 2) * (n - 3))
    return F.when(n < 4, None).when(F.var_pop(col) == 0, 0.0).otherwise(g)


def peak_to_peak(col: str) -> Column:
    return F.max(col) - F.min(col)
