"""Statistics of paired and unpaired outcomes, as column expressions."""

from __future__ import annotations

from math import comb, erfc, sqrt
from sys import float_info

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Z95 = 1.96
#: Pairs up to which the binomial test is a quotient of whole numbers, rounded once.
WHOLE = 1000


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval for ``k`` of ``n``; null for n = 0."""
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z), 2 * n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def mcnemar_chi2(b: Column, c: Column) -> Column:
    """McNemar's statistic with continuity correction; 0 without discordant pairs."""
    gap = F.abs(b - c) - 1
    return F.when(b + c == 0, 0.0).otherwise(F.try_divide(gap * gap, b + c))


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom (neither SQL dialect has erfc)."""
    return stat.map(lambda x: None if pd.isna(x) else erfc(sqrt(x / 2)))


def _tail(n: int, k: int) -> float:
    """P(X <= k) of n fair draws, k at most n / 2.

    Coefficients from the middle outward, relative to the middle one; both halves sum to 2^n in the same measure,
    so no factorial is needed. After some 20 sqrt(n) steps they are less than a double holds.
    """
    i, term, whole, tail = n // 2, 1.0, 0.0, 0.0
    while term >= float_info.min:
        whole += term
        if i <= k:
            tail += term
        term *= i / (n - i + 1)
        i -= 1
    return tail / (2 * whole - (n % 2 == 0))  # the middle of an even number has no twin


@F.pandas_udf(T.DoubleType())
def mcnemar_exact_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided binomial test of ``b`` against ``c`` discordant pairs."""

    def p(b, c):
        n, k = int(b + c), int(min(b, c))
        if n == 0:
            return 1.0
        return min(1.0, 2 * (sum(comb(n, i) for i in range(k + 1)) / 2**n if n <= WHOLE else _tail(n, k)))

    return pd.Series([p(x, y) for x, y in zip(b, c)], dtype="float64")


def direction(b: Column, c: Column) -> Column:
    return F.when(b > c, "better").when(b < c, "worse").otherwise("equal")


def holm(df: DataFrame, p: str, by: list[str] | None = None, out: str = "p_holm", key: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p-values within each family ``by``: the running maximum of (m - rank) * p, at most 1. A family is a list of tests, so small."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(p, *(key or []))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    step = (F.count("*").over(whole) - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("__step", step).withColumn(out, F.least(F.lit(1.0), F.max("__step").over(w))).drop("__step")
