"""Column helpers for coercion, shares and rounding."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def to_number(col: Column | str) -> Column:
    """Text to double; text that is not a number becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string")).try_cast("double")


def rounded(col: Column, decimals: int) -> Column:
    """Half-to-even rounding; the first step removes the noise of summing in another order."""
    scale = F.lit(10.0**decimals)
    return F.rint(F.round(col.cast("double"), decimals + 6) * scale) / scale


def pct(part: Column, whole: Column, decimals: int = 2) -> Column:
    """100 * part / whole, 0 when there is no whole."""
    return F.when(whole != 0, rounded(F.lit(100.0) * part / whole, decimals)).otherwise(F.lit(0.0))


def share(part: Column, whole: Column, decimals: int) -> Column:
    """Like :func:`pct`, but NULL when there is no whole."""
    return F.when(whole != 0, rounded(F.lit(100.0) * part / whole, decimals))


def true(col: Column | str) -> Column:
    """A flag in which NULL counts as false."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(False))


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: float) -> float | None:
    """Two-sided p of a correlation coefficient under Student's t with n - 2 degrees."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1.0 - r * r)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Meant for aggregated rows: one call per result row."""
    return pd.Series([correlation_p_value(a, b) for a, b in zip(r, n)], dtype="float64")
