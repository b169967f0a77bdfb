"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    """A symbol's rows in order of date. Made when it is used, as a window needs a session."""
    return Window.partitionBy("symbol").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def clip(x: Column, low: float, high: float) -> Column:
    """Nulls stay null, as greatest and least alone would hide them."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def let(x: Column, use) -> Column:
    """``use`` of ``x``, which is evaluated once however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def over_rows(n: int, window: WindowSpec | None = None):
    """The last n rows, this one included."""
    return (window or by_symbol()).rowsBetween(-(n - 1), 0)


def rolling(fn, x: Column, n: int, least: int | None = None, window: WindowSpec | None = None) -> Column:
    """fn over the last n rows; null until ``least`` values (n, if not given) are there."""
    frame = over_rows(n, window)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), fn(x).over(frame))


def change(x: Column, k: int, window: WindowSpec | None = None) -> Column:
    return x / F.lag(x, k).over(window or by_symbol()) - 1


def forward(x: Column, k: int, window: WindowSpec | None = None) -> Column:
    return F.lead(x, k).over(window or by_symbol()) / x - 1


def average_rank(x: Column, by) -> Column:
    """Rank from 1 with ties sharing their mean, among the rows of the window partition ``by`` (a list of columns)."""
    ordered = Window.partitionBy(*by).orderBy(x)
    same = Window.partitionBy(*by, x)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution by the Abramowitz-Stegun polynomial 26.2.17 (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


# The rational approximation of the normal quantile by Acklam (relative error below 1.2e-9).
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
PPF_TAIL = 0.02425


def _horner(factors: list[float], x: Column) -> Column:
    total = F.lit(factors[0])
    for f in factors[1:]:
        total = total * x + f
    return total


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _horner(PPF_C, t) / _horner(PPF_D, t)
    middle = q * _horner(PPF_A, r) / _horner(PPF_B, r)
    return F.when((p > 0) & (p < 1), F.when(p < PPF_TAIL, tail).when(p > 1 - PPF_TAIL, -tail).otherwise(middle))
