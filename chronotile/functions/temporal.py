"""Reductions of a time series, as aggregates over the long form and as expressions over an array of values.

Aggregates take a column; array forms take an array column without nulls, in time order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def t_max(x):
    return F.max(_c(x))


def t_min(x):
    return F.min(_c(x))


def t_mean(x):
    return F.avg(_c(x))


def t_sum(x):
    return F.sum(_c(x))


def t_median(x):
    return F.median(_c(x))


def t_std(x):
    """Sample standard deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(_c(x)), F.when(F.count(_c(x)) == 1, 0.0))


def t_skewness(x):
    """Population skewness times sqrt(n(n-1))/n - 2, the factor in use, which is negative for every n."""
    n = F.count(_c(x)).cast("double")
    return F.skewness(_c(x)) * (F.sqrt(n * (n - 1)) / n - 2)


def t_kurtosis(x):
    """Not the excess."""
    return F.kurtosis(_c(x)) + 3


def t_amplitude(x):
    return F.max(_c(x)) - F.min(_c(x))


def t_mse(x):
    """Mean squared modulus of the spectrum, which is the sum of squares."""
    return F.sum(_c(x) * _c(x))


def quantile5(values: Column, p: float, is_sorted: bool = False) -> Column:
    """The quantile of type 5 (piecewise linear, midway) of an array without nulls."""
    v = values if is_sorted else F.array_sort(values)
    n = F.size(v)
    h = n * F.lit(p) + 0.5
    lo = F.greatest(F.least(F.floor(h), n), F.lit(1)).cast("int")
    hi = F.greatest(F.least(F.floor(h) + 1, n), F.lit(1)).cast("int")
    a, b = F.element_at(v, lo), F.element_at(v, hi)
    return F.when(n > 0, a + (b - a) * F.greatest(F.least(h - F.floor(h), F.lit(1.0)), F.lit(0.0)))


def quantile7(x, p: float) -> Column:
    """The quantile of type 7, as an aggregate."""
    return F.percentile(_c(x), F.lit(p))


def t_fqr(x):
    return quantile5(F.collect_list(_c(x)), 0.25)


def t_tqr(x):
    return quantile5(F.collect_list(_c(x)), 0.75)


def t_iqr(x):
    return t_tqr(x) - t_fqr(x)


def _median(v: Column) -> Column:
    n = F.size(v)
    return F.when(n > 0, (F.element_at(v, F.floor((n + 1) / 2).cast("int")) + F.element_at(v, F.floor(n / 2).cast("int") + 1)) / 2)


#: Those that one sorted array without nulls gives, as expressions over it.
OF_SORTED: dict[str, Callable[[Column], Column]] = {
    "t_median": _median,
    "t_fqr": lambda v: quantile5(v, 0.25, True),
    "t_tqr": lambda v: quantile5(v, 0.75, True),
    "t_iqr": lambda v: quantile5(v, 0.75, True) - quantile5(v, 0.25, True),
}
#: Aggregates by name. t_fslope needs the order of time: see `slopes`.
REDUCTIONS: dict[str, Callable[[str | Column], Column]] = {f.__name__: f for f in (t_max, t_min, t_mean, t_sum, t_median, t_std, t_skewness, t_kurtosis, t_amplitude, t_mse, t_fqr, t_tqr, t_iqr)}


def slopes(value: str, keys: list[str], index: str) -> Column:
    """Absolute first differences in time, whose maximum is t_fslope."""
    return F.abs(_c(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(index)))
