"""Scalar functions of bands, probabilities and densities. Arrays hold doubles without nulls unless a text says else."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(value: Column, missing=None, least=None, most=None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """An observation's stored value: missing, too small or too large become null; then scale and offset."""
    bad = value.isNull()
    if missing is not None:
        bad = bad | (value == missing)
    if least is not None:
        bad = bad | (value < least)
    if most is not None:
        bad = bad | (value > most)
    return F.when(bad, None).otherwise(value * scale + offset)


def clamped(value: Column, least, most, scale: float = 1.0, offset: float = 0.0, missing=None) -> Column:
    """A derived layer's stored value: out-of-range values are held to the range; then scale and offset."""
    v = F.greatest(F.least(value, F.lit(most)), F.lit(least)) * scale + offset
    return F.when(value.isNull() | (F.lit(False) if missing is None else value == missing), None).otherwise(v)


def cloudy(flags: Column, bits: list[int] | None = None, values: list[int] | None = None) -> Column:
    """Whether a quality value marks a cloud: by bit positions, or by a list of values."""
    if bits is not None:
        return flags.bitwiseAND(sum(1 << b for b in bits)) > 0
    return flags.isin(*(values or []))


def softmax(values: Column) -> Column:
    m = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def entropy(probs: Column) -> Column:
    """Shannon entropy over the logarithm of the number of classes."""
    return F.try_divide(-F.aggregate(F.transform(probs, lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x), F.log(F.size(probs)))


def margin(probs: Column) -> Column:
    s = F.sort_array(probs, asc=False)
    return 1 - (s[0] - s[1])


def least_confidence(probs: Column) -> Column:
    return 1 - F.array_max(probs)


def label_max(probs: Column) -> Column:
    """Place (from 1) of the first greatest probability; 0 if one is missing, null if all are 0."""
    return (
        F.when(F.exists(probs, lambda p: p.isNull() | F.isnan(p)), 0)
        .when(F.array_max(probs) == 0, None)
        .otherwise(F.array_position(probs, F.array_max(probs)).cast("int"))
    )


def weighted_mean(columns: list[Column], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + c * w
    return total


def inverse_uncertainty(columns: list[Column], uncertainty: list[Column], compat: bool = False) -> Column:
    """Mean with weights 1 / u over their sum; `compat`: every classifier has the first one's weight."""
    conf = [1 / F.greatest(u, F.lit(1e-12)) for u in uncertainty]
    whole = sum(conf, F.lit(0.0))
    used = [conf[0]] * len(columns) if compat else conf
    return sum((c * k for c, k in zip(columns, used, strict=True)), F.lit(0.0)) / whole


def normalize(x: Column, low: Column | float, high: Column | float) -> Column:
    """To the range of two quantiles, held to [0.0001, 1]."""
    width = high - low
    return F.greatest(F.least(F.try_divide(x - low, width if isinstance(width, Column) else F.lit(width)), F.lit(1.0)), F.lit(0.0001))


def normal_density(x: Column, mean: Column | float, sd: Column | float) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi))


def bayes_posterior(prior: Column, likelihood: Column) -> Column:
    both = prior * likelihood
    return F.try_divide(both, both + (1 - prior) * (1 - likelihood))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(0.0), lambda s, x: s + x), F.lit(1 / p))


def any_missing(values: Column) -> Column:
    return F.exists(values, lambda x: x.isNull())


def fill_row(values: Column, fill: float) -> Column:
    """The whole array becomes the fill value if any of it is missing."""
    return F.when(any_missing(values), F.transform(values, lambda _: F.lit(fill))).otherwise(values)


def logit(p: Column) -> Column:
    q = F.when(p >= 1, 0.999999).when(p <= 0, 0.000001).otherwise(p)
    return F.log(q / (1 - q))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
