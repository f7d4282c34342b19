"""Maps of probabilities and classes: labels, uncertainty, ensembles, rules and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .quantiles import quantiles


def label(df: DataFrame, probs: list[str], names: list[str] | None = None) -> DataFrame:
    """class: the place (from 1) of the first greatest probability; label: its name."""
    d = df.withColumn("class", scalars.label_max(F.array(*probs)))
    table = F.array(*(F.lit(n) for n in (names or probs)))
    return d.withColumn("label", F.when(F.col("class") > 0, F.try_element_at(table, F.col("class"))))


UNCERTAINTY = {"entropy": scalars.entropy, "least": scalars.least_confidence, "margin": scalars.margin}


def uncertainty(df: DataFrame, probs: list[str], kind: str = "entropy") -> DataFrame:
    return df.withColumn(kind, UNCERTAINTY[kind](F.array(*probs)))


def combine_average(cubes: list[DataFrame], probs: list[str], weights: list[float] | None = None, keys: tuple[str, ...] = ("tile", "row", "col")) -> DataFrame:
    """Weighted mean of several classifiers' probabilities at each pixel."""
    w = weights or [1 / len(cubes)] * len(cubes)
    if abs(sum(w) - 1) > 1e-12 or len(w) != len(cubes):
        raise ValueError("weights must be one for each cube and sum to 1")
    parts = [c.select(*keys, *((F.col(p) * k).alias(p) for p in probs)) for c, k in zip(cubes, w, strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(*(F.sum(p).alias(p) for p in probs))  # one shuffle, with partial sums


def combine_uncertainty(cubes: list[DataFrame], uncertain: list[DataFrame], probs: list[str], value: str = "entropy", keys: tuple[str, ...] = ("tile", "row", "col")) -> DataFrame:
    """Mean with the inverse of each classifier's uncertainty as weight."""
    parts = None
    for c, u in zip(cubes, uncertain, strict=True):
        w = u.select(*keys, (1 / F.greatest(F.col(value), F.lit(1e-12))).alias("_w"))
        p = c.select(*keys, *probs).join(w, list(keys)).select(*keys, *((F.col(x) * F.col("_w")).alias(x) for x in probs), "_w")
        parts = p if parts is None else parts.unionByName(p)
    d = parts.groupBy(*keys).agg(*(F.sum(x).alias(x) for x in probs), F.sum("_w").alias("_w"))
    return d.select(*keys, *((F.col(x) / F.col("_w")).alias(x) for x in probs))


def reclassify(df: DataFrame, rules: dict[str, Column], out: str = "label") -> DataFrame:
    """Labels by rules over the original columns; of several true ones the last wins; where a rule is null the label is null."""
    e, unknown = F.col(out), F.lit(False)
    for name, rule in rules.items():
        e = F.when(rule, F.lit(name)).otherwise(e)
        unknown = unknown | rule.isNull()
    return df.withColumn(out, F.when(unknown, None).otherwise(e))


def new_codes(codes: dict[int, str], names: list[str]) -> dict[int, str]:
    """The codes with those names that are new, from the greatest code on."""
    out, k = dict(codes), max(codes, default=0)
    for n in names:
        if n not in out.values():
            k += 1
            out[k] = n
    return out


def class_areas(df: DataFrame, xres: float, yres: float, column: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels, hectares and square kilometres of each class."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("count"))
    return n.withColumns({"area_ha": F.col("count") * (xres * yres / 1e4), "area_km2": F.col("count") * (xres * yres / 1e6)})


def class_summary(df: DataFrame, labels: DataFrame, xres: float, yres: float, column: str = "label") -> DataFrame:
    """Count and km2 of each class of a dictionary; each tile's area is rounded to 2 significant digits before the sum."""
    per = class_areas(df, xres, yres, column, ("tile",))
    digits = 1 - F.floor(F.log10(F.greatest(F.col("area_km2"), F.lit(1e-300))))
    scale = F.pow(F.lit(10.0), digits)
    per = per.withColumn("a", F.round(F.col("area_km2") * scale, 0) / scale)
    s = per.groupBy(column).agg(F.sum("count").alias("count"), F.sum("a").alias("area_km2"))
    return labels.select(column).join(s, column, "full_outer").select(column, F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("area_km2", F.lit(0.0)).alias("area_km2"))


def segment_probabilities(pixels: DataFrame, probs: list[str], segment: str = "pol_id") -> DataFrame:
    """Mean probabilities of each segment, made to sum to 1."""
    m = pixels.groupBy(segment).agg(*(F.avg(p).alias(p) for p in probs))
    total = sum((F.col(p) for p in probs), F.lit(0.0))
    return m.select(segment, *(F.try_divide(F.col(p), total).alias(p) for p in probs))


def summary_quantiles(df: DataFrame, columns: list[str], every: float = 0.05) -> DataFrame:
    """Quantiles of type 7 of each column, in long form."""
    ps = [round(k * every, 10) for k in range(round(1 / every) + 1)]
    d = quantiles(df, columns[0], ps, out=columns[0])
    for c in columns[1:]:
        d = d.crossJoin(quantiles(df, c, ps, out=c))  # one row each
    return d.select(F.posexplode(F.arrays_zip(*columns)).alias("_k", "_v")).select(F.round(F.col("_k") * every, 10).alias("quantile"), *(F.col(f"_v.{c}").alias(c) for c in columns))


def six_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum of each column, a row for each."""
    parts = None
    for c in columns:
        q = quantiles(df, c, [0.25, 0.5, 0.75])
        p = df.agg(F.lit(c).alias("band"), F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max")).crossJoin(q)  # one row each
        p = p.select("band", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q3"), "max")
        parts = p if parts is None else parts.unionByName(p)
    return parts


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and densities of equal bins."""
    width = (high - low) / bins
    b = F.least(F.greatest(F.floor((F.col(column) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))
    from pyspark.sql.window import Window

    return n.withColumns({"low": low + F.col("bin") * width, "density": F.col("count") / F.sum("count").over(Window.partitionBy(*keys)) / width})
