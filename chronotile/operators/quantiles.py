"""Exact quantiles of columns of any size: ranks are found by counts in ever narrower ranges, never by sorting a column.

The values between a group's least and greatest fall into BINS equal ranges, whose counts say which of them hold the wanted
ranks; those are split again between their own least and greatest values; then equal values are counted. Each pass is a
grouped count with partial sums over the rows, so no task sees a group's rows or its distinct values as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 4096


def _pass(rows: DataFrame, slots: DataFrame, keys: list[str], bin_: Column) -> DataFrame:
    """The parts of slots (keys, low, high, before, ranks, n) by bin that hold one of the slot's ranks."""
    d = rows.join(slots.select(*(F.col(k).alias(f"_{k}") for k in keys), "low", "high", "before", "ranks", "n"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_x").between(F.col("low"), F.col("high"))])
    c = d.groupBy(*keys, "low", "high", bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.first("before").alias("_before"), F.first("ranks").alias("_ranks"), F.first("n").alias("n"))
    w = Window.partitionBy(*keys, "low", "high").orderBy("_bin")
    c = c.withColumn("before", F.col("_before") + F.sum("_c").over(w) - F.col("_c"))
    c = c.withColumn("ranks", F.filter("_ranks", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("_c"))))
    return c.where(F.size("ranks") > 0).select(*keys, F.col("_low").alias("low"), F.col("_high").alias("high"), "before", "ranks", "n")


def quantiles(df: DataFrame, column: str, shares: list[float], keys: list[str] | None = None, out: str = "q") -> DataFrame:
    """keys and an array of the column's quantiles of type 7, for each group that has a value; without keys at most one row."""
    by = keys or ["_all"]
    rows = df.where(F.col(column).isNotNull()).select(*(F.lit(1).alias("_all") if k == "_all" else F.col(k) for k in by), F.col(column).cast("double").alias("_x"))
    place = lambda p: F.floor((F.col("n") - 1) * F.lit(float(p))) + 1
    whole = rows.groupBy(*by).agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.count("*").alias("n"))
    slots = whole.withColumns({"before": F.lit(0).cast("long"), "ranks": F.array_distinct(F.array(*(F.least(place(p) + k, F.col("n")) for p in shares for k in (0, 1))))})
    share = F.try_divide(F.col("_x") - F.col("low"), F.col("high") - F.col("low"))
    equal = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("double")
    for bin_ in (equal, equal, F.col("_x")):
        slots = _pass(rows, slots, by, bin_)
    found = slots.select(*by, "n", "low", F.explode("ranks").alias("_r")).groupBy(*by).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_r", "low"))).alias("_m"))
    at = lambda p, k: F.col("_m")[F.least(place(p) + k, F.col("n"))]
    line = lambda p: at(p, 0) + (at(p, 1) - at(p, 0)) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p))))
    return found.select(*(keys or []), F.array(*(line(p) for p in shares)).alias(out))
