"""Verbs over time series in the long form: one row for each sample and date, a column for each band.

Every function takes and returns a DataFrame. Keys of a sample are given as a list of columns; the date column is
`index`. Nulls are missing values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import temporal
from .quantiles import quantiles

KEYS = ["sample_id"]


def select(df: DataFrame, keys: list[str] = KEYS, bands: list[str] | None = None, start=None, end=None, dates: list | None = None, labels: list[str] | None = None, index: str = "index") -> DataFrame:
    """Bands, then interval (only if both ends are given), dates and labels."""
    if bands is not None:
        unknown = set(bands) - set(df.columns)
        if unknown:
            raise ValueError(f"no such bands: {sorted(unknown)}")
        fixed = [c for c in df.columns if c in {*keys, index, "label", "longitude", "latitude", "start_date", "end_date", "cube"}]
        df = df.select(*fixed, *bands)
    if start is not None and end is not None:
        df = df.where(F.col(index).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if dates is not None:
        df = df.where(F.col(index).isin(*[F.lit(d).cast("date") for d in dates]))
    if labels is not None:
        df = df.where(F.col("label").isin(*labels))
    return df


def restart(df: DataFrame, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    """start_date and end_date anew from the dates that are left."""
    ends = df.groupBy(*keys).agg(F.min(index).alias("start_date"), F.max(index).alias("end_date"))
    return df.drop("start_date", "end_date").join(ends, keys)


def apply(df: DataFrame, **expressions: str | Column) -> DataFrame:
    """New bands by expressions over bands; names in upper case with - for _; bands that are there already stay."""
    for name, e in expressions.items():
        band = name.upper().replace("_", "-")
        if band not in df.columns:
            df = df.withColumn(band, F.expr(e) if isinstance(e, str) else e)
    return df


def across(df: DataFrame, bands: list[str], fn) -> DataFrame:
    """A function of a column, on every band."""
    return df.withColumns({b: fn(F.col(b)) for b in bands})


def reduce(df: DataFrame, band: str, by: list[str], keys: list[str] = KEYS, index: str = "index", impute: bool = False) -> DataFrame:
    """Reductions of a band's series by name, a row for each sample; with impute, missing values are filled first."""
    if impute:
        df = impute_linear(df, band, keys, index)
    slope = "t_fslope" in by
    if slope:
        df = df.withColumn("_slope", temporal.slopes(band, keys, index))
    held = [f for f in by if f in temporal.OF_SORTED]  # one sorted array serves them all
    made = [F.max("_slope").alias(f) if f == "t_fslope" else temporal.REDUCTIONS[f](band).alias(f) for f in by if f not in held]
    if held:
        made.append(F.sort_array(F.collect_list(band)).alias("_sorted"))
    d = df.groupBy(*keys).agg(*made)
    return d.select(*keys, *(temporal.OF_SORTED[f](F.col("_sorted")).alias(f) if f in held else F.col(f) for f in by))


def impute_linear(df: DataFrame, band: str, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    """Missing values by linear interpolation over places in the series; ends take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(index)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(band).isNotNull(), F.col("_i"))
    d = df.withColumn("_i", F.row_number().over(w))
    d = d.withColumns({"_a": F.last(band, True).over(back), "_b": F.first(band, True).over(ahead), "_ia": F.last(place, True).over(back), "_ib": F.first(place, True).over(ahead)})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_ia")) / (F.col("_ib") - F.col("_ia"))
    return d.withColumn(band, F.coalesce(F.col(band), line, F.col("_a"), F.col("_b"))).drop("_i", "_a", "_b", "_ia", "_ib")


def whittaker_matrix(n: int, strength: float = 0.5) -> np.ndarray:
    """Inverse of I + strength D'D, D the second differences."""
    if n < 3:
        return np.eye(n)
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.inv(np.eye(n) + strength * d.T @ d)


def sgolay_matrix(n: int, order: int = 3, length: int = 5) -> np.ndarray:
    """The filter as a matrix: central coefficients inside, each end row's own at the ends."""
    if length % 2 == 0:
        raise ValueError("length must be odd")
    if order >= length:
        raise ValueError("order must be less than length")
    if n < length:
        return np.eye(n)
    half, m = length // 2, np.zeros((n, n))
    for i in range(n):
        first = min(max(i - half, 0), n - length)
        powers = np.vander(np.arange(length) + first - i, order + 1, increasing=True).astype(float)
        m[i, first : first + length] = np.linalg.pinv(powers)[0]
    return m


def _linear_filter(df: DataFrame, band: str, matrix, keys: list[str], index: str) -> DataFrame:
    """A linear filter of each series, vectorised over the series of a batch that have equal lengths."""
    nested = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(band).cast("double").alias("v")))).alias("_s")).select(*keys, F.col("_s.v").alias("_x"), F.col("_s.i").alias("_i"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, np.ndarray] = {}
        for part in batches:
            lengths = part["_x"].map(len)
            out = []
            for n, rows in part.groupby(lengths, sort=False):
                if n not in cache:
                    cache[n] = matrix(n)
                x = np.concatenate(list(rows["_x"])).astype(float).reshape(len(rows), n)
                out.append(rows[[*keys, "_i"]].assign(_v=list(x @ cache[n].T)))
            yield pd.concat(out)[[*keys, "_v", "_i"]] if out else part[keys].assign(_v=None, _i=None)

    date = df.schema[index].dataType.simpleString()
    d = nested.mapInPandas(run, f"{fields}, _v array<double>, _i array<{date}>")
    return d.select(*keys, F.explode(F.arrays_zip("_i", "_v")).alias("_z")).select(*keys, F.col("_z._i").alias(index), F.col("_z._v").alias(band))


def whittaker(df: DataFrame, band: str, strength: float = 0.5, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    return _linear_filter(df, band, lambda n: whittaker_matrix(n, strength), keys, index)


def sgolay(df: DataFrame, band: str, order: int = 3, length: int = 5, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    sgolay_matrix(length, order, length)
    return _linear_filter(df, band, lambda n: sgolay_matrix(n, order, length), keys, index)


def nest(df: DataFrame, bands: list[str], keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    """One row for each sample, its series an array of (index, bands) in time order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, *bands))).alias("time_series"))


def unnest(df: DataFrame, series: str = "time_series") -> DataFrame:
    return df.select(*(c for c in df.columns if c != series), F.posexplode(series).alias("place", "_s")).select("*", "_s.*").drop("_s")


def predictors(df: DataFrame, bands: list[str], dates: int, keys: list[str] = KEYS, index: str = "index", label: str = "label") -> DataFrame:
    """Wide features BAND1..BANDn, bands in order; series are cut to the given number of dates, shorter ones refused by null features."""
    w = Window.partitionBy(*keys).orderBy(index)
    d = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= dates)
    return d.groupBy(*keys, label).agg(*(F.max(F.when(F.col("_i") == i, F.col(b))).alias(f"{b}{i}") for b in bands for i in range(1, dates + 1)))


def stats(df: DataFrame, bands: list[str], keys: list[str] = KEYS, scope: str = "first") -> DataFrame:
    """2 and 98 percent quantiles of each band, of the first sample alone or of all."""
    if scope == "first":
        first = df.agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
        df = df.join(F.broadcast(first), keys, "left_semi")  # one row
        return df.agg(*(temporal.quantile7(b, p).alias(f"{b}_q{q}") for b in bands for p, q in ((0.02, "02"), (0.98, "98"))))  # one series
    d = None
    for b in bands:
        q = quantiles(df, b, [0.02, 0.98]).select(F.col("q")[0].alias(f"{b}_q02"), F.col("q")[1].alias(f"{b}_q98"))
        d = q if d is None else d.crossJoin(q)  # one row each
    return d


def normalize(df: DataFrame, stats_row: DataFrame, bands: list[str]) -> DataFrame:
    from ..functions.scalars import normalize as f

    d = df.crossJoin(F.broadcast(stats_row))  # one row
    return d.withColumns({b: f(F.col(b), F.col(f"{b}_q02"), F.col(f"{b}_q98")) for b in bands}).select(*df.columns)


def prune(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Samples whose length is the median of all lengths."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = n.agg(F.median("_n").alias("_m"))
    return df.join(n.crossJoin(F.broadcast(m)).where("_n = _m").select(*keys), keys, "left_semi")


def split(df: DataFrame, dates: int, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    """Consecutive chunks of so many dates; `chunk` numbers them, an incomplete last one goes."""
    w = Window.partitionBy(*keys).orderBy(index)
    d = df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / dates).cast("int"))
    return d.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "chunk"))).where(F.col("_n") == dates).drop("_n")


def overlapping(df: DataFrame, keys: list[str], id: str, start: str = "start_date", end: str = "end_date", days: int = 64) -> DataFrame:
    """keys, id1, id2: the pairs (id1 < id2) of a key's intervals that share a date.

    Intervals meet by key and stretch of `days` days, so a hot key is dealt over its stretches; a pair counts in the
    stretch that holds the later of both starts.
    """
    stretch = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    d = df.where(F.col(start) <= F.col(end)).select(*keys, F.col(id).alias("id1"), F.col(start).alias("a1"), F.col(end).alias("b1"), F.explode(F.sequence(stretch(start), stretch(end))).alias("_w"))
    e = d.select(*keys, F.col("id1").alias("id2"), F.col("a1").alias("a2"), F.col("b1").alias("b2"), "_w")
    j = d.join(e, [*keys, "_w"]).where((F.col("id1") < F.col("id2")) & (F.col("a1") <= F.col("b2")) & (F.col("a2") <= F.col("b1")))
    return j.where(F.floor(F.unix_date(F.greatest("a1", "a2")) / days) == F.col("_w")).select(*keys, "id1", "id2")


def align(df: DataFrame, reference: DataFrame, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    """Dates anew by place from a reference timeline of one column."""
    r = reference.select(F.col(index).alias("_to"), F.row_number().over(Window.orderBy(index)).alias("_i"))  # one timeline
    d = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(index)))
    return d.join(F.broadcast(r), "_i").withColumn(index, F.col("_to")).drop("_i", "_to")


def merge(a: DataFrame, b: DataFrame, keys: list[str] = KEYS, index: str = "index") -> DataFrame:
    """Series side by side, the k-th date with the k-th; bands in both get the endings .1 and .2."""
    w = Window.partitionBy(*keys).orderBy(index)
    left, right = (x.withColumn("_i", F.row_number().over(w)) for x in (a, b))
    fixed = {*keys, index, "_i", "label"}
    common = [c for c in left.columns if c in right.columns and c not in fixed]
    left = left.withColumnsRenamed({c: f"{c}.1" for c in common})
    right = right.drop(index, "label").withColumnsRenamed({c: f"{c}.2" for c in common})
    return left.join(right, [*keys, "_i"]).drop("_i")


def patterns(df: DataFrame, bands: list[str], index: str = "index", label: str = "label") -> DataFrame:
    """Median of each label's series at each date."""
    d = None
    for b in bands:
        q = quantiles(df, b, [0.5], [label, index]).select(label, index, F.col("q")[0].alias(b))
        d = q if d is None else d.join(q, [label, index], "full_outer")
    return d


def summary(df: DataFrame, keys: list[str] = KEYS, label: str = "label") -> DataFrame:
    """Samples of each label, and their share."""
    n = df.select(*keys, label).distinct().groupBy(label).agg(F.count("*").alias("count"))
    return n.withColumn("prop", F.col("count") / F.sum("count").over(Window.partitionBy()))


def relabel(df: DataFrame, names: dict[str, str], label: str = "label") -> DataFrame:
    return df.withColumn(label, F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col(label)], F.col(label)))


#: Layouts of values as nested arrays: what the rows are, then what the arrays hold from outside in.
LAYOUTS = ("cases_dates_bands", "bands_cases_dates", "bands_dates_cases")


def values(df: DataFrame, bands: list[str], layout: str = "cases_dates_bands", key: str = "sample_id", index: str = "index") -> DataFrame:
    """Series as arrays: for each case dates x bands; for each band and case its dates; or for each band and date its cases."""
    if layout == "cases_dates_bands":
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, F.array(*bands).alias("v")))).alias("_s")).select(key, F.col("_s.v").alias("values"))
    long = df.select(key, index, F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands))).alias("_e")).select(key, index, "_e.*")
    if layout == "bands_cases_dates":
        return long.groupBy("band", key).agg(F.array_sort(F.collect_list(F.struct(index, "v"))).alias("_s")).select("band", key, F.col("_s.v").alias("values"))
    if layout == "bands_dates_cases":
        return long.groupBy("band", index).agg(F.array_sort(F.collect_list(F.struct(key, "v"))).alias("_s")).select("band", index, F.col("_s.v").alias("values"))
    raise ValueError(f"no such layout: {layout}")


def foreach(df: DataFrame, fn, schema: str, keys: list[str] = KEYS) -> DataFrame:
    """A function of one group's rows as a pandas frame, for each sample (or, with other keys, each tile's chunk)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
