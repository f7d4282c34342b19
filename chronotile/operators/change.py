"""Pattern matching by dynamic time warping, and Bayesian change detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars


def dtw_many(x: np.ndarray, y: np.ndarray, p: float = 2.0, band: int | None = None) -> np.ndarray:
    """Distances of series (series, dates, bands) from one pattern (dates, bands): a diagonal step counts its cell twice,
    the others once. `band`: cells further than this from the diagonal are closed.

    The cells of one anti-diagonal depend on those of the two before alone, so each is one operation over all series.
    """
    d = (np.abs(x[:, :, None] - y[None, None]) ** p).sum(-1) ** (1 / p)
    n, m = d.shape[1:]
    if band is not None:
        d = np.where(np.abs(np.arange(n)[:, None] * m / n - np.arange(m)) <= max(band, abs(n - m)), d, np.inf)
    g = np.full((len(x), n + 1, m + 1), np.inf)  # with a border that no path takes
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        j = s - i
        cell = d[:, i, j]
        best = np.minimum(np.minimum(g[:, i, j] + 2 * cell, g[:, i, j + 1] + cell), g[:, i + 1, j] + cell)
        g[:, i + 1, j + 1] = cell if s == 0 else best
    return g[:, n, m]


def dtw(a: np.ndarray, b: np.ndarray, p: float = 2.0, band: int | None = None) -> float:
    """Distance of two series (points in rows, or numbers)."""
    a, b = np.atleast_2d(a.T).T.astype(float), np.atleast_2d(b.T).T.astype(float)
    return float(dtw_many(a[None], b, p, band)[0])


def dtw_distances(series: DataFrame, patterns: dict[str, np.ndarray], bands: list[str], key: str = "sample_id", window: int | None = None, step: int = 1, band: int | None = None) -> DataFrame:
    """key, label, window (its place), distance: each series (an array of structs of the bands), or each window of it, against each pattern.

    A batch's windows of one length are compared at once.
    """
    flat = series.select(key, F.flatten(F.transform("time_series", lambda r: F.array(*(r[b].cast("double") for b in bands)))).alias("_x"))
    made = {k: np.asarray(v, float).reshape(len(v), -1) for k, v in patterns.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            dates = part["_x"].map(len) // len(bands)
            for n, rows in part.groupby(dates, sort=False):
                if not n:
                    continue
                x = np.concatenate(list(rows["_x"])).astype(float).reshape(len(rows), n, len(bands))
                size = min(window or n, n)
                starts = range(0, n - size + 1, step)
                for a in range(0, len(rows), 2048):
                    keys = rows[key].iloc[a : a + 2048]
                    for w, at in enumerate(starts):
                        for name, y in made.items():
                            yield pd.DataFrame({key: keys, "label": name, "window": w, "distance": dtw_many(x[a : a + 2048, at : at + size], y, band=band)})

    return flat.mapInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, label string, window int, distance double")


def dtw_detect(distances: DataFrame, threshold: float, key: str = "sample_id") -> DataFrame:
    """For each series and pattern the window of greatest distance of those at or above the threshold; none: null."""
    kept = F.when(F.col("distance") >= threshold, F.struct("distance", (-F.col("window")).alias("w")))
    d = distances.groupBy(key, "label").agg(F.max(kept).alias("_m"))
    return d.select(key, "label", (-F.col("_m.w")).alias("window"), F.col("_m.distance").alias("distance"))


def class_statistics(df: DataFrame, bands: list[str], label: str = "label") -> DataFrame:
    """Mean and standard deviation of each band for each label."""
    return df.groupBy(label).agg(*(x for b in bands for x in (F.avg(b).alias(f"{b}_mean"), F.stddev_samp(b).alias(f"{b}_sd"))))


def non_forest(bands: dict[str, tuple[float, float, float, float]], low: float = 0.1, high: float = 0.9) -> Column:
    """Probability of non-forest at a date, from bands: (forest mean, forest sd, other mean, other sd) of each.

    Each band's conditional probability is held to [low, high]; bands are joined by Bayes' rule, missing ones left out.
    """
    out: Column | None = None
    for name, (fm, fs, nm, ns) in bands.items():
        x = F.col(name)
        f, n = scalars.normal_density(x, fm, fs), scalars.normal_density(x, nm, ns)
        p = F.when(n < 0.00001, 0.0).otherwise(n / (n + f))
        p = F.when(x.isNotNull(), F.greatest(F.least(p, F.lit(high)), F.lit(low)))
        out = p if out is None else F.when(p.isNull(), out).when(out.isNull(), p).otherwise(scalars.bayes_posterior(p, out))
    return out


class ChangeState:
    """A flagged run of a series: its dates' values, from the first above the threshold on, until confirmed or refused.

    A refused run is tried again from its second date on, as a later date may begin the change.
    """

    def __init__(self, threshold: float = 0.5, chi: float = 0.9, previous: float = 0.5, run: list | None = None):
        self.threshold, self.chi, self.previous, self.run = threshold, chi, previous, []
        self.change = 0.0
        for v, tag in run or []:
            self._flag(v, tag)

    def _flag(self, v: float, tag) -> None:
        prior = self.change if self.run else self.previous
        both = prior * v
        self.change = both / max(both + (1 - prior) * (1 - v), 1e-15)
        self.run.append((v, tag))

    def update(self, p: float, tag):
        """Takes the next date's probability and its tag; the tag of the date that confirms a change, else None."""
        waiting = [(p, tag)]
        while waiting:
            v, t = waiting.pop(0)
            if not self.run and v <= self.threshold:
                self.previous = v
                continue
            self._flag(v, t)
            if len(self.run) > 1 and self.change < 0.5:
                self.previous, waiting, self.run = self.run[0][0], self.run[1:] + waiting, []
            elif self.change >= self.chi and v >= 0.5:
                return t
        return None


def detect_changes(df: DataFrame, probability: str, key: str | list[str] = "sample_id", index: str = "index", threshold: float = 0.5, chi: float = 0.9) -> DataFrame:
    """The keys (a sample's, or a pixel's tile, row and col) and the date at which a change is confirmed, null if none.

    A date above the threshold begins a run, whose prior is the date before it. A run joins its dates' probabilities by
    Bayes' rule until the change is confirmed, or refused, which leads to the next date as a beginning; the first run
    that isn't refused decides. Runs are folds over a series' sorted array, in the JVM.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kind = df.schema[index].dataType.simpleString()
    s = df.where(F.col(probability).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(probability).cast("double").alias("p")))).alias("_s"))
    refused = "(a.k > 1 and a.change < 0.5D)"
    confirmed = f"(a.k > 0 and a.change >= {chi}D and a.p >= 0.5D)"
    joined = "a.change * x.p / greatest(a.change * x.p + (1 - a.change) * (1 - x.p), 1e-15D)"
    begin = f"named_struct('change', if(b.n > 1, _s[b.n - 2].p, 0.5D), 'k', 0, 'p', 0D, 'i', cast(null as {kind}))"
    run = f"aggregate(slice(_s, b.n, size(_s)), {begin}, (a, x) -> if({refused} or {confirmed}, a, named_struct('change', {joined}, 'k', a.k + 1, 'p', x.p, 'i', x.i)))"
    verdict = f"transform(array({run}), a -> named_struct('n', b.n + 1, 'done', not {refused}, 'at', if({confirmed}, a.i, cast(null as {kind}))))[0]"
    skipped = "named_struct('n', b.n + 1, 'done', b.done, 'at', b.at)"
    start = f"named_struct('n', 1, 'done', false, 'at', cast(null as {kind}))"
    return s.select(*keys, F.expr(f"aggregate(_s, {start}, (b, y) -> if(b.done or y.p <= {threshold}D, {skipped}, {verdict})).at").alias("change"))


def change_polygons(changes: DataFrame, gap: int = 1) -> DataFrame:
    """Changed pixels of a tile by date and block of neighbours: box and number of cells of each run of columns in a row."""
    w = Window.partitionBy("tile", "change", "row").orderBy("col")
    d = changes.where("change is not null").withColumn("_s", F.coalesce((F.col("col") - F.lag("col").over(w) > gap).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_s").over(w))
    return d.groupBy("tile", "change", "row", "_run").agg(F.min("col").alias("col_from"), F.max("col").alias("col_to"), F.count("*").alias("cells")).drop("_run")
