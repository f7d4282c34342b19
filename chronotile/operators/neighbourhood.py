"""Moving windows over raster pixels, computed chunk by chunk.

Pixels are rows (tile, row, col, value columns). A chunk is a square of cells of one tile; every pixel goes to its own
chunk and, as a halo, to the chunks whose windows reach it, so memory is bounded by the chunk and a window costs a few
copies instead of one for each of its cells. Kernels, Bayesian smoothing and texture mirror the edges of the tile (the
edge cell is repeated); variance and neighbourhood lists are cut at the edges. Missing pixels are nulls.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def _kernel(fn):
    KERNELS[fn.__name__] = fn
    return fn


@_kernel
def w_median(x):
    return np.nanmedian(x, -1)


@_kernel
def w_mean(x):
    return np.nanmean(x, -1)


@_kernel
def w_sd(x):
    return np.sqrt(w_var(x))


@_kernel
def w_min(x):
    return np.nanmin(x, -1)


@_kernel
def w_max(x):
    return np.nanmax(x, -1)


@_kernel
def w_var(x):
    n = (~np.isnan(x)).sum(-1)
    m = np.nansum(x, -1) / np.maximum(n, 1)
    return np.where(n > 1, np.nansum((x - m[..., None]) ** 2, -1) / np.maximum(n - 1, 1), np.nan)


@_kernel
def w_modal(x):
    """The most frequent value, of several the least; missing if any is missing."""
    s = np.sort(x, -1)
    best, many = s[..., 0].copy(), np.zeros(s.shape[:-1], int)
    run = np.zeros(s.shape[:-1], int)
    for k in range(s.shape[-1]):
        run = np.where((k > 0) & (s[..., k] == s[..., k - 1]), run + 1, 1) if k else run + 1
        better = run > many
        best, many = np.where(better, s[..., k], best), np.where(better, run, many)
    return np.where(np.isnan(x).any(-1), np.nan, best)


#: Tiles whose extents are broadcast.
BROADCAST_TILES = 100_000


def _views(a: np.ndarray, window: int) -> np.ndarray:
    v = np.lib.stride_tricks.sliding_window_view(a, (window, window))
    return v.reshape(*v.shape[:2], -1)


def windows(df: DataFrame, values: list[str], out: list[str], window: int, fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], mirror: bool = True, chunk: int = 256, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """fn maps the windows of each value column (rows, cols, window cells, row-major) to the out columns (rows, cols).

    The result has the keys, row, col and the out columns, for every pixel there is.
    """
    if window % 2 == 0 or window < 1:
        raise ValueError("the window must be odd")
    r = window // 2
    if chunk < r:
        raise ValueError("a chunk must hold half a window")
    extent = df.groupBy(*keys).agg((F.max("row") + 1).alias("_nr"), (F.max("col") + 1).alias("_nc"))
    part = lambda c: F.sequence(F.floor((F.col(c) - r) / chunk), F.floor((F.col(c) + r) / chunk))
    extent = F.broadcast(extent) if extent.count() <= BROADCAST_TILES else extent  # else every pixel would shuffle by tile first
    d = df.select(*keys, "row", "col", *values).join(extent, list(keys))
    d = d.withColumn("_br", F.explode(part("row"))).withColumn("_bc", F.explode(part("col")))
    d = d.where((F.col("_br") >= 0) & (F.col("_bc") >= 0) & (F.col("_br") * chunk < F.col("_nr")) & (F.col("_bc") * chunk < F.col("_nc")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys, "row", "col").schema)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(p["_br"].iloc[0]) * chunk, int(p["_bc"].iloc[0]) * chunk
        nr, nc = int(p["_nr"].iloc[0]), int(p["_nc"].iloc[0])
        h, w = min(chunk, nr - r0), min(chunk, nc - c0)
        rows, cols = p["row"].to_numpy() - r0, p["col"].to_numpy() - c0
        top, left, bottom, right = (0 if r0 == 0 else r), (0 if c0 == 0 else r), min(r, nr - r0 - h), min(r, nc - c0 - w)
        views = {}
        for v in values:
            a = np.full((top + h + bottom, left + w + right), np.nan)
            at = (rows + top, cols + left)
            a[at] = p[v].to_numpy(float)
            pad = ((r - top, r - bottom), (r - left, r - right))
            a = np.pad(a, pad, mode="symmetric") if mirror else np.pad(a, pad, constant_values=np.nan)
            views[v] = _views(a, window)
        with np.errstate(all="ignore"):
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                made = fn(views)
        own = ((rows >= 0) & (rows < h) & (cols >= 0) & (cols < w))
        res = p.loc[own, [*keys, "row", "col"]].copy()
        for o in out:
            res[o] = np.asarray(made[o], float)[rows[own], cols[own]]
        return res

    return d.groupBy(*keys, "_br", "_bc").applyInPandas(run, f"{fields}, " + ", ".join(f"`{o}` double" for o in out)).select(*keys, "row", "col", *(F.when(F.isnan(o), None).otherwise(F.col(o)).alias(o) for o in out))


def kernel(df: DataFrame, value: str, name: str, window: int = 3, chunk: int = 256) -> DataFrame:
    """One of the w_ functions, in a column of that name."""
    return windows(df, [value], [name], window, lambda v: {name: KERNELS[name](v[value])}, chunk=chunk)


def clean(df: DataFrame, value: str = "class", window: int = 5, chunk: int = 256) -> DataFrame:
    """The modal filter on a class map."""
    d = windows(df, [value], ["_v"], window, lambda v: {"_v": w_modal(v[value])}, chunk=chunk)
    return d.withColumn(value, F.col("_v").cast("int")).drop("_v")


def _logits(views: dict[str, np.ndarray], names: list[str]) -> dict[str, np.ndarray]:
    """Logarithms of each probability over the others' sum; 0 and 1 are moved a little inwards."""
    q = {n: np.where(views[n] == 1, 0.999999, np.where(views[n] == 0, 0.000001, views[n])) for n in names}
    total = sum(q.values())
    return {n: np.log(q[n] / (total - q[n])) for n in names}


def smooth(df: DataFrame, probs: list[str], window: int = 9, fraction: float = 0.5, smoothness: float | list[float] = 20.0, chunk: int = 256) -> DataFrame:
    """Bayesian smoothing of probabilities: logits are drawn to the mean of the highest ceil(fraction n) in the window."""
    strength = smoothness if isinstance(smoothness, list) else [smoothness] * len(probs)

    def fn(views):
        out, logits = {}, _logits(views, probs)
        for b, name in enumerate(probs):
            x = logits[name]
            x0 = x[..., x.shape[-1] // 2]
            s = -np.sort(-x, -1)  # missing ones last
            n = (~np.isnan(x)).sum(-1)
            k = np.ceil(fraction * n)
            used = np.arange(x.shape[-1]) < k[..., None]
            m0 = np.where(used, s, 0).sum(-1) / np.maximum(k, 1)
            s0 = np.where(used, (s - m0[..., None]) ** 2, 0).sum(-1) / np.maximum(k - 1, 1)
            w = s0 / (s0 + strength[b])
            y = np.where(np.isnan(x0) | (s0 < 1e-4), m0, w * x0 + (1 - w) * m0)
            out[name] = np.where(n > 0, 1 / (1 + np.exp(-y)), np.nan)
        return out

    return windows(df, probs, probs, window, fn, chunk=chunk)


def variance(df: DataFrame, probs: list[str], window: int = 9, fraction: float = 0.5, chunk: int = 256) -> DataFrame:
    """Sample variance of the highest floor(fraction n) logits in the window, which the edges cut."""

    def fn(views):
        out, logits = {}, _logits(views, probs)
        for name in probs:
            x = logits[name]
            s = -np.sort(-x, -1)
            n = (~np.isnan(x)).sum(-1)
            k = np.floor(n * fraction) if fraction < 1 else n
            used = np.arange(x.shape[-1]) < k[..., None]
            m = np.where(used, s, 0).sum(-1) / np.maximum(k, 1)
            v = np.where(used, (s - m[..., None]) ** 2, 0).sum(-1) / np.maximum(k - 1, 1)
            out[name] = np.where(n * fraction < 1, np.nan, np.where(k > 1, v, 0.0))
        return out

    return windows(df, probs, probs, window, fn, mirror=False, chunk=chunk)


def grey_levels(df: DataFrame, value: str, low: float, high: float, levels: int = 1000) -> DataFrame:
    """Linear rescaling to 0..levels."""
    return df.withColumn(value, (F.col(value) - low) / (high - low) * levels)


def _measures(i: np.ndarray, j: np.ndarray, p: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of co-occurrence: level pairs (..., pairs) and their probabilities, each pair's cell counted once."""
    mean = (p * i).sum(-1)
    var = (p * (i - mean[..., None]) ** 2).sum(-1)
    corr = (p * (i - mean[..., None]) * (j - mean[..., None])).sum(-1)
    # p as the matrix has it: cells that several pairs share hold the sum of theirs
    same = (i[..., :, None] == i[..., None, :]) & (j[..., :, None] == j[..., None, :])
    asm = (p[..., :, None] * p[..., None, :] * same).sum((-1, -2))
    return {
        "glcm_contrast": (p * (i - j) ** 2).sum(-1),
        "glcm_dissimilarity": (p * np.abs(i - j)).sum(-1),
        "glcm_homogeneity": (p / (1 + (i - j) ** 2)).sum(-1),
        "glcm_energy": np.sqrt(asm),
        "glcm_asm": asm,
        "glcm_mean": mean,
        "glcm_variance": var,
        "glcm_std": np.sqrt(var),
        "glcm_correlation": np.where(var < 1e-15, 1.0, corr / np.where(var < 1e-15, 1, var)),
    }


MEASURES = ("glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_energy", "glcm_asm", "glcm_mean", "glcm_variance", "glcm_std", "glcm_correlation")


def texture(df: DataFrame, value: str, measure: str, window: int = 3, angles: tuple[float, ...] = (0.0,), levels: int = 1000, chunk: int = 64) -> DataFrame:
    """A measure of the symmetric grey-level co-occurrence in each window, the mean over angles (radians)."""
    if measure not in MEASURES:
        raise ValueError(f"no such measure: {measure}")

    def fn(views):
        x = np.floor(views[value])
        shape = (*x.shape[:2], window, window)
        g = x.reshape(shape)
        total = 0
        for angle in angles:
            dr, dc = int(round(np.sin(angle))), int(round(np.cos(angle)))
            a = g[..., max(0, -dr) : window - max(0, dr), max(0, -dc) : window - max(0, dc)]
            b = g[..., max(0, dr) : window - max(0, -dr), max(0, dc) : window - max(0, -dc)]
            a, b = a.reshape(*x.shape[:2], -1), b.reshape(*x.shape[:2], -1)
            ok = (a < levels) & (b < levels) & (a >= 0) & (b >= 0)
            i, j = np.concatenate([a, b], -1), np.concatenate([b, a], -1)
            w = np.concatenate([ok, ok], -1).astype(float)
            p = w / np.maximum(w.sum(-1, keepdims=True), 1)
            total = total + _measures(np.where(w > 0, i, 0), np.where(w > 0, j, 0), p)[measure]
        return {measure: total / len(angles)}

    return windows(df, [value], [measure], window, fn, chunk=chunk)


def block_max(df: DataFrame, value: str, size: int, keys: tuple[str, ...] = ("tile",)) -> DataFrame:
    """The greatest cell of each block of size x size; of several the first in row order."""
    d = df.withColumns({"_br": F.floor(F.col("row") / size), "_bc": F.floor(F.col("col") / size)}).where(F.col(value).isNotNull())
    best = d.groupBy(*keys, "_br", "_bc").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("_m"))
    return best.select(*keys, (-F.col("_m.r")).alias("row"), (-F.col("_m.c")).alias("col"), F.col("_m.v").alias(value))


def neighbours(points: DataFrame, df: DataFrame, window: int, values: list[str]) -> DataFrame:
    """For points (tile, row, col) the window's pixels as an array, cut at the edges, by an equi-join on each cell.

    Pixels grow with the map and pack well in files, so they aren't broadcast whatever their files' size.
    """
    r = window // 2
    p = points.withColumn("_r", F.explode(F.sequence(F.col("row") - r, F.col("row") + r))).withColumn("_c", F.explode(F.sequence(F.col("col") - r, F.col("col") + r)))
    q = df.select(F.col("tile").alias("_t"), F.col("row").alias("_r2"), F.col("col").alias("_c2"), *values)
    j = p.join(q.hint("merge"), (F.col("tile") == F.col("_t")) & (F.col("_r") == F.col("_r2")) & (F.col("_c") == F.col("_c2")))
    return j.groupBy(*points.columns).agg(F.array_sort(F.collect_list(F.struct("_r", "_c", *values))).alias("neighbors"))
