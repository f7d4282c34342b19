"""Samples and top-k. Draws are by a hash of the row's key, so that a rerun or a lost executor changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A multiplicative mix that SQL engines compute alike.
MIX, PRIME = 2654435761, 2147483647


def draw(key: Column | str, seed: int = 0) -> Column:
    """A number below 2^31 - 1 for a whole-number key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k.cast("long") + seed, F.lit(PRIME)) * F.lit(MIX % PRIME), F.lit(PRIME))  # (k + seed) MIX, without overflow


def ranked(df: DataFrame, key: str, label: str, seed: int = 0, bits: int = 12) -> DataFrame:
    """Adds _rank, each row's place (from 1) in its label's order of draws, and _n, the label's rows.

    A label isn't sorted in one task: its rows are dealt by the first bits of the draw, ranked within those, and moved
    by the counts before, which are 2^bits numbers for each label.
    """
    d = df.withColumn("_d", draw(key, seed)).withColumn("_b", F.shiftright("_d", 31 - bits))
    counts = d.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_l").orderBy("_o")
    before = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_o"), "_c").withColumns({"_before": F.sum("_c").over(w) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy("_l"))})
    d = d.join(before.drop("_c"), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_o")))
    within = Window.partitionBy(label, "_b").orderBy("_d", key)
    return d.withColumn("_rank", F.col("_before") + F.row_number().over(within)).drop("_d", "_b", "_l", "_o", "_before")


def stratified(df: DataFrame, fraction: float, key: str = "sample_id", label: str = "label", seed: int = 0) -> DataFrame:
    """round(fraction n) rows of each label."""
    return ranked(df, key, label, seed).where(F.col("_rank") <= F.round(F.col("_n") * fraction)).drop("_rank", "_n")


def sample(df: DataFrame, fraction: float, key: str = "sample_id", label: str = "label", oversample: bool = False, seed: int = 0) -> DataFrame:
    """A share of each label's rows, up to 2; above 1 (oversample) rows come again in the order of their draw."""
    if not 0 < fraction <= 2 or fraction > 1 and not oversample:
        raise ValueError("fraction must be in (0, 1], or up to 2 with oversample")
    if fraction <= 1:
        return stratified(df, fraction, key, label, seed)
    return df.unionByName(stratified(df, fraction - 1, key, label, seed))


def split(df: DataFrame, validation: float, key: str = "sample_id", label: str = "label", seed: int = 0) -> DataFrame:
    """Adds train: true for round(n (1 - validation)) rows of each label."""
    return ranked(df, key, label, seed).withColumn("train", F.col("_rank") <= F.round(F.col("_n") * (1 - validation))).drop("_rank", "_n")


def folds(df: DataFrame, k: int = 5, key: str = "sample_id", label: str = "label", seed: int = 0) -> DataFrame:
    """Adds fold, 1 to k, balanced within each label."""
    return ranked(df, key, label, seed).withColumn("fold", (F.pmod(F.col("_rank") - 1, F.lit(k)) + 1).cast("int")).drop("_rank", "_n")


def stratified_points(df: DataFrame, sizes: dict[str, int], key: str, label: str = "label", overhead: float = 1.2, seed: int = 0) -> DataFrame:
    """ceil(overhead size) rows of each class."""
    limit = F.ceil(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))[F.col(label)] * overhead)
    return ranked(df.where(F.col(label).isin(*sizes)), key, label, seed).where(F.col("_rank") <= limit).drop("_rank", "_n")


def weighted_points(df: DataFrame, size: int, weight: str, key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """`size` rows of each class without replacement, in proportion to their weights (exponential keys)."""
    u = (draw(key, seed) + 1) / F.lit(PRIME + 1.0)
    w = Window.partitionBy(label).orderBy(-F.log(u) / F.col(weight), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def top_by_label(df: DataFrame, probs: list[str], n: int = 20, min_margin: float = 0.5) -> DataFrame:
    """The n rows of highest probability of each label whose lead over the runner-up is at least min_margin."""
    s = F.sort_array(F.array(*probs), asc=False)
    d = df.withColumns({"_lead": s[0] - s[1], "confidence": s[0], "label": F.element_at(F.array(*(F.lit(p) for p in probs)), F.array_position(F.array(*probs), s[0]).cast("int"))})
    w = Window.partitionBy("label").orderBy(F.desc("confidence"), "tile", "row", "col")
    return d.where(F.col("_lead") >= min_margin).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_lead")


def confidence(df: DataFrame, probs: list[str], n: int = 20, min_margin: float = 0.5, window: int = 10) -> DataFrame:
    """For each label the best cell of each block, of those the n best with the margin."""
    from .neighbourhood import block_max

    each = F.explode(F.array(*(F.struct(F.lit(p).alias("label"), F.col(p).alias("confidence")) for p in probs)))
    long = df.select("tile", "row", "col", each.alias("_e")).select("tile", "row", "col", "_e.*")
    d = block_max(long, "confidence", window, ("tile", "label"))  # one scan for all labels
    s = F.sort_array(F.array(*probs), asc=False)
    d = d.join(df.select("tile", "row", "col", (s[0] - s[1]).alias("_lead"), s[0].alias("_top")), ["tile", "row", "col"]).where((F.col("_lead") >= min_margin) & (F.col("_top") == F.col("confidence")))
    w = Window.partitionBy("label").orderBy(F.desc("confidence"), "tile", "row", "col")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_lead", "_top")


def uncertainty(df: DataFrame, value: str = "entropy", n: int = 100, min_uncert: float = 0.4, window: int = 10) -> DataFrame:
    """The most uncertain cell of each block, of those the n of each tile; label NoClass."""
    from .neighbourhood import block_max

    w = Window.partitionBy("tile").orderBy(F.desc(value), "row", "col")
    d = block_max(df, value, window).where(F.col(value) >= min_uncert).withColumn("rank", F.row_number().over(w))
    return d.where(F.col("rank") <= n).withColumn("label", F.lit("NoClass"))


def smote(df: DataFrame, features: list[str], target: int, key: str = "sample_id", label: str = "label", k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic rows up to `target` of each smaller label, between a row and one of its k nearest of the label.

    Only labels of fewer than `target` rows take part, so a label's rows are bounded by the parameter.
    """
    n = df.groupBy(label).agg(F.count("*").alias("_n")).where((F.col("_n") < target) & (F.col("_n") > 1))
    small = df.select(key, label, F.array(*features).cast("array<double>").alias("x")).join(F.broadcast(n), label)
    other = small.select(F.col(label).alias("_l"), F.col(key).alias("_k"), F.col("x").alias("y"))
    dist = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    pairs = small.join(other, (F.col(label) == F.col("_l")) & (F.col(key) != F.col("_k"))).withColumn("_d", dist)
    near = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(label, key).orderBy("_d", "_k"))).where(F.col("_r") <= k)
    per = F.ceil((F.lit(target) - F.col("_n")) / F.col("_n")).cast("int")
    made = near.groupBy(label, key, "x", "_n").agg(F.array_sort(F.collect_list(F.struct("_r", "y"))).alias("ys")).withColumn("_i", F.explode(F.sequence(F.lit(1), per)))
    pick = F.col("ys")[F.pmod(draw(F.col(key) * 31 + F.col("_i"), seed), F.size("ys")).cast("int")]["y"]
    gap = draw(F.col(key) * 131 + F.col("_i"), seed + 1) / F.lit(float(PRIME))
    made = made.withColumns({"_y": pick, "_g": gap}).withColumn("z", F.zip_with("x", "_y", lambda a, b: a + F.col("_g") * (b - a)))
    w = Window.partitionBy(label).orderBy("_i", key)
    made = made.withColumn("_w", F.row_number().over(w)).where(F.col("_w") <= target - F.col("_n"))
    return made.select(label, *(F.col("z")[i].alias(f) for i, f in enumerate(features)))


def top_values(df: DataFrame, value: str, n: int, window: int = 3, block: int = 5, smoothing: bool = True) -> DataFrame:
    """The n greatest cells of a tile: a median filter, then the greatest cell of each block, then the n first."""
    from .neighbourhood import block_max, kernel

    d = kernel(df, value, "w_median", window).withColumnRenamed("w_median", value) if smoothing else df
    w = Window.partitionBy("tile").orderBy(F.desc(value), "row", "col")
    return block_max(d, value, block).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
