"""Confusion, agreement and area-weighted accuracy of predicted against reference labels, and clustering indices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """predicted, reference, n. Predictions that are no reference label drop out."""
    levels = df.where(F.col(reference).isNotNull()).select(F.col(reference).alias("_l")).distinct()
    d = df.where(F.col(reference).isNotNull()).join(F.broadcast(levels), F.col(predicted) == F.col("_l"), "left_semi")  # labels of a legend
    return d.groupBy(F.col(predicted).alias("predicted"), F.col(reference).alias("reference")).agg(F.count("*").alias("n"))


def overall(table: DataFrame) -> DataFrame:
    """accuracy and kappa of a confusion table, one row."""
    rows = table.groupBy(F.col("predicted").alias("l")).agg(F.sum("n").alias("a"))
    cols = table.groupBy(F.col("reference").alias("l")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, "l").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    total = table.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("predicted") == F.col("reference"), F.col("n")).otherwise(0)).alias("hit"))
    d = total.crossJoin(chance).select((F.col("hit") / F.col("n")).alias("accuracy"), (F.col("ab") / (F.col("n") * F.col("n"))).alias("pe"))  # one row each
    return d.select("accuracy", F.try_divide(F.col("accuracy") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def _beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Numerators alternate; the fraction 1 + d1 / (1 + d2 / (1 + ...)) is worked out from its end.
    terms = 200 + int(5 * math.sqrt(max(a, b)))
    value = 1.0
    for k in range(terms, 0, -1):
        m = k // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + d / value
    return front / value


def binomial_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a share, from the beta law's quantiles."""
    tail = (1 - level) / 2

    def quantile(q: float, a: float, b: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if _beta_cdf(middle, a, b) < q else (low, middle)
        return (low + high) / 2

    return (quantile(tail, hits, n - hits + 1) if hits else 0.0), (quantile(1 - tail, hits + 1, n - hits) if hits < n else 1.0)


def overall_interval(table: DataFrame, level: float = 0.95) -> DataFrame:
    """overall's row with lower and upper bound of the accuracy, and no_information, the greatest reference label's share."""
    n = table.agg(F.sum("n").cast("long").alias("_n"), F.sum(F.when(F.col("predicted") == F.col("reference"), F.col("n")).otherwise(0)).cast("long").alias("_hit"))
    most = table.groupBy("reference").agg(F.sum("n").alias("_m")).agg(F.max("_m").alias("_m"))
    d = overall(table).crossJoin(n).crossJoin(most)  # one row each

    @F.udf("struct<lower: double, upper: double>")
    def interval(hits, total):
        return binomial_interval(hits, total, level) if total else None

    d = d.withColumn("_i", interval("_hit", "_n"))  # of one row
    return d.select("accuracy", "kappa", F.col("_i.lower").alias("lower"), F.col("_i.upper").alias("upper"), (F.col("_m") / F.col("_n")).alias("no_information"))


def segment_confusion(segments: DataFrame, points: DataFrame, segment: str = "pol_id", label: str = "label", reference: str = "reference") -> DataFrame:
    """Confusion of labelled segments: each segment counts once for each reference label that points within it have."""
    seen = points.where(F.col(reference).isNotNull()).select("tile", segment, reference).distinct()
    return confusion(segments.select("tile", segment, F.col(label).alias("predicted")).join(seen, ["tile", segment]), "predicted", reference)


def by_class(table: DataFrame) -> DataFrame:
    """Sensitivity, specificity, predictive values and F1 of each label."""
    rows = table.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("pred"), F.sum(F.when(F.col("predicted") == F.col("reference"), F.col("n")).otherwise(0)).alias("hit"))
    cols = table.groupBy(F.col("reference").alias("label")).agg(F.sum("n").alias("ref"))
    total = table.agg(F.sum("n").alias("total"))
    z = lambda c: F.coalesce(c, F.lit(0))
    d = rows.join(cols, "label", "full_outer").crossJoin(F.broadcast(total)).select("label", z("pred").alias("pred"), z("hit").alias("hit"), z("ref").alias("ref"), "total")
    tn = F.col("total") - F.col("pred") - F.col("ref") + F.col("hit")
    d = d.select(
        "label",
        F.try_divide("hit", "ref").alias("sensitivity"),
        F.try_divide(tn, F.col("total") - F.col("ref")).alias("specificity"),
        F.try_divide("hit", "pred").alias("ppv"),
        F.try_divide(tn, F.col("total") - F.col("pred")).alias("npv"),
    )
    return d.withColumn("f1", F.try_divide(2 * F.col("ppv") * F.col("sensitivity"), F.col("ppv") + F.col("sensitivity")))


def area_assess(table: DataFrame, areas: DataFrame) -> DataFrame:
    """Area-weighted accuracy of each label: adjusted area, its error and interval, user's and producer's accuracy.

    areas: label, area. The overall accuracy stands in every row.
    """
    w = areas.withColumn("weight", F.col("area") / F.sum("area").over(Window.partitionBy())).withColumn("total", F.sum("area").over(Window.partitionBy()))
    rows = table.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("ni"))
    per = table.join(rows, table["predicted"] == rows["label"]).drop("label").join(w.select(F.col("label").alias("l"), "weight", "total"), F.col("predicted") == F.col("l"))
    per = per.withColumn("prop", F.col("weight") * F.col("n") / F.col("ni")).withColumn("v", F.try_divide(F.col("weight") * F.col("prop") - F.col("prop") * F.col("prop"), F.col("ni") - 1))
    cols = per.groupBy(F.col("reference").alias("label")).agg(F.sum("prop").alias("p_ref"), F.sqrt(F.sum("v")).alias("stderr_prop"), F.max("total").alias("total"), F.sum(F.when(F.col("predicted") == F.col("reference"), F.col("prop")).otherwise(0.0)).alias("diag"))
    user = per.groupBy(F.col("predicted").alias("label")).agg(F.sum("prop").alias("p_pred"))
    over = per.agg(F.sum(F.when(F.col("predicted") == F.col("reference"), F.col("prop")).otherwise(0.0)).alias("overall"))
    d = cols.join(user, "label", "left").crossJoin(F.broadcast(over))
    return d.select(
        "label",
        (F.col("p_ref") * F.col("total")).alias("adjusted_area"),
        (F.col("stderr_prop") * F.col("total")).alias("stderr_area"),
        (1.96 * F.col("stderr_prop") * F.col("total")).alias("conf_interval"),
        F.try_divide("diag", "p_pred").alias("user_acc"),
        F.try_divide("diag", "p_ref").alias("prod_acc"),
        "overall",
    )


def sampling_design(areas: DataFrame, expected_ua: dict[str, float], default_ua: float = 0.75, rare: float = 0.1, alloc: tuple[int, ...] = (100, 75, 50), std_err: float = 0.01) -> DataFrame:
    """Sample sizes of each class for a standard error: equal, with fixed numbers for rare classes, and in proportion."""
    from functools import reduce

    ua = F.create_map(*(F.lit(x) for kv in expected_ua.items() for x in kv)) if expected_ua else F.lit(None).cast("map<string, double>")
    d = areas.withColumn("prop", F.col("area") / F.sum("area").over(Window.partitionBy())).withColumn("expected_ua", F.coalesce(ua[F.col("label")], F.lit(default_ua)))
    s = F.sqrt(F.col("expected_ua") * (1 - F.col("expected_ua")))
    digits = 2 - F.floor(F.log10(F.greatest(s, F.lit(1e-300))))
    d = d.withColumn("std_dev", F.round(s * F.pow(F.lit(10.0), digits), 0) / F.pow(F.lit(10.0), digits))
    one = Window.partitionBy()
    d = d.withColumn("_n", F.bround(F.pow(F.sum(F.col("prop") * F.col("std_dev")).over(one) / std_err, F.lit(2.0)), 0))
    d = d.withColumns({"_k": F.count("*").over(one), "_rare": F.col("prop") <= rare})
    d = d.withColumns({"_nr": F.sum(F.col("_rare").cast("int")).over(one), "_pr": F.sum(F.when(F.col("_rare"), F.col("prop")).otherwise(0.0)).over(one)})
    whole = lambda c: F.bround(c, 0).cast("long")
    d = d.withColumn("equal", whole(F.col("_n") / F.col("_k")))
    d = reduce(lambda x, a: x.withColumn(f"alloc_{a}", whole(F.when(F.col("_rare"), F.lit(float(a))).otherwise(F.col("prop") / (1 - F.col("_pr")) * (F.col("_n") - a * F.col("_nr"))))), alloc, d)
    return d.withColumn("alloc_prop", whole(F.col("_n") * F.col("prop"))).drop("_n", "_k", "_rare", "_nr", "_pr")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both columns with their margins, named Total."""
    x = F.coalesce(F.col(a).cast("string"), F.lit("Total"))
    y = F.coalesce(F.col(b).cast("string"), F.lit("Total"))
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).agg(F.count("*").alias("n")).select(x.alias(a), y.alias(b), "n")


def rand_indices(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand, adjusted Rand, Jaccard and Fowlkes-Mallows indices, and variation of information, of two partitions."""
    t = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    h = lambda c: F.sum(F.col(c) * F.log(F.col(c)))
    ra = t.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("pa"), h("n").alias("ha"))
    rb = t.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("pb"), h("n").alias("hb"))
    d = t.agg(pairs("n").alias("pab"), h("n").alias("hab"), F.sum("n").alias("n")).crossJoin(ra).crossJoin(rb)  # one row each
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.try_divide(F.col("pa") * F.col("pb"), all_pairs)
    return d.select(
        F.try_divide(all_pairs + 2 * F.col("pab") - F.col("pa") - F.col("pb"), all_pairs).alias("rand"),
        F.try_divide(F.col("pab") - expected, (F.col("pa") + F.col("pb")) / 2 - expected).alias("adjusted_rand"),
        F.try_divide("pab", F.col("pa") + F.col("pb") - F.col("pab")).alias("jaccard"),
        F.try_divide("pab", F.sqrt(F.col("pa") * F.col("pb"))).alias("fowlkes_mallows"),
        ((F.col("ha") + F.col("hb") - 2 * F.col("hab")) / F.col("n")).alias("variation"),
    )


def majority(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Rows whose label is the most frequent of their cluster (of several the least)."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("_n"))
    best = n.groupBy(cluster).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l"))).alias("_b")).select(F.col(cluster), F.col("_b.l").alias(label))
    return df.join(best, [cluster, label], "left_semi")


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share, in percent, of each label in each cluster."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(cluster))).drop("n")
