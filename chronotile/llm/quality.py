"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Everything is DataFrame operations. Statistics of a text come from array functions within its row; the estimates are
grouped aggregations over the small table of statistics, so a group of any size is pre-aggregated by every task.

The estimate of a group is the mean and covariance of the `share` of its rows whose covariance has the least determinant.
Several starts (medians with quartile ranges, medians with the covariance of the rows' directions, and small subsets drawn
by hash) go two concentration steps each, those of the two least determinants go on until the determinant settles, and the
least is taken. A step takes mean and covariance of the rows that lie nearest by the estimate before.

Null and empty texts have no words and fail the base rule. Null languages and sources are values of their own. Repeated
rows are judged alike. Distances are compared on a grid of 1/100 of their logarithm, and all rows as near as the last one
of the share belong to it, so that ties don't depend on an order and the part taken can exceed the share. Groups of fewer
than `min_rows` rows are pooled within their language and then over all languages; if even that pool is small, nothing in
it is rejected. Very long texts are read whole. Other columns pass through `quality_filter` untouched, whatever their names,
and are not read by `quality`. An empty table gives an empty result.
"""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_few, sized, text_or_empty, words_of, written

#: Dimensions of the vector: mean word length, symbols a word, upper-case share, exclamation and bar marks a word,
#: repeated lines' share, repeated words' share; and the least standard deviation that each is given. The floors keep
#: a dimension that is constant in a group from turning a single symbol into an outlier, and are small enough that each
#: dimension can reject a text by itself (the base rule bounds x_rep by the root of 1/2).
DIMS = {"x_len": 0.08, "x_sym": 0.15, "x_up": 0.10, "x_mark": 0.15, "x_line": 0.15, "x_rep": 0.13}


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks."""
    d = docs.select(*keep, text_or_empty().alias("_t"))
    d = d.select(*keep, "_t", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("_l"))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[!|]+", ""))).cast("long").alias("n_marks"),
        F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, _w[i + 1], _w[i + 2]))").alias("_h"),
    )
    kept = [c for c in d.columns if c[0] != "_"]
    d = d.select(*kept, F.expr("if(size(_h) = size(array_distinct(_h)), null, sort_array(transform(_h, (h, i) -> struct(h, i))))").alias("_s"))
    d = d.select(*kept, F.expr("sort_array(transform(filter(_s, (t, k) -> (k > 0 and _s[k - 1].h = t.h) or (k + 1 < size(_s) and _s[k + 1].h = t.h)), t -> t.i))").alias("_p"))
    return d.select(*kept, F.expr("coalesce(aggregate(transform(_p, (p, k) -> if(k = 0, 3, least(3, p - _p[k - 1]))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"))


def _vector(d: DataFrame) -> DataFrame:
    """Transformed statistics, on a grid of 1/1000 so that counts of their values have bounded size."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    grid = lambda c: F.round(c, 3)
    return d.withColumns(
        {
            "x_len": grid(F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1)))),
            "x_sym": grid(F.sqrt(F.col("n_symbols") / n)),
            "x_up": grid(F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)))),
            "x_mark": grid(F.sqrt(F.col("n_marks") / n)),
            "x_line": grid(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
            "x_rep": grid(F.sqrt(F.col("n_repeat_words") / n)),
        }
    )


def chi2_quantile(p: int, q: float) -> float:
    """Wilson and Hilferty's approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * sqrt(2 / (9 * p))) ** 3


def _distance(xs: list[str]) -> Column:
    """Squared Mahalanobis distance from the columns m_<x> and l_<i>_<j>, the inverse of the Cholesky factor."""
    total = F.lit(0.0)
    for i in range(len(xs)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"l_{i}_{j}") * (F.col(xs[j]) - F.col(f"m_{xs[j]}"))
        total = total + z * z
    return total


#: Group and number of the start.
KEY = ("_k", "_s")


def _whiten(est: DataFrame, xs: list[str], factor: float) -> DataFrame:
    """From columns c_<i>_<j> (i >= j), covariances: the entries l_<i>_<j> of the inverse Cholesky factor,
    and the logarithm of the determinant.

    The factor corrects for the share of rows that the covariance was taken over; floors are added on the diagonal. Both
    triangles are folds over their entries row after row, each of which needs earlier entries alone.
    """
    p, floors = len(xs), list(DIMS.values())
    places = [(i, j) for i in range(p) for j in range(i + 1)]
    row = {i: i * (i + 1) // 2 for i in range(p)}
    numbers = lambda values: f"array({', '.join(map(str, values))})"
    i, j = f"{numbers(i for i, _ in places)}[t]", f"{numbers(j for _, j in places)}[t]"
    at = lambda r, c: f"{numbers(row.values())}[{r}] + {c}"
    fold = f"aggregate(sequence(0, {len(places) - 1}), cast(array() as array<double>), (o, t) -> concat(o, array(%s)))"
    left = f"_c[t] - aggregate(filter({numbers(range(p))}, k -> k < {j}), 0D, (a, k) -> a + o[{at(i, 'k')}] * o[{at(j, 'k')}])"
    least = f"array({', '.join(f'{f**2 / 4!r}D' for f in floors)})[{i}]"
    factor_ = fold % f"transform(array({left}), s -> if({i} = {j}, sqrt(greatest(s, {least})), s / o[{at(j, j)}]))[0]"
    inverse = fold % f"(if({i} = {j}, 1D, 0D) - aggregate(filter({numbers(range(p))}, k -> k >= {j} and k < {i}), 0D, (a, k) -> a + _g[{at(i, 'k')}] * o[{at('k', j)}])) / _g[{at(i, i)}]"
    covariances = F.array(*(F.coalesce(F.col(f"c_{i}_{j}"), F.lit(0.0)) * factor + (floors[i] ** 2 if i == j else 0.0) for i, j in places))
    d = est.select(*KEY, *(f"m_{x}" for x in xs), covariances.alias("_c"))
    d = d.withColumn("_g", F.expr(factor_)).withColumn("_l", F.expr(inverse))
    logdet = F.expr(f"2 * aggregate({numbers(row[i] + i for i in range(p))}, 0D, (a, k) -> a + ln(_g[k]))")
    return d.select(*KEY, logdet.alias("logdet"), *(f"m_{x}" for x in xs), *(F.col("_l")[k].alias(f"l_{i}_{j}") for k, (i, j) in enumerate(places)))


def _moments(d: DataFrame, xs: list[str]) -> DataFrame:
    means = [F.avg(x).alias(f"m_{x}") for x in xs]
    return d.groupBy(*KEY).agg(*means, *(F.covar_pop(xs[i], xs[j]).alias(f"c_{i}_{j}") for i in range(len(xs)) for j in range(i + 1)))


def group_keys(stats: DataFrame, min_rows: int) -> DataFrame:
    """Adds _k: language and source, or the pool that small groups go to; null for rows without a verdict."""
    name = lambda *cols: F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in cols))
    d = stats.withColumns({"_a": name("lang", "source"), "_b": name("lang")})
    n = d.where("not base_failed").groupBy("_a", "_b").agg(F.count("*").alias("n"))
    n = written(n, "quality-groups")
    small = n.where(F.col("n") < min_rows)
    pools = small.groupBy("_b").agg(F.sum("n").alias("nb"))
    rest = pools.where(F.col("nb") < min_rows).agg(F.sum("nb").alias("nr"))
    keys = n.join(pools, "_b", "left").crossJoin(F.broadcast(rest)).select(  # rest is one row
        F.col("_a").alias("_a2"),
        F.when(F.col("n") >= min_rows, F.concat(F.lit("s:"), "_a")).when(F.col("nb") >= min_rows, F.concat(F.lit("l:"), "_b")).when(F.col("nr") >= min_rows, F.lit("all")).alias("_k"),
    )
    keys = written(keys, "quality-keys")
    return d.join(sized(keys), d["_a"] == keys["_a2"], "left").drop("_a", "_b", "_a2")


def _starts(fit: DataFrame, xs: list[str], subsets: int, subset_rows: int) -> DataFrame:
    """Means m_<x> and covariances c_<i>_<j> by group and start."""
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    quart = fit.groupBy("_k").agg(F.count("*").alias("_rows"), *(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{x}") for x in xs))
    quart = written(quart.select("_k", "_rows", *(F.col(f"q_{x}")[1].alias(f"m_{x}") for x in xs), *(((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349).alias(f"r_{x}") for x in xs)), "quality-quartiles")
    middle = quart.select("_k", F.lit(0).alias("_s"), *(f"m_{x}" for x in xs), *((F.pow(f"r_{xs[i]}", F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in pairs))
    own = fit.join(sized(quart), "_k")
    wide = {x: F.col(f"r_{x}") + F.lit(DIMS[x]) for x in xs}
    own = own.withColumns({f"u_{x}": (F.col(x) - F.col(f"m_{x}")) / wide[x] for x in xs})
    norm = F.lit(0.0)
    for x in xs:
        norm = norm + F.col(f"u_{x}") * F.col(f"u_{x}")
    signs = own.withColumn("_n", F.greatest(norm, F.lit(1e-12))).groupBy("_k").agg(
        *(F.first(f"m_{x}").alias(f"m_{x}") for x in xs),
        *((F.avg(F.col(f"u_{xs[i]}") * F.col(f"u_{xs[j]}") / F.col("_n")) * F.first(wide[xs[i]]) * F.first(wide[xs[j]]) * p).alias(f"c_{i}_{j}") for i, j in pairs),
    )
    drawn = own.select("_k", "_rows", *xs, F.explode(F.array(*(F.lit(2 + n) for n in range(subsets)))).alias("_s"))
    drawn = drawn.where(F.pmod(F.xxhash64("_s", *xs), F.lit(1 << 20)) * F.col("_rows") < F.lit(subset_rows << 20))
    return middle.unionByName(signs.withColumn("_s", F.lit(1))).unionByName(_moments(drawn, xs))


def _log_distance(xs: list[str]) -> Column:
    return F.round(F.log(F.greatest(_distance(xs), F.lit(1e-4))), 2)


def estimate(fit: DataFrame, share: float, subsets: int, subset_rows: int, most_steps: int, settled: float) -> DataFrame:
    """From fit(_k, dimensions), by group: logdet, means m_<x> and the inverse Cholesky factor's entries l_<i>_<j>."""
    xs, p = list(DIMS), len(DIMS)
    q_share = chi2_quantile(p, share)
    factor = share / (NormalDist().cdf(((q_share / (p + 2)) ** (1 / 3) - (1 - 2 / (9 * (p + 2)))) / sqrt(2 / (9 * (p + 2)))))

    def step(est: DataFrame) -> DataFrame:
        near = fit.join(sized(est, starts), "_k").select(*KEY, *xs, _log_distance(xs).alias("_d"))
        cut = in_few(near.groupBy(*KEY).agg(F.percentile("_d", share).alias("_c")), starts, 2000)
        inside = near.join(sized(cut, starts), list(KEY)).where("_d <= _c")
        return written(in_few(_whiten(_moments(inside, xs), xs, factor), starts, 2000), "quality-step")

    est = written(_whiten(_starts(fit, xs, subsets, subset_rows), xs, 1.0), "quality-start")
    starts = est.count()
    for _ in range(2):
        est = step(est)
    rank = est.groupBy("_k").agg(F.slice(F.array_sort(F.collect_list(F.struct("logdet", "_s"))), 1, 2).alias("_best"))  # of 2 + subsets starts
    best = rank.select("_k", F.explode("_best._s").alias("_s"))
    est = written(in_few(est.join(sized(best, starts), list(KEY)), starts, 2000), "quality-step")
    for _ in range(most_steps - 2):
        before, est = est.select(*KEY, F.col("logdet").alias("_was")), step(est)
        if (est.join(before, list(KEY)).agg(F.max(F.abs(F.col("logdet") - F.col("_was")))).first()[0] or 0.0) < settled:
            break
    least = est.groupBy("_k").agg(F.min(F.struct("logdet", "_s")).alias("_least")).select("_k", F.col("_least._s").alias("_s"))
    return written(in_few(est.join(sized(least, starts), list(KEY)).drop("_s"), starts, 2000), "quality-least")


def judge(stats: DataFrame, min_rows: int = 100, share: float = 0.75, subsets: int = 3, subset_rows: int = 40, most_steps: int = 20, settled: float = 1e-3, tail: float = 1e-4) -> DataFrame:
    """Adds distance2 (squared, null without a verdict) and kept to text statistics that hold base_failed.

    Distances are scaled so that their group's median is that of the chi-squared law, and rejected beyond its 1 - `tail`
    quantile. Steps end when no group's logarithm of the determinant changes by `settled`, or after `most_steps`.
    """
    xs, p = list(DIMS), len(DIMS)
    stats = written(_vector(stats), "quality-counts")  # a filter on top of the text's expressions would copy them into itself
    d = group_keys(stats, min_rows)
    d = written(d, "quality-stats")
    fit = d.where("_k is not null and not base_failed").select("_k", *xs)
    est = estimate(fit, share, subsets, subset_rows, most_steps, settled)
    groups = est.count()
    scale = fit.join(sized(est, groups), "_k").select("_k", _log_distance(xs).alias("_d")).groupBy("_k").agg(F.exp(F.percentile("_d", 0.5)).alias("_med"))
    final = written(in_few(est.join(sized(scale, groups), "_k"), groups, 2000), "quality-final")
    out = d.join(sized(final, groups), "_k", "left").withColumn("distance2", _distance(xs) * chi2_quantile(p, 0.5) / F.greatest(F.col("_med"), F.lit(chi2_quantile(p, 0.5))))
    cutoff = chi2_quantile(p, 1 - tail)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, **parameters) -> DataFrame:
    """One row for each document: its counts, base_failed, distance2 and kept."""
    stats = text_stats(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"]).withColumn("base_failed", base_failed())
    return judge(stats, **parameters).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def quality_filter(docs: DataFrame, **parameters) -> DataFrame:
    """The documents that are kept, with their columns. Rows are told apart by doc_id and text."""
    key = lambda: F.xxhash64(F.col("doc_id"), F.col("text"))
    stats = text_stats(docs.select("doc_id", "lang", "source", "text").withColumn("_key", key()).withColumnRenamed("_key", "row_key"), ["lang", "source", "row_key"]).withColumn("base_failed", base_failed())
    rejected = written(judge(stats, **parameters).where("not kept").select(F.col("row_key").alias("_rejected")).distinct(), "quality-rejected")
    return docs.join(sized(rejected), key() == rejected["_rejected"], "left_anti")
