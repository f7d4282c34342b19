"""Queries over samples and series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import scalars, temporal
from ..operators import accuracy, change, cube, sampling
from ..operators import series as S
from ..sources import catalog, sinks
from . import tables as T
from .registry import query
from .tables import sql


def r6(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


ALL = ["t_max", "t_min", "t_mean", "t_sum", "t_median", "t_std", "t_skewness", "t_kurtosis", "t_amplitude", "t_mse", "t_fqr", "t_tqr", "t_iqr", "t_fslope"]
Q5 = "(list_sort(l)[greatest(least(cast(floor(len(l) * {p} + 0.5) as int), len(l)), 1)] + (list_sort(l)[greatest(least(cast(floor(len(l) * {p} + 0.5) as int) + 1, len(l)), 1)] - list_sort(l)[greatest(least(cast(floor(len(l) * {p} + 0.5) as int), len(l)), 1)]) * (len(l) * {p} + 0.5 - floor(len(l) * {p} + 0.5)))"
REDUCE = """, s as (select *, abs(qty - lag(qty) over (partition by sample_id order by idx)) as slope from series),
 m as (select sample_id, avg(qty) as m, count(*) as n from series group by 1),
 q as (select s.sample_id, max(qty) as t_max, min(qty) as t_min, avg(qty) as t_mean, sum(qty) as t_sum, median(qty) as t_median, coalesce(stddev_samp(qty), 0) as t_std,
   avg((qty - m) ** 3) / avg((qty - m) ** 2) ** 1.5 * (sqrt(any_value(n) * (any_value(n) - 1)) / any_value(n) - 2) as t_skewness, avg((qty - m) ** 4) / avg((qty - m) ** 2) ** 2 as t_kurtosis,
   max(qty) - min(qty) as t_amplitude, sum(qty * qty) as t_mse, list(qty) as l, max(slope) as t_fslope from s join m on s.sample_id = m.sample_id group by 1)
 select sample_id, {cols} from q"""
COLS = ", ".join(f"round({Q5.format(p=0.25) if c == 't_fqr' else Q5.format(p=0.75) if c == 't_tqr' else f'{Q5.format(p=0.75)} - {Q5.format(p=0.25)}' if c == 't_iqr' else c}, 6) as {c}" for c in ALL)


@query("reduce_samples", sql("series") + REDUCE.format(cols=COLS))
def reduce_samples(spark, d):
    return r6(S.reduce(T.series(spark, d), "QTY", ALL), *ALL)


@query("reduce_observations", sql("obs") + " select sample_id, band, max(value) as t_max, min(value) as t_min, round(avg(value), 6) as t_mean, round(max(value) - min(value), 6) as t_amplitude from obs group by 1, 2")
def reduce_observations(spark, d):
    by = ["t_max", "t_min", "t_mean", "t_amplitude"]
    return r6(S.reduce(T.observations(spark, d), "value", by, ["sample_id", "band"], "date"), "t_mean", "t_amplitude")


@query("select_interval", sql("series") + " select sample_id, idx as index, label, qty as QTY from series where idx between date '1996-01-01' and date '1997-06-30' and label in ('ASIA', 'EUROPE')")
def select_interval(spark, d):
    return S.select(T.series(spark, d), bands=["QTY"], start="1996-01-01", end="1997-06-30", labels=["ASIA", "EUROPE"])


@query("select_dates", sql("series") + ", k as (select * from series where idx in (date '1996-01-01', date '1997-01-01')) select sample_id, min(idx) as start_date, max(idx) as end_date, count(*) as n from k group by 1")
def select_dates(spark, d):
    k = S.restart(S.select(T.series(spark, d), dates=["1996-01-01", "1997-01-01"]))
    return k.groupBy("sample_id").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.count("*").alias("n"))


@query("apply_bands", sql("series") + " select sample_id, idx as index, round((price - qty) / (price + qty), 6) as ND, round(price / 2, 4) as HALF from series")
def apply_bands(spark, d):
    x = S.apply(T.series(spark, d), nd="(PRICE - QTY) / (PRICE + QTY)", half="PRICE / 2", price="0")
    return r6(r6(x.select("sample_id", "index", "ND", "HALF"), "ND"), "HALF", digits=4)


@query("apply_across", sql("series") + " select sample_id, idx as index, round(ln(qty), 6) as QTY, round(ln(price), 6) as PRICE from series")
def apply_across(spark, d):
    return r6(S.across(T.series(spark, d), ["QTY", "PRICE"], F.log).select("sample_id", "index", "QTY", "PRICE"), "QTY", "PRICE")


@query("impute_linear", sql("series", "gappy") + """, n as (select *, row_number() over w as i from gappy window w as (partition by sample_id order by idx)),
 f as (select *, last_value(qty ignore nulls) over b as a, first_value(qty ignore nulls) over f as z, last_value(case when qty is not null then i end ignore nulls) over b as ia, first_value(case when qty is not null then i end ignore nulls) over f as iz
   from n window b as (partition by sample_id order by idx rows between unbounded preceding and current row), f as (partition by sample_id order by idx rows between current row and unbounded following))
 select sample_id, idx as index, round(coalesce(qty, a + (z - a) * (i - ia) / nullif(iz - ia, 0), a, z), 6) as QTY from f""")
def impute_linear(spark, d):
    return r6(S.impute_linear(T.gappy(spark, d), "QTY").select("sample_id", "index", "QTY"), "QTY")


@query("filter_sgolay", sql("series") + """, n as (select *, row_number() over w as i, count(*) over (partition by sample_id) as c, lag(qty, 2) over w as a, lag(qty) over w as b, lead(qty) over w as d, lead(qty, 2) over w as e from series window w as (partition by sample_id order by idx))
 select sample_id, idx as index, round((-3 * a + 12 * b + 17 * qty + 12 * d - 3 * e) / 35, 6) as QTY from n where i > 2 and i <= c - 2""")
def filter_sgolay(spark, d):
    from pyspark.sql.window import Window

    x = S.sgolay(T.series(spark, d), "QTY")
    w = Window.partitionBy("sample_id").orderBy("index")
    x = x.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("sample_id"))}).where("_i > 2 and _i <= _n - 2")
    return r6(x.select("sample_id", "index", "QTY"), "QTY")


#: The smoother's system is symmetric with five diagonals: factors d, c, e and the forward solution z by date, then back.
WHITTAKER = sql("series").replace("with ", "with recursive ", 1) + """, y as (select sample_id, idx, qty as y, row_number() over (partition by sample_id order by idx) as i, count(*) over (partition by sample_id) as n from series),
 m as (select *, 1 + 0.5 * ((i <= n - 2)::int + 4 * (i between 2 and n - 1)::int + (i >= 3)::int) as a, -((i <= n - 2)::int + (i between 2 and n - 1)::int) * 1.0 as b, 0.5 * (i <= n - 2)::int as f from y),
 fw as (select sample_id, idx, i, n, a::double as d, (b / a)::double as c, (f / a)::double as e, y::double as z, 0.0::double as d0, 0.0::double as c0, 0.0::double as e0, 0.0::double as z0 from m where i = 1
  union all select m.sample_id, m.idx, m.i, m.n, dd, (m.b - p.d * p.c * p.e) / dd, m.f / dd, m.y - p.c * p.z - p.e0 * p.z0, p.d, p.c, p.e, p.z
   from fw p join (select m.*, 0 as _ from m) m on m.sample_id = p.sample_id and m.i = p.i + 1, lateral (select m.a - p.d * p.c * p.c - p.d0 * p.e0 * p.e0 as dd) l),
 bw as (select sample_id, idx, i, z / d as x, 0.0::double as x1 from fw where i = n
  union all select f.sample_id, f.idx, f.i, f.z / f.d - f.c * q.x - f.e * q.x1, q.x from bw q join fw f on f.sample_id = q.sample_id and f.i = q.i - 1)
 select sample_id, idx as index, round(x, 6) as QTY from bw"""


@query("filter_whittaker", WHITTAKER)
def filter_whittaker(spark, d):
    return r6(S.whittaker(T.series(spark, d), "QTY", 0.5), "QTY")


@query("nest_unnest", sql("series") + " select sample_id, cast(row_number() over (partition by sample_id order by idx) - 1 as int) as place, idx as index, qty as QTY from series")
def nest_unnest(spark, d):
    return S.unnest(S.nest(T.series(spark, d), ["QTY"]))


@query("predictors_wide", sql("series") + ", n as (select *, row_number() over (partition by sample_id order by idx) as i from series) select sample_id, label, " + ", ".join(f"max(case when i = {i} then {b} end) as {b.upper()}{i}" for b in ("qty", "price") for i in range(1, 13)) + " from n where i <= 12 group by 1, 2")
def predictors_wide(spark, d):
    return S.predictors(T.series(spark, d), ["QTY", "PRICE"], 12)


@query("stats_first", sql("series") + " select round(quantile_cont(qty, 0.02), 6) as QTY_q02, round(quantile_cont(qty, 0.98), 6) as QTY_q98 from series where sample_id = (select min(sample_id) from series)")
def stats_first(spark, d):
    return r6(S.stats(T.series(spark, d), ["QTY"]), "QTY_q02", "QTY_q98")


@query("normalize", sql("series") + ", q as (select quantile_cont(qty, 0.02) as a, quantile_cont(qty, 0.98) as b from series) select sample_id, idx as index, round(greatest(least((qty - a) / (b - a), 1.0), 0.0001), 6) as QTY from series, q")
def normalize(spark, d):
    x = T.series(spark, d)
    return r6(S.normalize(x, S.stats(x, ["QTY"], scope="all"), ["QTY"]).select("sample_id", "index", "QTY"), "QTY")


@query("prune_length", sql("series") + ", n as (select sample_id, count(*) as n from series group by 1) select sample_id, n from n where n = (select median(n) from n)")
def prune_length(spark, d):
    return S.prune(T.series(spark, d)).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("split_timeline", sql("series") + ", n as (select *, (row_number() over (partition by sample_id order by idx) - 1) // 12 as chunk from series) select sample_id, cast(chunk as int) as chunk, min(idx) as from_date, max(idx) as to_date, sum(qty) as qty from n group by 1, 2 having count(*) = 12")
def split_timeline(spark, d):
    return S.split(T.series(spark, d), 12).groupBy("sample_id", "chunk").agg(F.min("index").alias("from_date"), F.max("index").alias("to_date"), F.sum("QTY").alias("qty"))


@query("align_dates", sql("series") + ", r as (select idx as to_date, row_number() over (order by idx) as i from series where sample_id = 1), n as (select *, row_number() over (partition by sample_id order by idx) as i from series) select sample_id, to_date as index, qty as QTY from n join r using (i)")
def align_dates(spark, d):
    x = T.series(spark, d)
    return S.align(x, x.where("sample_id = 1").select("index")).select("sample_id", "index", "QTY")


@query("merge_samples", sql("series") + """, a as (select *, row_number() over (partition by sample_id order by idx) as i from series where idx < date '1998-01-01'),
 b as (select *, row_number() over (partition by sample_id order by idx) as i from series where idx >= date '1998-01-01')
 select a.sample_id, a.idx as index, a.label, a.qty as qty1, b.qty as qty2 from a join b on a.sample_id = b.sample_id and a.i = b.i""")
def merge_samples(spark, d):
    x = T.series(spark, d).drop("PRICE")
    cut = F.lit("1998-01-01").cast("date")
    m = S.merge(x.where(F.col("index") < cut), x.where(F.col("index") >= cut))
    return m.withColumnsRenamed({"QTY.1": "qty1", "QTY.2": "qty2"})


@query("patterns_median", sql("series") + " select label, idx as index, median(qty) as QTY, round(median(price), 3) as PRICE from series group by 1, 2")
def patterns_median(spark, d):
    return r6(S.patterns(T.series(spark, d), ["QTY", "PRICE"]), "PRICE", digits=3)


@query("summary_samples", sql("series") + ", n as (select label, count(distinct sample_id) as count from series group by 1) select label, count, round(count / sum(count) over (), 6) as prop from n")
def summary_samples(spark, d):
    return r6(S.summary(T.series(spark, d)), "prop")


@query("relabel", sql("series") + " select distinct sample_id, case label when 'ASIA' then 'East' when 'EUROPE' then 'West' else label end as label from series")
def relabel(spark, d):
    return S.relabel(T.series(spark, d), {"ASIA": "East", "EUROPE": "West"}).select("sample_id", "label").distinct()


@query("labels", sql("series") + " select distinct label from series")
def labels(spark, d):
    return T.series(spark, d).select("label").distinct()


@query("timeline", sql("series") + " select distinct idx as index from series where sample_id = 1")
def timeline(spark, d):
    return T.series(spark, d).where("sample_id = 1").select("index").distinct()


@query("bbox", sql("points") + " select min(longitude) as xmin, min(latitude) as ymin, max(longitude) as xmax, max(latitude) as ymax from points")
def bbox(spark, d):
    return cube.bbox(T.points(spark, d))


@query("bbox_group", sql("points") + " select label, min(longitude) as xmin, max(latitude) as ymax from points group by 1")
def bbox_group(spark, d):
    return T.points(spark, d).groupBy("label").agg(F.min("longitude").alias("xmin"), F.max("latitude").alias("ymax"))


@query("class_statistics", sql("series") + " select label, round(avg(qty), 6) as QTY_mean, round(stddev_samp(qty), 6) as QTY_sd from series group by 1")
def class_statistics(spark, d):
    return r6(change.class_statistics(T.series(spark, d), ["QTY"]), "QTY_mean", "QTY_sd")


# ---- sampling -----------------------------------------------------------------------------------------------------
PTS = sql("points") + ", r as (select *, row_number() over (partition by label order by (sample_id * 2654435761) % 2147483647, sample_id) as r, count(*) over (partition by label) as n from points)"


@query("sample_fraction", PTS + " select sample_id, label from r where r <= round(n * 0.1)")
def sample_fraction(spark, d):
    return sampling.sample(T.points(spark, d), 0.1).select("sample_id", "label")


@query("sample_oversample", PTS + " select sample_id, label from r union all select sample_id, label from r where r <= round(n * 0.5)")
def sample_oversample(spark, d):
    return sampling.sample(T.points(spark, d), 1.5, oversample=True).select("sample_id", "label")


@query("train_test_split", PTS + " select sample_id, label, r <= round(n * 0.8) as train from r")
def train_test_split(spark, d):
    return sampling.split(T.points(spark, d), 0.2).select("sample_id", "label", "train")


@query("folds", PTS + " select sample_id, label, cast((r - 1) % 5 + 1 as int) as fold from r")
def folds(spark, d):
    return sampling.folds(T.points(spark, d), 5).select("sample_id", "label", "fold")


@query("stratified_points", PTS + " select sample_id, label from r where (label = 'BUILDING' and r <= 24) or (label = 'MACHINERY' and r <= 12)")
def stratified_points(spark, d):
    return sampling.stratified_points(T.points(spark, d), {"BUILDING": 20, "MACHINERY": 10}, "sample_id").select("sample_id", "label")


@query("weighted_points", sql("points") + """, k as (select sample_id, label, -ln(((sample_id * 2654435761) % 2147483647 + 1) / 2147483648.0) / (1 + sample_id % 7) as k from points),
 r as (select *, row_number() over (partition by label order by k, sample_id) as r from k) select sample_id, label from r where r <= 15""")
def weighted_points(spark, d):
    return sampling.weighted_points(T.points(spark, d).withColumn("w", 1 + F.col("sample_id") % 7), 15, "w", "sample_id").select("sample_id", "label")


# ---- accuracy -----------------------------------------------------------------------------------------------------
CONF = sql("pairs") + ", t as (select predicted, reference, count(*) as n from pairs where predicted in (select distinct reference from pairs) group by 1, 2)"


@query("confusion", CONF + " select * from t")
def confusion(spark, d):
    return accuracy.confusion(T.pairs(spark, d))


@query("overall_accuracy", CONF + """, a as (select sum(n) as n, sum(case when predicted = reference then n else 0 end) as hit from t), r as (select predicted as l, sum(n) as x from t group by 1), c as (select reference as l, sum(n) as y from t group by 1), p as (select sum(x * y) as xy from r join c using (l))
 select round(hit / n, 8) as accuracy, round((hit / n - xy / (n * n)) / (1 - xy / (n * n)), 8) as kappa from a, p""")
def overall_accuracy(spark, d):
    return r6(accuracy.overall(accuracy.confusion(T.pairs(spark, d))), "accuracy", "kappa", digits=8)


@query("accuracy_by_class", CONF + """, a as (select sum(n) as t from t), r as (select predicted as label, sum(n) as p, sum(case when predicted = reference then n else 0 end) as h from t group by 1), c as (select reference as label, sum(n) as f from t group by 1),
 z as (select coalesce(r.label, c.label) as label, coalesce(p, 0) as p, coalesce(h, 0) as h, coalesce(f, 0) as f, t from r full join c on r.label = c.label, a),
 y as (select label, h / nullif(f, 0) as sensitivity, (t - p - f + h) / nullif(t - f, 0) as specificity, h / nullif(p, 0) as ppv, (t - p - f + h) / nullif(t - p, 0) as npv from z)
 select label, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity, round(ppv, 6) as ppv, round(npv, 6) as npv, round(2 * ppv * sensitivity / nullif(ppv + sensitivity, 0), 6) as f1 from y""")
def accuracy_by_class(spark, d):
    return r6(accuracy.by_class(accuracy.confusion(T.pairs(spark, d))), "sensitivity", "specificity", "ppv", "npv", "f1")


AREAS = "(values ('A', 5000.0), ('N', 12000.0), ('R', 3000.0)) as v(label, area)"


def areas(spark):
    return spark.createDataFrame([("A", 5000.0), ("N", 12000.0), ("R", 3000.0)], "label string, area double")


@query("area_accuracy", CONF + f""", v as (select label, area, area / sum(area) over () as w, sum(area) over () as total from {AREAS}), r as (select predicted as label, sum(n) as ni from t group by 1),
 p as (select predicted, reference, total, w * n / ni as prop, (w * (w * n / ni) - (w * n / ni) ** 2) / (ni - 1) as v from t join r on t.predicted = r.label join v on t.predicted = v.label),
 c as (select reference as label, sum(prop) as pr, sqrt(sum(v)) as se, max(total) as total, sum(case when predicted = reference then prop else 0 end) as diag from p group by 1), u as (select predicted as label, sum(prop) as pp from p group by 1),
 o as (select sum(case when predicted = reference then prop else 0 end) as overall from p)
 select label, round(pr * total, 4) as adjusted_area, round(se * total, 4) as stderr_area, round(1.96 * se * total, 4) as conf_interval, round(diag / nullif(pp, 0), 4) as user_acc, round(diag / nullif(pr, 0), 4) as prod_acc, round(overall, 4) as overall from c left join u using (label), o""")
def area_accuracy(spark, d):
    x = accuracy.area_assess(accuracy.confusion(T.pairs(spark, d)), areas(spark))
    return r6(x, "adjusted_area", "stderr_area", "conf_interval", "user_acc", "prod_acc", "overall", digits=4)


@query("sampling_design", f"""with v as (select label, area, area / sum(area) over () as prop, 0.433 as std_dev from {AREAS}), n as (select *, round_even((sum(prop * std_dev) over () / 0.01) ** 2, 0) as n, count(*) over () as k, prop <= 0.2 as rare from v),
 r as (select *, sum(case when rare then 1 else 0 end) over () as nr, sum(case when rare then prop else 0 end) over () as pr from n)
 select label, round(prop, 6) as prop, cast(round_even(n / k, 0) as bigint) as equal, cast(round_even(n * prop, 0) as bigint) as alloc_prop, cast(case when rare then 100 else round_even(prop / (1 - pr) * (n - 100 * nr), 0) end as bigint) as alloc_100 from r""")
def sampling_design(spark, d):
    x = accuracy.sampling_design(areas(spark), {}, rare=0.2)
    return r6(x.select("label", "prop", "equal", "alloc_prop", "alloc_100"), "prop")


@query("contingency", sql("pairs") + " select coalesce(predicted, 'Total') as predicted, coalesce(reference, 'Total') as reference, count(*) as n from pairs group by cube (predicted, reference)")
def contingency(spark, d):
    return accuracy.contingency(T.pairs(spark, d), "predicted", "reference")


@query("rand_indices", sql("pairs") + """, t as (select predicted as a, reference as b, cast(count(*) as double) as n from pairs group by 1, 2), x as (select sum(n * (n - 1) / 2) as pab, sum(n * ln(n)) as hab, sum(n) as n from t), y as (select sum(n * (n - 1) / 2) as pa, sum(n * ln(n)) as ha from (select sum(n) as n from t group by a)), z as (select sum(n * (n - 1) / 2) as pb, sum(n * ln(n)) as hb from (select sum(n) as n from t group by b)),
 w as (select *, n * (n - 1) / 2 as al, pa * pb / (n * (n - 1) / 2) as ex from x, y, z)
 select round((al + 2 * pab - pa - pb) / al, 6) as rand, round((pab - ex) / ((pa + pb) / 2 - ex), 6) as adjusted_rand, round(pab / (pa + pb - pab), 6) as jaccard, round(pab / sqrt(pa * pb), 6) as fowlkes_mallows, round((ha + hb - 2 * hab) / n, 6) as variation from w""")
def rand_indices(spark, d):
    return r6(accuracy.rand_indices(T.pairs(spark, d), "predicted", "reference"), "rand", "adjusted_rand", "jaccard", "fowlkes_mallows", "variation")


@query("cluster_majority", sql("pairs") + ", n as (select predicted, reference, count(*) as n from pairs group by 1, 2), m as (select *, row_number() over (partition by predicted order by n desc, reference) as r from n) select predicted, reference, n from m where r = 1")
def cluster_majority(spark, d):
    return accuracy.majority(T.pairs(spark, d), "predicted", "reference").groupBy("predicted", "reference").agg(F.count("*").alias("n"))


@query("cluster_purity", sql("pairs") + ", n as (select predicted, reference, count(*) as n from pairs group by 1, 2) select predicted, reference, round(100 * n / sum(n) over (partition by predicted), 6) as percent from n")
def cluster_purity(spark, d):
    return r6(accuracy.purity(T.pairs(spark, d), "predicted", "reference"), "percent")


# ---- dates and periods --------------------------------------------------------------------------------------------
@query("period_windows", """with s as (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + 180 as b from orders), w as (select s.*, cast(k as double) as k from s, range(0, 6) r(k) where k * 30.4375 < 180)
 select o_orderkey, a + cast(floor(k * 30.4375) as int) as window_start, least(a + cast(floor(k * 30.4375 + 91.3125) as int), b) as window_end from w""")
def period_windows(spark, d):
    s = T.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start_date")).withColumn("end_date", F.date_add("start_date", 180))
    return D.period_windows(s, "P3M", "P1M").select("o_orderkey", "window_start", "window_end")


@query("parse_dates", "select o_orderkey, cast(o_orderdate as date) as full_date, cast(date_trunc('month', o_orderdate) as date) as month_date, cast(date_trunc('year', o_orderdate) as date) as year_date, cast(o_orderdate as date) as compact_date from orders")
def parse_dates(spark, d):
    o = T.read(spark, d, "orders")
    p = lambda f: D.parse_date(F.date_format("o_orderdate", f))
    return o.select("o_orderkey", p("yyyy-MM-dd").alias("full_date"), p("yyyy-MM").alias("month_date"), p("yyyy").alias("year_date"), p("yyyyMMdd").alias("compact_date"))


@query("period_parts", "select distinct 'P' || cast(p_size as varchar) || 'D' as period, p_size as n, 'day' as unit from part")
def period_parts(spark, d):
    p = F.concat(F.lit("P"), F.col("p_size").cast("string"), F.lit("D"))
    return T.read(spark, d, "part").select(p.alias("period"), D.period_value(p).alias("n"), D.period_unit(p).alias("unit")).distinct()


@query("valid_timeline", sql("series") + ", b as (select label, min(idx) as a, max(idx) as z from series group by 1) select label, cast(unnest(generate_series(cast(date_trunc('year', a) as date), z, interval 1 year)) as date) as date from b")
def valid_timeline(spark, d):
    b = T.series(spark, d).groupBy("label").agg(F.min("index").alias("a"), F.max("index").alias("z"))
    return b.select("label", F.explode(D.valid_timeline(F.col("a"), F.col("z"), "P1Y")).alias("date"))


@query("interval_overlap", """with s as (select o_custkey as c, l_orderkey as k, min(cast(l_shipdate as date)) as a, max(cast(l_shipdate as date)) as b from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
 select x.c as c_custkey, x.k as id1, y.k as id2 from s x join s y on x.c = y.c and x.k < y.k and x.a <= y.b and y.a <= x.b""")
def interval_overlap(spark, d):
    """Orders of a customer whose shipping overlaps."""
    s = T.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("a"), F.max(F.to_date("l_shipdate")).alias("b"))
    s = s.join(T.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return S.overlapping(s, ["c_custkey"], "l_orderkey", "a", "b")


# ---- scalars over vectors -----------------------------------------------------------------------------------------
SOFT = sql("vectors") + ", e as (select sample_id, list_transform(x, lambda v: exp(v - list_max(x))) as e from vectors), p as (select sample_id, list_transform(e, lambda v: v / list_sum(e)) as p from e)"


def soft(spark, d):
    return T.vectors(spark, d).select("sample_id", scalars.softmax(F.col("x")).alias("p"))


@query("softmax", SOFT + " select sample_id, round(p[1], 8) as p1, round(list_max(p), 8) as top, round(list_sum(p), 6) as total from p")
def softmax(spark, d):
    x = soft(spark, d).select("sample_id", F.col("p")[0].alias("p1"), F.array_max("p").alias("top"), F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("total"))
    return r6(r6(x, "p1", "top", digits=8), "total")


@query("vector_uncertainty", SOFT + " select sample_id, round(-list_sum(list_transform(p, lambda v: v * ln(v))) / ln(len(p)), 8) as entropy, round(1 - (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]), 8) as margin, round(1 - list_max(p), 8) as least, cast(list_position(p, list_max(p)) as int) as label from p")
def vector_uncertainty(spark, d):
    p = F.col("p")
    x = soft(spark, d).select("sample_id", scalars.entropy(p).alias("entropy"), scalars.margin(p).alias("margin"), scalars.least_confidence(p).alias("least"), scalars.label_max(p).alias("label"))
    return r6(x, "entropy", "margin", "least", digits=8)


@query("minkowski", sql("vectors") + " select sample_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 8) as norm, round(list_sum(list_transform(x, lambda v: abs(v) ** 3)) ** (1.0 / 3), 8) as norm3 from vectors")
def minkowski(spark, d):
    zero = F.transform("x", lambda v: F.lit(0.0))
    return r6(T.vectors(spark, d).select("sample_id", scalars.minkowski(F.col("x"), zero).alias("norm"), scalars.minkowski(F.col("x"), zero, 3.0).alias("norm3")), "norm", "norm3", digits=8)


@query("densities", "select p_partkey, round(exp(-0.5 * ((p_size - 25) / 10.0) ** 2) / (10 * sqrt(2 * pi())), 10) as density, round(0.3 * x / (0.3 * x + 0.7 * (1 - x)), 8) as posterior from (select *, (p_size + 1) / 60.0 as x from part)")
def densities(spark, d):
    x = (F.col("p_size") + 1) / F.lit(60.0)
    p = T.read(spark, d, "part").select("p_partkey", scalars.normal_density(F.col("p_size").cast("double"), 25.0, 10.0).alias("density"), scalars.bayes_posterior(F.lit(0.3), x).alias("posterior"))
    return r6(r6(p, "density", digits=10), "posterior", digits=8)


@query("mask_missing", "select vec_id as sample_id, list_min(embedding) < -0.3 as missing, case when list_min(embedding) < -0.3 then -1.0 else round(cast(embedding[1] as double), 5) end as first from embeddings")
def mask_missing(spark, d):
    x = T.vectors(spark, d).withColumn("x", F.transform("x", lambda v: F.when(v >= F.lit(-0.3).cast("float").cast("double"), v)))
    return r6(x.select("sample_id", scalars.any_missing(F.col("x")).alias("missing"), scalars.fill_row(F.col("x"), -1.0)[0].alias("first")), "first", digits=5)


# ---- change and patterns ------------------------------------------------------------------------------------------
@query("non_forest", sql("series") + """, p as (select sample_id, idx, exp(-0.5 * ((qty - 200) / 60.0) ** 2) / 60 as f1, exp(-0.5 * ((qty - 140) / 70.0) ** 2) / 70 as n1, exp(-0.5 * ((price - 500000) / 150000.0) ** 2) / 150000 as f2, exp(-0.5 * ((price - 350000) / 150000.0) ** 2) / 150000 as n2 from series),
 q as (select *, greatest(least(case when n1 / sqrt(2 * pi()) < 0.00001 then 0 else n1 / (n1 + f1) end, 0.9), 0.1) as p1 from p) select sample_id, idx as index, round(p1, 6) as p from q""")
def non_forest(spark, d):
    return r6(T.series(spark, d).select("sample_id", "index", change.non_forest({"QTY": (200.0, 60.0, 140.0, 70.0)}).alias("p")), "p")


def change_sql(rows: str, keys: str) -> str:
    """Runs of every start at once, date by date; rows: a relation of the keys, idx and p."""
    join = " and ".join(f"st.{k} = a.{k}" for k in keys.split(", "))
    last = " and ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    own = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    on = " and ".join(f"e.{k} = f.{k}" for k in keys.split(", "))
    step = lambda c: f"{c} * a.p / greatest({c} * a.p + (1 - {c}) * (1 - a.p), 1e-15)"
    return f"""a as (select {keys}, idx, p, row_number() over (partition by {keys} order by idx) as i from {rows} where p is not null),
 st as (select {own("a")}, a.i as s, a.i as k, {step("coalesce(b.p, cast(0.5 as double))")} as change, a.p, a.idx from a left join a b on {last} and b.i = a.i - 1 where a.p > 0.5
  union all select {own("st")}, st.s, a.i, {step("st.change")}, a.p, a.idx from st join a on {join} and a.i = st.k + 1 where not (st.k > st.s and st.change < 0.5) and not (st.change >= 0.9 and st.p >= 0.5)),
 e as (select {keys}, s, arg_max(change, k) as change, arg_max(p, k) as p, arg_max(idx, k) as idx, max(k) as k from st group by {keys}, s),
 f as (select {keys}, min(s) as s from e where not (k > s and change < 0.5) group by {keys}),
 g as (select {own("e")}, case when e.change >= 0.9 and e.p >= 0.5 then e.idx end as change from e join f on {on} and e.s = f.s)
 select {own("u")}, g.change from (select distinct {keys} from a) u left join g using ({keys})"""


def _density(x: str, mean: float, sd: float) -> str:
    return f"(exp(-0.5 * (({x} - {mean}) / {sd}) * (({x} - {mean}) / {sd})) / ({sd} * sqrt(2 * pi())))"


def _held(x: str, fm: float, fs: float, nm: float, ns: float) -> str:
    n, f = _density(x, nm, ns), _density(x, fm, fs)
    return f"greatest(least(case when {n} < 0.00001 then 0.0 else {n} / ({n} + {f}) end, 0.9), 0.1)"


@query("detect_changes", sql("series").replace("with ", "with recursive ", 1) + f", h as (select sample_id, idx, {_held('qty', 200.0, 60.0, 140.0, 70.0)} as q, {_held('price', 500000.0, 150000.0, 350000.0, 150000.0)} as r from series), p as (select sample_id, idx, r * q / (r * q + (1 - r) * (1 - q)) as p from h), " + change_sql("p", "sample_id"))
def detect_changes(spark, d):
    p = T.series(spark, d).withColumn("p", change.non_forest({"QTY": (200.0, 60.0, 140.0, 70.0), "PRICE": (500000.0, 150000.0, 350000.0, 150000.0)}))
    return change.detect_changes(p, "p")


def _dtw(spark, d):
    nested = S.nest(S.select(T.series(spark, d), start="1996-01-01", end="1996-12-31"), ["QTY"])
    return change.dtw_distances(nested, SHAPES, ["QTY"], window=6)


def _warped(y: list[float]) -> str:
    """Columns g_i_j of the cells of six dates w1 .. w6 against a pattern, row after row."""
    cells = []
    for i in range(6):
        for j in range(6):
            d = f"abs(w{i + 1} - {y[j]!r})"
            if i == j == 0:
                e = d
            elif j == 0:
                e = f"g_{i - 1}_0 + {d}"
            elif i == 0:
                e = f"g_0_{j - 1} + {d}"
            else:
                e = f"least(g_{i - 1}_{j - 1} + 2 * {d}, g_{i - 1}_{j} + {d}, g_{i}_{j - 1} + {d})"
            cells.append(f"{e} as g_{i}_{j}")
    return ", ".join(cells)


SHAPES = {"rise": np.linspace(50, 250, 6), "fall": np.linspace(250, 50, 6)}
DTW = sql("series") + ", y as (select sample_id, qty, row_number() over (partition by sample_id order by idx) as i from series where idx between date '1996-01-01' and date '1996-12-31'), w as (select " + "w1.sample_id, cast(w1.i - 1 as int) as win, " + ", ".join(f"w{k}.qty as w{k}" for k in range(1, 7)) + " from y w1 " + " ".join(f"join y w{k} on w{k}.sample_id = w1.sample_id and w{k}.i = w1.i + {k - 1}" for k in range(2, 7)) + "), z as (" + " union all ".join(f"select sample_id, '{name}' as label, win as \"window\", {_warped(y.tolist())} from w" for name, y in SHAPES.items()) + "), dist as (select sample_id, label, \"window\", g_5_5 as distance from z)"


@query("dtw_distances", DTW + " select sample_id, label, \"window\", round(distance, 6) as distance from dist")
def dtw_distances(spark, d):
    return r6(_dtw(spark, d), "distance")


@query("dtw_detect", DTW + ", m as (select *, row_number() over (partition by sample_id, label order by distance desc, \"window\") as r from dist where distance >= 500), u as (select distinct sample_id, label from dist) select u.sample_id, u.label, m.\"window\", round(m.distance, 6) as distance from u left join m on m.sample_id = u.sample_id and m.label = u.label and m.r = 1")
def dtw_detect(spark, d):
    return r6(change.dtw_detect(_dtw(spark, d), 500.0), "distance")


# ---- reading and writing ------------------------------------------------------------------------------------------
@query("numbered_samples", sql("points") + " select row_number() over (order by longitude, latitude, label) as id, longitude, latitude, date '1996-01-01' as start_date, date '1998-12-31' as end_date, label from points")
def numbered_samples(spark, d):
    return sinks.numbered(T.points(spark, d)).withColumn("id", F.col("id").cast("long"))


@query("default_points", sql("points") + " select sample_id, longitude, latitude, coalesce(label, 'NoClass') as label, date '2020-01-01' as start_date, date '2020-12-31' as end_date from points")
def default_points(spark, d):
    return catalog.with_defaults(T.points(spark, d).drop("start_date", "end_date"), "2020-01-01", "2020-12-31")


@query("tile_geometry", sql("tiles") + " select tile, 'POLYGON((' || cast(cast(xmin as int) as varchar) || ' ' || cast(cast(ymin as int) as varchar) || ', ' || cast(cast(xmax as int) as varchar) || ' ' || cast(cast(ymin as int) as varchar) || ', ' || cast(cast(xmax as int) as varchar) || ' ' || cast(cast(ymax as int) as varchar) || ', ' || cast(cast(xmin as int) as varchar) || ' ' || cast(cast(ymax as int) as varchar) || ', ' || cast(cast(xmin as int) as varchar) || ' ' || cast(cast(ymin as int) as varchar) || '))' as geometry from tiles")
def tile_geometry(spark, d):
    t = T.tiles(spark, d)
    return sinks.as_boxes(t.select("tile", *(F.col(c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))).select("tile", "geometry")


@query("average_polygon", sql("series") + " select label as polygon_id, label, idx as date, round(avg(qty), 6) as QTY from series group by 1, 2, 3")
def average_polygon(spark, d):
    x = T.series(spark, d).select(F.col("label").alias("polygon_id"), "label", F.col("index").alias("date"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("latitude"), "QTY")
    return r6(cube.average_polygon(x, ["QTY"]).drop("longitude", "latitude"), "QTY")


@query("values_by_date", sql("series") + " select idx as index, arg_min(qty, sample_id) as first, arg_max(qty, sample_id) as last, cast(count(*) as int) as n from series group by 1")
def values_by_date(spark, d):
    x = S.values(T.series(spark, d), ["QTY"], "bands_dates_cases")
    return x.select("index", F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"), F.size("values").alias("n"))


@query("values_by_sample", sql("series") + " select sample_id, arg_min(qty, idx) as first, arg_max(price, idx) as last, cast(count(*) as int) as n from series group by 1")
def values_by_sample(spark, d):
    x = S.values(T.series(spark, d), ["QTY", "PRICE"])
    return x.select("sample_id", F.col("values")[0][0].alias("first"), F.element_at("values", -1)[1].alias("last"), F.size("values").alias("n"))


assert set(ALL) - {"t_fslope"} == set(temporal.REDUCTIONS)


@query("predictions_nested", sql("series") + ", n as (select *, (row_number() over (partition by sample_id order by idx) - 1) // 12 as chunk from series), c as (select sample_id, chunk, min(idx) as a, max(idx) as b, avg(qty) as m from n group by 1, 2 having count(*) = 12) select sample_id, a as \"from\", b as \"to\", case when m > 150 then 'high' else 'low' end as class from c")
def predictions_nested(spark, d):
    from ..operators import learn

    c = S.split(T.series(spark, d), 12).groupBy("sample_id", "chunk").agg(F.min("index").alias("start_date"), F.max("index").alias("end_date"), F.avg("QTY").alias("m"))
    c = c.withColumns({"predicted": F.when(F.col("m") > 150, "high").otherwise("low"), "probs": F.array(F.lit(0.6), F.lit(0.4))})
    return learn.show_predictions(learn.predictions(c, ["high", "low"], ["sample_id"]), ["sample_id"])


@query("smooth_patterns")
def smooth_patterns(spark, d):
    from ..operators import learn

    return r6(learn.smooth_patterns(T.series(spark, d), ["QTY"], 30), "QTY", digits=4)
