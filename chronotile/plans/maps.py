"""Queries over raster pixels: windows, maps of probabilities and classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import learn, maps, sampling
from ..operators import neighbourhood as N
from . import tables as T
from .registry import query
from .samples import change_sql, r6
from .tables import PROBS, sql

CHUNK = 16


def windowed(columns: str, window: int, mirror: bool = True, source: str = "grid") -> str:
    """A CTE n: for each pixel its window's values, by offsets joined on mirrored or cut cells."""
    r = window // 2
    fold = lambda c, n: f"case when {c} < 0 then -{c} - 1 when {c} >= {n} then 2 * {n} - {c} - 1 else {c} end"
    cell = (fold("(g.row + dr)", "nr"), fold("(g.col + dc)", "nc")) if mirror else ("(g.row + dr)", "(g.col + dc)")
    return f""", ext as (select tile, max(row) + 1 as nr, max(col) + 1 as nc from {source} group by 1), offs as (select a.r as dr, b.r as dc from range(-{r}, {r + 1}) a(r), range(-{r}, {r + 1}) b(r)),
 c as (select g.tile, g.row, g.col, {cell[0]} as nrow, {cell[1]} as ncol from {source} g join ext on g.tile = ext.tile cross join offs),
 n as (select c.tile, c.row, c.col, {columns} from c join {source} s on s.tile = c.tile and s.row = c.nrow and s.col = c.ncol)"""


_AGG = {"w_median": "median(value)", "w_mean": "avg(value)", "w_sd": "stddev_samp(value)", "w_min": "min(value)", "w_max": "max(value)", "w_var": "var_samp(value)"}


def _kernel(name: str, agg: str):
    @query(f"kernel_{name}", sql("grid") + windowed("s.value", 3) + f" select tile, row, col, round({agg}, 4) as {name} from n group by 1, 2, 3")
    def run(spark, d):
        return r6(N.kernel(T.grid(spark, d), "value", name, 3, CHUNK), name, digits=4)

    return run


for _name, _agg in _AGG.items():
    _kernel(_name, _agg)


@query("kernel_w_modal", sql("grid") + windowed("s.class", 5) + ", k as (select tile, row, col, class, count(*) as n from n group by all), r as (select *, row_number() over (partition by tile, row, col order by n desc, class) as r from k) select tile, row, col, cast(class as double) as w_modal from r where r = 1")
def kernel_w_modal(spark, d):
    return N.windows(T.grid(spark, d), ["class"], ["w_modal"], 5, lambda v: {"w_modal": N.w_modal(v["class"])}, chunk=CHUNK)


@query("clean", sql("grid") + windowed("s.class", 3) + ", k as (select tile, row, col, class, count(*) as n from n group by all), r as (select *, row_number() over (partition by tile, row, col order by n desc, class) as r from k) select tile, row, col, cast(class as int) as class from r where r = 1")
def clean(spark, d):
    return N.clean(T.grid(spark, d), "class", 3, CHUNK)


def _texture(measure: str, expr: str):
    pairs = """, g1 as (select tile, row, col, least(floor(value / 10.0), 999) as v from grid), ext as (select tile, max(row) + 1 as nr, max(col) + 1 as nc from g1 group by 1), offs as (select a.r as dr, b.r as dc from range(-1, 2) a(r), range(-1, 1) b(r)),
 c as (select g.tile, g.row, g.col, case when g.row + dr < 0 then -(g.row + dr) - 1 when g.row + dr >= nr then 2 * nr - (g.row + dr) - 1 else g.row + dr end as r1, case when g.col + dc < 0 then -(g.col + dc) - 1 when g.col + dc >= nc then 2 * nc - (g.col + dc) - 1 else g.col + dc end as c1,
   case when g.col + dc + 1 < 0 then -(g.col + dc + 1) - 1 when g.col + dc + 1 >= nc then 2 * nc - (g.col + dc + 1) - 1 else g.col + dc + 1 end as c2 from g1 g join ext on g.tile = ext.tile cross join offs),
 p as (select c.tile, c.row, c.col, x.v as i, y.v as j from c join g1 x on x.tile = c.tile and x.row = c.r1 and x.col = c.c1 join g1 y on y.tile = c.tile and y.row = c.r1 and y.col = c.c2),
 s as (select * from p union all select tile, row, col, j, i from p), q as (select tile, row, col, i, j, count(*) / 12.0 as p from s group by all), m as (select tile, row, col, sum(p * i) as mu from q group by all), z as (select q.*, mu from q join m using (tile, row, col))"""

    @query(f"texture_{measure.removeprefix('glcm_')}", sql("grid") + pairs + f" select tile, row, col, round({expr}, 4) as {measure} from z group by 1, 2, 3")
    def run(spark, d):
        g = T.grid(spark, d).withColumn("value", F.least(F.floor(F.col("value") / 10.0), F.lit(999)).cast("double"))
        return r6(N.texture(g, "value", measure, 3, (0.0,), 1000, CHUNK), measure, digits=4)


_texture("glcm_contrast", "sum(p * (i - j) ** 2)")
_texture("glcm_dissimilarity", "sum(p * abs(i - j))")
_texture("glcm_homogeneity", "sum(p / (1 + (i - j) ** 2))")
_texture("glcm_energy", "sqrt(sum(p * p))")
_texture("glcm_asm", "sum(p * p)")
_texture("glcm_mean", "sum(p * i)")
_texture("glcm_variance", "sum(p * (i - mu) ** 2)")
_texture("glcm_std", "sqrt(sum(p * (i - mu) ** 2))")
_texture("glcm_correlation", "case when sum(p * (i - mu) ** 2) < 1e-15 then 1.0 else sum(p * (i - mu) * (j - mu)) / sum(p * (i - mu) ** 2) end")


def _logits(names=PROBS) -> str:
    total = " + ".join(names)
    return ", lg as (select tile, row, col, " + ", ".join(f"ln({p} / ({total} - {p})) as {p}" for p in names) + " from probs)"


def _top(band: str, k: str) -> str:
    return f"list_reverse_sort(list({band}))[1:cast({k}(0.5 * count({band})) as int)]"


@query("smooth", sql("grid", "probs") + _logits() + windowed("s.a, s.b, s.c", 5, source="lg") + ", h as (select tile, row, col, " + ", ".join(f"{_top(p, 'ceil')} as {p}" for p in PROBS) + " from n group by 1, 2, 3), e as (select h.tile, h.row, h.col, " + ", ".join(f"case when list_var_samp(h.{p}) < 1e-4 then list_avg(h.{p}) else list_var_samp(h.{p}) / (list_var_samp(h.{p}) + 20) * l.{p} + 20 / (list_var_samp(h.{p}) + 20) * list_avg(h.{p}) end as {p}" for p in PROBS) + " from h join lg l using (tile, row, col)), i as (select tile, row, col, " + ", ".join(f"1 / (1 + exp(-{p})) as {p}" for p in PROBS) + " from e) select tile, row, col, " + ", ".join(f"round({p}, 6) as {p}" for p in PROBS) + " from i")
def smooth(spark, d):
    return r6(N.smooth(T.probs(spark, d), PROBS, 5, chunk=CHUNK), *PROBS)


@query("variance", sql("grid", "probs") + _logits() + windowed("s.a, s.b, s.c", 5, mirror=False, source="lg") + " select tile, row, col, " + ", ".join(f"round(coalesce(list_var_samp({_top(p, 'floor')}), 0), 6) as {p}" for p in PROBS) + " from n group by 1, 2, 3")
def variance(spark, d):
    return r6(N.variance(T.probs(spark, d), PROBS, 5, chunk=CHUNK), *PROBS)


@query("block_max", sql("grid") + ", m as (select *, row_number() over (partition by tile, row // 5, col // 5 order by value desc, row, col) as r from grid) select tile, row, col, value from m where r = 1")
def block_max(spark, d):
    return N.block_max(T.grid(spark, d), "value", 5).select("tile", "row", "col", "value")


@query("window_neighbours", sql("grid") + " select g.tile, g.row, g.col, count(*) as n, round(sum(h.value), 4) as total from grid g join grid h on g.tile = h.tile and abs(g.row - h.row) <= 1 and abs(g.col - h.col) <= 1 group by 1, 2, 3")
def window_neighbours(spark, d):
    g = T.grid(spark, d)
    x = N.neighbours(g.select("tile", "row", "col"), g, 3, ["value"])
    return x.select("tile", "row", "col", F.size("neighbors").cast("long").alias("n"), F.aggregate("neighbors", F.lit(0.0), lambda a, v: a + v["value"]).alias("total")).withColumn("total", F.round("total", 4))


P = sql("grid", "probs")


@query("label_classification", P + " select tile, row, col, case when a >= b and a >= c then 1 when b >= c then 2 else 3 end as class, case when a >= b and a >= c then 'a' when b >= c then 'b' else 'c' end as label from probs")
def label_classification(spark, d):
    return maps.label(T.probs(spark, d), PROBS).select("tile", "row", "col", "class", "label")


def _uncertainty(kind: str, expr: str):
    @query(f"uncertainty_{kind}", P + f" select tile, row, col, round({expr}, 8) as {kind} from probs")
    def run(spark, d):
        return r6(maps.uncertainty(T.probs(spark, d), PROBS, kind).select("tile", "row", "col", kind), kind, digits=8)


_uncertainty("entropy", "-(a * ln(a) + b * ln(b) + c * ln(c)) / ln(3)")
_uncertainty("least", "1 - greatest(a, b, c)")
_uncertainty("margin", "1 - (greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c)))")


def _two(spark, d):
    p = T.probs(spark, d)
    return p, p.select("tile", "row", "col", F.col("b").alias("a"), F.col("c").alias("b"), F.col("a").alias("c"))


@query("combine_average", P + " select tile, row, col, round(0.7 * a + 0.3 * b, 8) as a, round(0.7 * b + 0.3 * c, 8) as b, round(0.7 * c + 0.3 * a, 8) as c from probs")
def combine_average(spark, d):
    return r6(maps.combine_average(list(_two(spark, d)), PROBS, [0.7, 0.3]), *PROBS, digits=8)


@query("combine_uncertainty", P + ", w as (select *, 1 / (1 - greatest(a, b, c)) as u, 1 / (0.5 - greatest(a, b, c) / 2) as v from probs) select tile, row, col, round((u * a + v * b) / (u + v), 8) as a, round((u * b + v * c) / (u + v), 8) as b, round((u * c + v * a) / (u + v), 8) as c from w")
def combine_uncertainty(spark, d):
    x, y = _two(spark, d)
    top = F.greatest(*PROBS)
    u = [x.select("tile", "row", "col", (1 - top).alias("entropy")), y.select("tile", "row", "col", (1 - (0.5 + top / 2)).alias("entropy"))]
    return r6(maps.combine_uncertainty([x, y], u, PROBS), *PROBS, digits=8)


@query("reclassify", sql("grid") + " select tile, row, col, case when class = 2 and size > 40 then 'old' when size > 30 then 'large' when class in (1, 2) then 'low' else 'c' || cast(class as varchar) end as label from grid")
def reclassify(spark, d):
    g = T.grid(spark, d).withColumn("label", F.concat(F.lit("c"), F.col("class").cast("string")))
    rules = {"low": F.col("class").isin(1, 2), "large": F.col("size") > 30, "old": (F.col("class") == 2) & (F.col("size") > 40)}
    return maps.reclassify(g, rules).select("tile", "row", "col", "label")


@query("class_areas", sql("grid") + " select tile, class, count(*) as count, round(count(*) * 900 / 10000.0, 6) as area_ha, round(count(*) * 900 / 1000000.0, 6) as area_km2 from grid group by 1, 2")
def class_areas(spark, d):
    return r6(maps.class_areas(T.grid(spark, d), 30, 30, "class", ("tile",)), "area_ha", "area_km2")


@query("class_summary", sql("grid") + ", p as (select class, tile, count(*) as count, count(*) * 0.25 as a from grid group by 1, 2), q as (select class, sum(count) as count, sum(round(a * 10 ** (1 - floor(log10(a)))) / 10 ** (1 - floor(log10(a)))) as area_km2 from p group by 1) select l.class, cast(coalesce(count, 0) as bigint) as count, round(coalesce(area_km2, 0), 6) as area_km2 from range(1, 8) l(class) left join q on l.class = q.class")
def class_summary(spark, d):
    labels = spark.range(1, 8).select(F.col("id").alias("class"))
    return r6(maps.class_summary(T.grid(spark, d).withColumn("class", F.col("class").cast("long")), labels, 500, 500, "class"), "area_km2")


@query("six_numbers", P + " " + " union all ".join(f"select '{p}' as band, round(min({p}), 6) as min, round(quantile_cont({p}, 0.25), 6) as q1, round(median({p}), 6) as median, round(avg({p}), 6) as mean, round(quantile_cont({p}, 0.75), 6) as q3, round(max({p}), 6) as max from probs" for p in PROBS))
def six_numbers(spark, d):
    return r6(maps.six_numbers(T.probs(spark, d), PROBS), "min", "q1", "median", "mean", "q3", "max")


@query("summary_quantiles", P + ", q as (select unnest([0, 0.25, 0.5, 0.75, 1.0]) as quantile) select cast(quantile as double) as quantile, " + ", ".join(f"round(case quantile when 0 then (select min({p}) from probs) when 0.25 then (select quantile_cont({p}, 0.25) from probs) when 0.5 then (select median({p}) from probs) when 0.75 then (select quantile_cont({p}, 0.75) from probs) else (select max({p}) from probs) end, 6) as {p}" for p in PROBS) + " from q")
def summary_quantiles(spark, d):
    return r6(maps.summary_quantiles(T.probs(spark, d), PROBS, 0.25), *PROBS)


@query("histogram", sql("grid") + ", b as (select tile, cast(least(greatest(floor((value - 900) / 60.0), 0), 19) as int) as bin, count(*) as count from grid group by 1, 2) select tile, bin, count, cast(900 + bin * 60.0 as double) as low, round(count / sum(count) over (partition by tile) / 60, 8) as density from b")
def histogram(spark, d):
    return r6(maps.histogram(T.grid(spark, d), "value", 900.0, 2100.0, 20, ("tile",)), "density", digits=8)


@query("confidence_points", P + ", r as (select tile, row, col, unnest([{'l': 'a', 'p': a}, {'l': 'b', 'p': b}, {'l': 'c', 'p': c}]) as u, a, b, c from probs), m as (select *, u.l as label, u.p as confidence, row_number() over (partition by tile, row // 5, col // 5, u.l order by u.p desc, row, col) as k, greatest(a, b, c) as top, a + b + c - greatest(a, b, c) - least(a, b, c) as mid from r), z as (select *, row_number() over (partition by label order by confidence desc, tile, row, col) as rank from m where k = 1 and confidence = top and top - mid >= 0.2) select tile, row, col, label, round(confidence, 8) as confidence, cast(rank as int) as rank from z where rank <= 20")
def confidence_points(spark, d):
    return r6(sampling.confidence(T.probs(spark, d), PROBS, 20, 0.2, 5), "confidence", digits=8)


@query("uncertainty_points", P + ", u as (select tile, row, col, 1 - greatest(a, b, c) as least from probs), m as (select *, row_number() over (partition by tile, row // 5, col // 5 order by least desc, row, col) as k from u), z as (select *, row_number() over (partition by tile order by least desc, row, col) as rank from m where k = 1 and least >= 0.4) select tile, row, col, round(least, 8) as least, cast(rank as int) as rank, 'NoClass' as label from z where rank <= 10")
def uncertainty_points(spark, d):
    return r6(sampling.uncertainty(maps.uncertainty(T.probs(spark, d), PROBS, "least"), "least", 10, 0.4, 5), "least", digits=8)


@query("segment_probabilities", P + ", g as (select tile || '-' || cast(row // 4 as varchar) as pol_id, avg(a) as a, avg(b) as b, avg(c) as c from probs group by 1) select pol_id, round(a / (a + b + c), 8) as a, round(b / (a + b + c), 8) as b, round(c / (a + b + c), 8) as c from g")
def segment_probabilities(spark, d):
    x = T.probs(spark, d).withColumn("pol_id", F.concat(F.col("tile"), F.lit("-"), F.floor(F.col("row") / 4).cast("string")))
    return r6(maps.segment_probabilities(x, PROBS), *PROBS, digits=8)


@query("segments")
def segments(spark, d):
    return learn.segment(T.grid(spark, d), ["value", "size"], step=5, compactness=100.0, chunk=CHUNK)


@query("segment_samples")
def segment_samples(spark, d):
    return learn.sample_segments(segments(spark, d), 15)


MEMBERS = {"soil": [0.8, 0.1, 0.2], "water": [0.1, 0.05, 0.9], "green": [0.4, 0.9, 0.3]}


def _mixture_sql() -> str:
    """The best of the least-squares fits on every subset of the members that has no negative fraction."""
    m, names, fits = np.array(list(MEMBERS.values())), list(MEMBERS), []
    for k in range(1, 1 << len(m)):
        on = [i for i in range(len(m)) if k >> i & 1]
        solve = np.zeros((len(m), m.shape[1]))
        solve[on] = np.linalg.solve(m[on] @ m[on].T, m[on])
        y = [" + ".join(f"({v!r}) * b{j + 1}" for j, v in enumerate(r.tolist())) for r in solve]
        fits.append(f"select tile, row, col, b1, b2, b3, {', '.join(f'{e} as {n}' for e, n in zip(y, names, strict=True))} from g")
    fits.append(f"select tile, row, col, b1, b2, b3, {', '.join(f'0.0 as {n}' for n in names)} from g")
    error = " + ".join(f"pow({' + '.join(f'{n} * {MEMBERS[n][j]!r}' for n in names)} - b{j + 1}, 2)" for j in range(m.shape[1]))
    total = " + ".join(names)
    return f"""{sql("grid")}, g as (select tile, row, col, value / 2000 as b1, size / 50 as b2, class / 5 as b3 from grid), f as ({" union all ".join(fits)}), r as (select *, sqrt(({error}) / {m.shape[1]}) as rmse from f where {" and ".join(f"{n} >= 0" for n in names)}),
 z as (select *, row_number() over (partition by tile, row, col order by rmse) as k from r) select tile, row, col, b1, b2, b3, {", ".join(f"round({n} / ({total}), 4) as {n}" for n in names)}, round(rmse, 4) as rmse from z where k = 1"""


@query("mixture", _mixture_sql())
def mixture(spark, d):
    g = T.grid(spark, d).select("tile", "row", "col", (F.col("value") / 2000).alias("b1"), (F.col("size") / 50).alias("b2"), (F.col("class") / 5).alias("b3"))
    return r6(learn.mixture(g, ["b1", "b2", "b3"], MEMBERS), *MEMBERS, "rmse", digits=4)


@query("top_values", sql("grid") + windowed("s.value", 3) + ", k as (select tile, row, col, median(value) as value from n group by 1, 2, 3), m as (select *, row_number() over (partition by tile, row // 5, col // 5 order by value desc, row, col) as r from k), z as (select *, row_number() over (partition by tile order by value desc, row, col) as rank from m where r = 1) select tile, row, col, round(value, 4) as value, cast(rank as int) as rank from z where rank <= 4")
def top_values(spark, d):
    return r6(sampling.top_values(T.grid(spark, d), "value", 4), "value", digits=4)


@query("change_map", sql("grid").replace("with ", "with recursive ", 1) + ", p as (select tile, row, col, k as idx, cast(case when k > 2 + size % 5 then 0.9 else 0.2 end as double) as p from grid, range(1, 7) r(k)), " + change_sql("p", "tile, row, col"))
def change_map(spark, d):
    """Each pixel's probability over six dates, by its value; the date at which a change is confirmed."""
    from ..operators import change

    g = T.grid(spark, d).select("tile", "row", "col", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("index"), "size")
    p = g.withColumn("p", F.when(F.col("index") > 2 + F.col("size") % 5, 0.9).otherwise(0.2))
    return change.detect_changes(p, "p", ["tile", "row", "col"])


@query("change_runs", sql("grid") + ", c as (select *, lag(col) over (partition by tile, class, row order by col) as p from grid), r as (select *, sum(case when p is null or col - p > 1 then 1 else 0 end) over (partition by tile, class, row order by col) as k from c) select tile, class as change, row, min(col) as col_from, max(col) as col_to, count(*) as cells from r group by tile, class, row, k")
def change_runs(spark, d):
    from ..operators import change

    return change.change_polygons(T.grid(spark, d).withColumnRenamed("class", "change").select("tile", "row", "col", "change"))
