"""Queries over catalogs and observations: filters, regular composites, merging, mosaics, points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cube as C
from ..sources import catalog
from . import tables as T
from .registry import query
from .samples import r6
from .tables import sql


@query("catalog_select", sql("assets") + " select * from assets where band in ('1', '2') and date between date '1996-01-01' and date '1996-12-31' and tile in ('N1', 'N2', 'N7')")
def catalog_select(spark, d):
    return C.select(T.assets(spark, d), bands=["1", "2"], start="1996-01-01", end="1996-12-31", tiles=["N1", "N2", "N7"])


@query("catalog_dates", sql("assets") + " select tile, band, date from assets where date in (date '1996-03-01', date '1997-05-01')")
def catalog_dates(spark, d):
    return C.select(T.assets(spark, d), dates=["1996-03-01", "1997-05-01"]).select("tile", "band", "date")


@query("catalog_spatial", sql("tiles") + " select * from tiles where xmin <= 25 and xmax >= 12 and ymin <= 22 and ymax >= 5")
def catalog_spatial(spark, d):
    return C.filter_spatial(T.tiles(spark, d), (12, 5, 25, 22))


@query("catalog_collections", sql("assets") + " select tile as source, band as collection, array_to_string(list_sort(list(distinct cast(year(date) as varchar))), ',') as bands from assets group by 1, 2")
def catalog_collections(spark, d):
    x = catalog.list_collections(T.assets(spark, d).select(F.col("tile").alias("source"), F.col("band").alias("collection"), F.year("date").cast("string").alias("band")))
    return x.withColumn("bands", F.array_join("bands", ","))


@query("roi_to_tiles", sql("tiles") + " select tile as tile_id, round(100 * (least(xmax, 25) - greatest(xmin, 12)) * (least(ymax, 22) - greatest(ymin, 5)) / ((xmax - xmin) * (ymax - ymin)), 2) as coverage_percentage from tiles where xmin <= 25 and xmax >= 12 and ymin <= 22 and ymax >= 5")
def roi_to_tiles(spark, d):
    return C.roi_to_tiles(T.tiles(spark, d), (12, 5, 25, 22))


@query("tiles_to_roi", sql("tiles") + " select min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from tiles where tile in ('N3', 'N11')")
def tiles_to_roi(spark, d):
    return C.tiles_to_roi(T.tiles(spark, d), ["N3", "N11"])


@query("box_relations", sql("tiles") + " select a.tile, b.tile as other, a.xmin >= b.xmin and a.xmax <= b.xmax and a.ymin >= b.ymin and a.ymax <= b.ymax as within, greatest(a.xmin, b.xmin) as xmin, least(a.ymax, b.ymax) as ymax, (a.xmax - a.xmin) * (a.ymax - a.ymin) - greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0) as rest from tiles a join tiles b on a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax")
def box_relations(spark, d):
    a = T.tiles(spark, d)
    b = a.select(F.col("tile").alias("other"), *(F.col(c).alias(f"r_{c}") for c in C.BOX))
    x0, _, _, y1 = C.box_intersection()
    return a.join(F.broadcast(b), C.box_intersects()).select("tile", "other", C.box_within().alias("within"), x0, y1, C.box_difference_area().alias("rest"))


@query("retile", sql("tiles") + ", g as (select 'G' || cast(k as varchar) as to_tile, k * 25.0 as x0, k * 25.0 + 25 as x1 from range(0, 2) r(k)) select tile, to_tile from tiles join g on xmin < x1 and x0 < xmax")
def retile(spark, d):
    g = spark.range(2).select(F.concat(F.lit("G"), F.col("id").cast("string")).alias("tile"), (F.col("id") * 25).cast("double").alias("xmin"), F.lit(-10.0).alias("ymin"), (F.col("id") * 25 + 25).cast("double").alias("xmax"), F.lit(100.0).alias("ymax"))
    return C.retile(T.tiles(spark, d), g)


@query("least_cloudy", sql("assets") + ", r as (select *, row_number() over (partition by tile order by cloud_cover, date) as r from assets) select tile, date, cloud_cover from r where r = 1")
def least_cloudy(spark, d):
    return C.least_cloudy(T.assets(spark, d))


@query("acquisitions", sql("assets") + ", x as (select distinct tile, date from assets) select tile, make_date(1995 + (year(date) - 1995), ((month(date) - 1) // 3) * 3 + 1, 1) as period, count(*) as images from x group by 1, 2")
def acquisitions(spark, d):
    return C.acquisitions(T.assets(spark, d), "P3M", "1990-01-01")


REG = sql("obs") + ", p as (select *, date '2024-01-01' + cast(floor((date - date '2024-01-01') / 5) * 5 as int) as period from obs where value is not null)"


@query("regularize_first", REG + ", r as (select *, row_number() over (partition by sample_id, band, period order by cloud_cover, date, value) as r from p) select sample_id, band, period, value from r where r = 1")
def regularize_first(spark, d):
    return C.regularize(T.observations(spark, d), "P5D", "2024-01-01", ["sample_id", "band"])


@query("regularize_last", REG + ", r as (select *, row_number() over (partition by sample_id, band, period order by date desc, value desc) as r from p) select sample_id, band, period, value from r where r = 1")
def regularize_last(spark, d):
    return C.regularize_last(T.observations(spark, d), "P5D", "2024-01-01", ["sample_id", "band"])


@query("regularize_calendar", REG + ", r as (select *, row_number() over (partition by sample_id, band, period order by cloud_cover, date, value) as r from p), k as (select distinct sample_id, band from r), c as (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 5 day)) as date) as period) select k.sample_id, k.band, c.period, r.value from k cross join c left join r on r.sample_id = k.sample_id and r.band = k.band and r.period = c.period and r.r = 1")
def regularize_calendar(spark, d):
    x = C.regularize(T.observations(spark, d), "P5D", "2024-01-01", ["sample_id", "band"])
    return C.with_calendar(x, "P5D", "2024-01-01", "2024-01-30", ["sample_id", "band"])


@query("regularize_combined", REG + ", a as (select *, row_number() over (partition by sample_id, period order by cloud_cover, date, value) as r from p where band = 'click'), b as (select *, row_number() over (partition by sample_id, period order by cloud_cover, date, value) as r from p where band <> 'click') select coalesce(x.sample_id, y.sample_id) as sample_id, coalesce(x.period, y.period) as period, coalesce(x.value, y.value) as value from (select * from a where r = 1) x full join (select * from b where r = 1) y on x.sample_id = y.sample_id and x.period = y.period")
def regularize_combined(spark, d):
    x = T.observations(spark, d)
    return C.regularize_combined([x.where("band = 'click'"), x.where("band <> 'click'")], "P5D", "2024-01-01", ["sample_id"])


def _two(spark, d):
    a = T.assets(spark, d)
    return a.where("fid % 3 <> 0"), a.where("fid % 2 = 0")


TWO = sql("assets") + ", a as (select * from assets where fid % 3 <> 0), b as (select * from assets where fid % 2 = 0)"


@query("merge_files", TWO + ", u as (select * from a union all select * from b), k as (select tile from a intersect select tile from b), r as (select *, row_number() over (partition by tile, band, date order by fid) as r from u where tile in (select tile from k)) select tile, band, date, fid, cloud_cover from r where r = 1")
def merge_files(spark, d):
    return C.merge_densify(*_two(spark, d))


@query("merge_bind", TWO + " select * from a union all select * from b")
def merge_bind(spark, d):
    return C.merge_bind(*_two(spark, d))


@query("merge_common_tiles", TWO + " select tile from a intersect select tile from b")
def merge_common_tiles(spark, d):
    a, b = _two(spark, d)
    return a.select("tile").intersect(b.select("tile"))


ZIP = TWO + ", s as (select tile, date as a, lead(date) over (partition by tile order by date) as b from (select distinct tile, date from a)), h as (select s.tile, a, b, list_sort(list(distinct x.date)) as ds from s join b x on x.tile = s.tile and x.date between a and b where b is not null group by 1, 2, 3), z as (select distinct tile, unnest(case when list_contains(ds, a) and list_contains(ds, b) then ds else [a, ds[1], b] end) as date from h)"


@query("merge_zipper", ZIP + " select * from z")
def merge_zipper(spark, d):
    return C.zipper(*_two(spark, d))


@query("merge_compactify", ZIP + " select u.* from (select * from a union all select * from b) u join z on z.tile = u.tile and z.date = u.date")
def merge_compactify(spark, d):
    return C.merge_compactify(*_two(spark, d)).select("tile", "band", "date", "fid", "cloud_cover")


@query("merge_overlap", TWO + ", x as (select distinct tile, date from a), y as (select distinct tile, date from b), j as (select x.tile, x.date as date1, y.date as date2, abs(x.date - y.date) as gap from x join y on x.tile = y.tile and x.date <= y.date + 39 and y.date <= x.date + 39), r as (select *, row_number() over (partition by tile, date1 order by gap, date2) as a, row_number() over (partition by tile, date2 order by gap, date1) as b from j) select tile, date1, date2 from r where a = 1 and b = 1")
def merge_overlap(spark, d):
    a, b = _two(spark, d)
    return C.merge_overlap(a, b, 40, 40)


@query("merge_static", TWO + ", t as (select distinct tile, date from a), s as (select tile, 'DEM' as band, min(fid) as fid, 0 as cloud_cover from assets group by 1) select tile, band, date, fid, cloud_cover from a union all select s.tile, band, t.date, fid, cloud_cover from s join t on s.tile = t.tile")
def merge_static(spark, d):
    a, _ = _two(spark, d)
    s = T.assets(spark, d).groupBy("tile").agg(F.min("fid").alias("fid")).withColumns({"band": F.lit("DEM"), "cloud_cover": F.lit(0), "date": F.lit(None).cast("date")})
    return C.merge_static(a, s)


def pixels(spark, d):
    return T.grid(spark, d).select("tile", F.lit("B1").alias("band"), F.lit("2020-01-01").cast("date").alias("date"), "row", "col", "value")


@query("regularize_grid", sql("grid") + """, k as (select cast(max(p_partkey) // 400 * 20 + 20 as double) as x from part), g as (select 'G' || cast(k as varchar) as tile, k * 30.0 as x0 from range(0, 400) r(k), k as e where k * 30.0 < e.x),
 c as (select g.tile, r.r as row, q.q as col, x0 + (q.q + 0.5) * 2 as x, 20 - (r.r + 0.5) * 2 as y from g, range(0, 10) r(r), range(0, 15) q(q))
 select c.tile, 'B1' as band, cast(c.row as int) as row, cast(c.col as int) as col, date '2020-01-01' as period, value from c join grid s on s.tile = 'T' || cast(cast(floor(x / 20) as int) as varchar) and s.col = floor(x - floor(x / 20) * 20) and s.row = floor(20 - y)""")
def regularize_grid(spark, d):
    """Pixels of tiles 20 wide on tiles 30 wide, of cells twice as large."""
    t = T.grid_tiles(spark, d)
    most = t.agg(F.max("xmax")).first()[0] or 0
    g = spark.range(int(-(-most // 30))).select(F.concat(F.lit("G"), F.col("id").cast("string")).alias("tile"), (F.col("id") * 30.0).alias("xmin"), F.lit(0.0).alias("ymin"), (F.col("id") * 30.0 + 30).alias("xmax"), F.lit(20.0).alias("ymax"), F.lit(2.0).alias("xres"), F.lit(2.0).alias("yres"))
    return C.regularize_to_grid(pixels(spark, d), t, g, "P1M", "2020-01-01")


@query("mosaic", sql("grid", "grid_tiles") + " select 'MOSAIC' as tile, 'B1' as band, date '2020-01-01' as date, row, cast(col + xmin as int) as col, value from grid join grid_tiles using (tile)")
def mosaic(spark, d):
    return C.mosaic(pixels(spark, d), T.grid_tiles(spark, d)).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})


@query("crop", sql("grid", "grid_tiles") + " select tile, row, col, value from grid join grid_tiles using (tile) where xmin + col + 0.5 between 10 and 33 and 20 - row - 0.5 between 4 and 15")
def crop(spark, d):
    return C.crop(pixels(spark, d), T.grid_tiles(spark, d), (10, 4, 33, 15)).select("tile", "row", "col", "value")


@query("add_base", sql("grid") + " select tile, row, col, value, size, cast(class as double) as elevation from grid")
def add_base(spark, d):
    g = T.grid(spark, d)
    return C.add_base(g.select("tile", "row", "col", "value", "size"), g.select("tile", "row", "col", F.col("class").cast("double").alias("elevation")))


@query("chunks", "with t as (select 'A' as tile, 100 as nrows, 70 as ncols), g as (select tile, nrows, ncols, cast(r as int) as r, cast(c as int) as c from t, range(0, 100, 32) a(r), range(0, 70, 32) b(c)) select tile, r as own_row, c as own_col, least(r + 32, nrows) - r as own_nrows, least(c + 32, ncols) - c as own_ncols, greatest(r - 4, 0) as row, greatest(c - 4, 0) as col, least(least(r + 32, nrows) + 4, nrows) - greatest(r - 4, 0) as nrows, least(least(c + 32, ncols) + 4, ncols) - greatest(c - 4, 0) as ncols from g")
def chunks(spark, d):
    return C.chunks(spark.createDataFrame([("A", 100, 70)], "tile string, nrows int, ncols int"), 32, 4)


LOC = sql("grid", "grid_tiles", "points") + ", l as (select p.*, t.tile, cast(floor(t.ymax - latitude) as int) as row, cast(floor(longitude - t.xmin) as int) as col from points p join grid_tiles t on longitude > xmin and longitude < xmax and latitude > ymin and latitude < ymax)"


@query("get_data", LOC + " select l.sample_id, l.label, date '1996-06-01' as date, g.value from l join grid g using (tile, row, col)")
def get_data(spark, d):
    p = pixels(spark, d).withColumn("date", F.lit("1996-06-01").cast("date"))
    return C.get_data(T.points(spark, d), T.grid_tiles(spark, d), p, ["sample_id"]).select("sample_id", "label", "date", "value")


@query("get_class", LOC + " select l.sample_id, g.class from l join grid g using (tile, row, col)")
def get_class(spark, d):
    return C.get_values(T.points(spark, d), T.grid_tiles(spark, d), T.grid(spark, d).select("tile", "row", "col", "class")).select("sample_id", "class")


@query("get_probs", sql("grid", "probs", "grid_tiles", "points") + LOC.split("from customer)", 1)[1] + " select l.sample_id, round(a, 8) as a, round(b, 8) as b, round(c, 8) as c from l join probs using (tile, row, col)")
def get_probs(spark, d):
    return r6(C.get_values(T.points(spark, d), T.grid_tiles(spark, d), T.probs(spark, d)).select("sample_id", "a", "b", "c"), "a", "b", "c", digits=8)


@query("mask_scale", "select p_partkey, case when p_size = 7 or p_size < 3 or p_size > 45 then null else cast(p_size * 0.5 + 10 as double) end as value, cast(least(greatest(p_size, 3), 45) * 0.5 as double) as clamped, (p_size & 6) > 0 as cloud, p_size in (3, 9) as listed from part")
def mask_scale(spark, d):
    s = F.col("p_size")
    return T.read(spark, d, "part").select("p_partkey", scalars.masked(s, 7, 3, 45, 0.5, 10.0).alias("value"), scalars.clamped(s, 3, 45, 0.5).alias("clamped"), scalars.cloudy(s, bits=[1, 2]).alias("cloud"), scalars.cloudy(s, values=[3, 9]).alias("listed"))


@query("parse_names", "select 'N' || cast(n_nationkey as varchar) as tile, 'B0' || cast(n_regionkey as varchar) as band, make_date(2020, n_regionkey + 1, 15) as date from nation")
def parse_names(spark, d):
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey")
    path = F.concat(F.lit("s3://x/SAT_N"), k, F.lit("_b0"), r.cast("string"), F.lit("_2020-0"), (r + 1).cast("string"), F.lit("-15.tif"))
    return catalog.parse_names(T.read(spark, d, "nation").select(F.regexp_replace(path, "SAT_N", "SAT_X_N").alias("path")), ["X1", "X2", "tile", "band", "date"]).drop("path")


@query("resample", sql("grid") + " select tile, row // 4 as row, col // 4 as col, round(avg(value), 6) as value from grid group by 1, 2, 3")
def resample(spark, d):
    return r6(C.resample(pixels(spark, d), 4).select("tile", "row", "col", "value"), "value")


@query("resample_mode", sql("grid") + ", n as (select tile, row // 4 as row, col // 4 as col, class, count(*) as n from grid group by all), r as (select *, row_number() over (partition by tile, row, col order by n desc, class) as k from n) select tile, row, col, cast(class as double) as value from r where k = 1")
def resample_mode(spark, d):
    g = T.grid(spark, d).select("tile", F.lit("B").alias("band"), F.lit(None).cast("date").alias("date"), "row", "col", F.col("class").cast("double").alias("value"))
    return C.resample(g, 4, "mode").select("tile", "row", "col", "value")


@query("deseasoned", sql("grid") + ", q as (select tile, quantile_cont(value, 0.95) as q from grid group by 1) select tile, row, col, round(value - q, 6) as value from grid join q using (tile)")
def deseasoned(spark, d):
    return r6(C.deseasoned(pixels(spark, d), "value").select("tile", "row", "col", "value"), "value")


@query("validate_map", sql("grid", "grid_tiles", "points") + ", l as (select 'c' || cast(p.sample_id % 5 + 1 as varchar) as reference, t.tile, cast(floor(t.ymax - latitude) as int) as row, cast(floor(longitude - t.xmin) as int) as col from points p join grid_tiles t on longitude between xmin and xmax and latitude between ymin and ymax) select 'c' || cast(g.class as varchar) as predicted, l.reference, count(*) as n from l join grid g using (tile, row, col) group by 1, 2")
def validate_map(spark, d):
    p = T.points(spark, d).withColumn("label", F.concat(F.lit("c"), (F.col("sample_id") % 5 + 1).cast("string")))
    c = T.grid(spark, d).withColumn("label", F.concat(F.lit("c"), F.col("class").cast("string")))
    return C.validate(p, T.grid_tiles(spark, d), c).groupBy("predicted", "reference").agg(F.count("*").alias("n"))


@query("mercator", sql("points") + " select sample_id, round(radians(longitude) * 6378137, 3) as x, round(ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137, 3) as y from points")
def mercator(spark, d):
    from ..functions import geo

    x, y = geo.to_mercator(F.col("longitude"), F.col("latitude"))
    return r6(T.points(spark, d).select("sample_id", x.alias("x"), y.alias("y")), "x", "y", digits=3)


@query("polygon_boxes", sql("tiles") + " select tile, xmin, ymin, xmax, ymax from tiles")
def polygon_boxes(spark, d):
    from ..sources import sinks, vector

    return vector.boxes(sinks.as_boxes(T.tiles(spark, d)).select("tile", "geometry")).drop("geometry")


def _place(axis: int, low: str, high: str, step: float) -> str:
    u = f"(cast((polygon_id * 2 + {axis + 1}) * 2654435761 % 2147483647 as double) / 2147483647 + k * cast({step!r} as double))"
    return f"round({low} + ({u} - floor({u})) * ({high} - {low}), 6)"


@query("polygon_points", sql("tiles") + f", p as (select *, cast(substring(tile, 2) as bigint) as polygon_id from tiles) select polygon_id, tile, {_place(0, 'xmin', 'xmax', 0.7548776662466927)} as longitude, {_place(1, 'ymin', 'ymax', 0.5698402909980532)} as latitude from p, range(1, 11) r(k)")
def polygon_points(spark, d):
    from ..sources import sinks, vector

    t = sinks.as_boxes(T.tiles(spark, d)).select(F.substring("tile", 2, 9).cast("long").alias("polygon_id"), "tile", "geometry")
    return r6(vector.sample_points(t, 10), "longitude", "latitude")


@query("points_within", sql("tiles", "points") + " select p.sample_id, t.tile from points p join tiles t on longitude > xmin and longitude < xmax and latitude > ymin and latitude < ymax and longitude <> floor(longitude) and latitude <> floor(latitude)")
def points_within(spark, d):
    from ..sources import sinks, vector

    p = T.points(spark, d).select("sample_id", "longitude", "latitude").where("longitude <> floor(longitude) and latitude <> floor(latitude)")
    return vector.points_within(p, sinks.as_boxes(T.tiles(spark, d)).select("tile", "geometry")).select("sample_id", "tile")
