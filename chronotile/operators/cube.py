"""Cubes: a catalog of tiles and assets, and pixels in long form (tile, band, date, row, col, value).

Catalog verbs work on the asset table: one row for each tile, band and date, with the tile's box and the asset's fid,
cloud_cover and path. Pixel verbs work on pixels; tiles, bands and dates are columns, so filters prune partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates as D
from .quantiles import quantiles

BOX = ("xmin", "ymin", "xmax", "ymax")


def select(assets: DataFrame, bands=None, dates=None, start=None, end=None, tiles=None) -> DataFrame:
    """Bands, then dates, interval (if both ends are given) and tiles."""
    if bands is not None:
        assets = assets.where(F.col("band").isin(*bands))
    if dates is not None:
        assets = assets.where(F.col("date").isin(*[F.lit(d).cast("date") for d in dates]))
    if start is not None and end is not None:
        assets = assets.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if tiles is not None:
        assets = assets.where(F.col("tile").isin(*tiles))
    return assets


def box_intersects(a: str = "", b: str = "r_") -> Column:
    return (F.col(f"{a}xmin") <= F.col(f"{b}xmax")) & (F.col(f"{b}xmin") <= F.col(f"{a}xmax")) & (F.col(f"{a}ymin") <= F.col(f"{b}ymax")) & (F.col(f"{b}ymin") <= F.col(f"{a}ymax"))


def box_within(a: str = "", b: str = "r_") -> Column:
    return (F.col(f"{a}xmin") >= F.col(f"{b}xmin")) & (F.col(f"{a}xmax") <= F.col(f"{b}xmax")) & (F.col(f"{a}ymin") >= F.col(f"{b}ymin")) & (F.col(f"{a}ymax") <= F.col(f"{b}ymax"))


def box_contains(a: str = "", b: str = "r_") -> Column:
    return box_within(b, a)


def box_intersection(a: str = "", b: str = "r_") -> list[Column]:
    return [F.greatest(f"{a}xmin", f"{b}xmin").alias("xmin"), F.greatest(f"{a}ymin", f"{b}ymin").alias("ymin"), F.least(f"{a}xmax", f"{b}xmax").alias("xmax"), F.least(f"{a}ymax", f"{b}ymax").alias("ymax")]


def box_difference_area(a: str = "", b: str = "r_") -> Column:
    """Area of the first box that the second leaves."""
    x0, y0, x1, y1 = box_intersection(a, b)
    inner = F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))
    return (F.col(f"{a}xmax") - F.col(f"{a}xmin")) * (F.col(f"{a}ymax") - F.col(f"{a}ymin")) - inner


def filter_spatial(tiles: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """Tiles whose box meets the region's."""
    x0, y0, x1, y1 = map(float, roi)
    return tiles.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def roi_to_tiles(tiles: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """tile_id and the share, in percent, of each tile that the region covers."""
    x0, y0, x1, y1 = map(float, roi)
    w = F.least("xmax", F.lit(x1)) - F.greatest("xmin", F.lit(x0))
    h = F.least("ymax", F.lit(y1)) - F.greatest("ymin", F.lit(y0))
    d = filter_spatial(tiles, roi)
    return d.select(F.col("tile").alias("tile_id"), F.round(100 * w * h / ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), 2).alias("coverage_percentage"))


def tiles_to_roi(tiles: DataFrame, ids: list[str]) -> DataFrame:
    return bbox(tiles.where(F.col("tile").isin(*ids)))


def bbox(df: DataFrame) -> DataFrame:
    if "xmin" in df.columns:
        return df.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    return df.agg(F.min("longitude").alias("xmin"), F.min("latitude").alias("ymin"), F.max("longitude").alias("xmax"), F.max("latitude").alias("ymax"))


def crop(pixels: DataFrame, tiles: DataFrame, roi: tuple[float, float, float, float]) -> DataFrame:
    """Pixels whose centres lie in the region."""
    x0, y0, x1, y1 = map(float, roi)
    d = pixels.join(filter_spatial(tiles, roi).select("tile", *BOX, "xres", "yres"), "tile")
    x, y = F.col("xmin") + (F.col("col") + 0.5) * F.col("xres"), F.col("ymax") - (F.col("row") + 0.5) * F.col("yres")
    return d.where(x.between(x0, x1) & y.between(y0, y1)).select(*pixels.columns)


def acquisitions(assets: DataFrame, period: str, origin) -> DataFrame:
    """Images of each tile in each period from the origin on."""
    n, unit = D.parse_period(period)
    start = F.lit(origin).cast("date")
    if unit == "day":
        k = F.floor(F.datediff("date", start) / n)
    else:
        k = F.floor(F.floor(F.months_between("date", start)) / (n * (12 if unit == "year" else 1)))
    d = assets.select("tile", "date").distinct().withColumn("period", D.step(start, period, k))
    return d.groupBy("tile", "period").agg(F.count("*").alias("images"))


def least_cloudy(assets: DataFrame) -> DataFrame:
    """Each tile's date of least cloud cover, of several the first."""
    return assets.groupBy("tile").agg(F.min(F.struct("cloud_cover", "date")).alias("_m")).select("tile", F.col("_m.date").alias("date"), F.col("_m.cloud_cover").alias("cloud_cover"))


def period_of(date: Column, period: str, origin) -> Column:
    """Start of the left-closed period that holds a date; null before the origin."""
    n, unit = D.parse_period(period)
    start = F.lit(origin).cast("date")
    days = F.datediff(date, start)
    if unit == "day":
        k = F.floor(days / n)
    else:
        months = n * (12 if unit == "year" else 1)
        k = F.floor(F.floor(F.months_between(date, start)) / months)
    return F.when(days >= 0, D.step(start, period, k))


def regularize(obs: DataFrame, period: str, origin, keys: list[str], value: str = "value", order: str = "cloud_cover", date: str = "date") -> DataFrame:
    """One value for each key and period: the first by cloud cover and date of those that aren't missing."""
    d = obs.where(F.col(value).isNotNull()).withColumn("period", period_of(F.col(date), period, origin)).where("period is not null")
    best = F.min(F.struct(F.col(order).alias("_o"), F.col(date).alias("_d"), F.col(value).alias("_v")))
    return d.groupBy(*keys, "period").agg(best.alias("_m")).select(*keys, "period", F.col("_m._v").alias(value))


def regularize_last(obs: DataFrame, period: str, origin, keys: list[str], value: str = "value", date: str = "date") -> DataFrame:
    """As for radar: the last image of a period wins."""
    d = obs.where(F.col(value).isNotNull()).withColumn("period", period_of(F.col(date), period, origin)).where("period is not null")
    best = F.max(F.struct(F.col(date).alias("_d"), F.col(value).alias("_v")))
    return d.groupBy(*keys, "period").agg(best.alias("_m")).select(*keys, "period", F.col("_m._v").alias(value))


def with_calendar(regular: DataFrame, period: str, origin, end, keys: list[str]) -> DataFrame:
    """All periods for each key; those without an image have a null value."""
    spark = regular.sparkSession
    n, unit = D.parse_period(period)
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(origin).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {n} {unit}"))).alias("period"))
    grid = regular.select(*keys).distinct().crossJoin(F.broadcast(calendar))  # one timeline
    return grid.join(regular, [*keys, "period"], "left")


def regularize_combined(parts: list[DataFrame], period: str, origin, keys: list[str]) -> DataFrame:
    """Each source regularized, then merged; the first source with a value wins."""
    made = None
    for k, p in enumerate(parts):
        r = regularize(p, period, origin, keys).withColumn("_k", F.lit(k))
        made = r if made is None else made.unionByName(r)
    return made.groupBy(*keys, "period").agg(F.min(F.struct("_k", "value")).alias("_m")).select(*keys, "period", F.col("_m.value").alias("value"))


def merge_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Assets of the tiles that both have, one for each tile, band and date: that of the least fid."""
    common = a.select("tile").intersect(b.select("tile"))
    both = a.unionByName(b, allowMissingColumns=True).join(common, "tile", "left_semi")
    w = Window.partitionBy("tile", "band", "date").orderBy("fid")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_bind(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def merge_densify(a: DataFrame, b: DataFrame) -> DataFrame:
    """All dates of both on the tiles in common; without such tiles both cubes as they are."""
    if a.select("tile").intersect(b.select("tile")).isEmpty():
        return merge_bind(a, b)
    return merge_files(a, b)


def zipper(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Dates kept by the zipper over two timelines (columns tile, date).

    For each interval between neighbouring dates of the first that holds dates of the second: if both its ends are
    dates of the second all those are kept, else its ends and the least of them.
    """
    w = Window.partitionBy("tile").orderBy("date")
    spans = t1.select("tile", "date").distinct().select("tile", F.col("date").alias("a"), F.lead("date").over(w).alias("b")).where("b is not null")
    s = t2.select(F.col("tile").alias("_t"), F.col("date").alias("d")).distinct()
    held = spans.join(s, (F.col("tile") == F.col("_t")) & F.col("d").between(F.col("a"), F.col("b")))
    per = held.groupBy("tile", "a", "b").agg(F.array_sort(F.collect_set("d")).alias("ds"))
    both = F.array_contains("ds", F.col("a")) & F.array_contains("ds", F.col("b"))
    kept = F.when(both, F.col("ds")).otherwise(F.array(F.col("a"), F.col("ds")[0], F.col("b")))
    return per.select("tile", F.explode(kept).alias("date")).distinct()


def merge_compactify(a: DataFrame, b: DataFrame) -> DataFrame:
    """Assets of both on the dates that the zipper keeps."""
    dates = zipper(a.select("tile", "date"), b.select("tile", "date"))
    return a.unionByName(b, allowMissingColumns=True).join(dates, ["tile", "date"], "left_semi")


def merge_overlap(t1: DataFrame, t2: DataFrame, days1: int, days2: int) -> DataFrame:
    """Pairs (tile, date1, date2) of dates whose periods overlap; each date takes the nearest partner on either side once."""
    a = t1.select("tile", F.col("date").alias("date1"), F.date_add("date", days1 - 1).alias("e1")).distinct()
    b = t2.select(F.col("tile").alias("_t"), F.col("date").alias("date2"), F.date_add("date", days2 - 1).alias("e2")).distinct()
    j = a.join(b, (F.col("tile") == F.col("_t")) & (F.col("date1") <= F.col("e2")) & (F.col("date2") <= F.col("e1")))
    gap = F.abs(F.datediff("date1", "date2"))
    w1 = Window.partitionBy("tile", "date1").orderBy(gap, "date2")
    w2 = Window.partitionBy("tile", "date2").orderBy(gap, "date1")
    return j.withColumns({"_a": F.row_number().over(w1), "_b": F.row_number().over(w2)}).where("_a = 1 and _b = 1").select("tile", "date1", "date2")


def merge_static(cube: DataFrame, static: DataFrame) -> DataFrame:
    """A cube's assets and those of a static cube repeated on each of its dates."""
    dates = cube.select("tile", "date").distinct()
    return cube.unionByName(static.drop("date").join(dates, "tile"), allowMissingColumns=True)


def add_base(pixels: DataFrame, base: DataFrame) -> DataFrame:
    """Static bands beside every date's pixel, joined on tile, row and col."""
    return pixels.join(base, ["tile", "row", "col"])


def mosaic(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """All tiles on one grid from their joint corner; where they overlap, the last tile's pixel."""
    corner = tiles.agg(F.min("xmin").alias("_x0"), F.max("ymax").alias("_y1"))
    shift = tiles.crossJoin(F.broadcast(corner)).select(  # one row
        "tile",
        F.round((F.col("xmin") - F.col("_x0")) / F.col("xres")).cast("int").alias("_dc"),
        F.round((F.col("_y1") - F.col("ymax")) / F.col("yres")).cast("int").alias("_dr"),
    )
    d = pixels.join(shift, "tile").withColumns({"row": F.col("row") + F.col("_dr"), "col": F.col("col") + F.col("_dc")})
    return d.groupBy("band", "date", "row", "col").agg(F.max(F.struct("tile", "value")).alias("_m")).select(F.lit("MOSAIC").alias("tile"), "band", "date", "row", "col", F.col("_m.value").alias("value"))


def retile(tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Pairs of a cube's tiles and those of another grid (tile, xmin ..) whose boxes meet with some area.

    Boxes meet on a plan of cells as large as the largest of them, so each is in four at most; a pair counts in the cell
    that holds its common corner.
    """
    both = tiles.select(*BOX).unionByName(grid.select(*BOX))
    w, h = both.agg(F.max(F.col("xmax") - F.col("xmin")), F.max(F.col("ymax") - F.col("ymin"))).first()
    w, h = float(w or 1), float(h or 1)

    def dealt(t: DataFrame, at: str) -> DataFrame:
        span = lambda a, b, s: F.sequence(F.floor(F.col(a) / s), F.floor(F.col(b) / s))
        d = t.select(F.col("tile").alias(f"{at}tile"), *(F.col(b).alias(f"{at}{b}") for b in BOX), F.explode(span("xmin", "xmax", w)).alias("_cx"), span("ymin", "ymax", h).alias("_s"))
        return d.withColumn("_cy", F.explode("_s")).drop("_s")

    j = dealt(tiles, "").join(dealt(grid, "r_"), ["_cx", "_cy"]).where((F.col("xmin") < F.col("r_xmax")) & (F.col("r_xmin") < F.col("xmax")) & (F.col("ymin") < F.col("r_ymax")) & (F.col("r_ymin") < F.col("ymax")))
    once = (F.floor(F.greatest("xmin", "r_xmin") / w) == F.col("_cx")) & (F.floor(F.greatest("ymin", "r_ymin") / h) == F.col("_cy"))
    return j.where(once).select("tile", F.col("r_tile").alias("to_tile"))


def retile_pixels(pixels: DataFrame, tiles: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels on another grid's tiles (tile, xmin .., xres, yres): each target cell takes the nearest source cell.

    A target cell's centre decides which source cell that is. Where source tiles overlap, that of the least name is taken;
    target cells without a source aren't there.
    """
    box = lambda t, at: t.select(*(F.col(c).alias(f"{at}{c}") for c in ("tile", *BOX, "xres", "yres")))
    pairs = retile(tiles, grid).join(box(tiles, "s_"), F.col("tile") == F.col("s_tile")).join(box(grid, "t_"), F.col("to_tile") == F.col("t_tile"))
    d = pixels.join(pairs.drop("tile"), pixels["tile"] == F.col("s_tile"))
    # A source cell's edges say which target cells have their centres in it.
    left, top = F.col("s_xmin") + F.col("col") * F.col("s_xres"), F.col("s_ymax") - F.col("row") * F.col("s_yres")
    c0, c1 = F.ceil((left - F.col("t_xmin")) / F.col("t_xres") - 0.5), F.ceil((left + F.col("s_xres") - F.col("t_xmin")) / F.col("t_xres") - 0.5) - 1
    r0, r1 = F.ceil((F.col("t_ymax") - top) / F.col("t_yres") - 0.5), F.ceil((F.col("t_ymax") - top + F.col("s_yres")) / F.col("t_yres") - 0.5) - 1
    ncol, nrow = F.round((F.col("t_xmax") - F.col("t_xmin")) / F.col("t_xres")), F.round((F.col("t_ymax") - F.col("t_ymin")) / F.col("t_yres"))
    c0, c1, r0, r1 = F.greatest(c0, F.lit(0)), F.least(c1, ncol - 1).cast("long"), F.greatest(r0, F.lit(0)), F.least(r1, nrow - 1).cast("long")
    span = lambda a, b: F.when(a <= b, F.sequence(a.cast("long"), b)).otherwise(F.array().cast("array<bigint>"))
    d = d.select(F.col("t_tile").alias("to"), "band", "date", F.col("s_tile").alias("from"), "value", span(r0, r1).alias("rs"), span(c0, c1).alias("cs"))
    d = d.withColumn("row", F.explode("rs")).withColumn("col", F.explode("cs")).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})
    best = d.groupBy("to", "band", "date", "row", "col").agg(F.min(F.struct("from", "value")).alias("_m"))
    return best.select(F.col("to").alias("tile"), "band", "date", "row", "col", F.col("_m.value").alias("value"))


def regularize_to_grid(pixels: DataFrame, tiles: DataFrame, grid: DataFrame, period: str | None = None, origin=None) -> DataFrame:
    """Regular pixels on another grid's tiles: radar, rainfall and other gridded series by period, the last image of each;
    without a period, as for elevation, the pixels as they are, on the grid alone."""
    moved = retile_pixels(pixels, tiles, grid)
    return moved if period is None else regularize_last(moved, period, origin, ["tile", "band", "row", "col"])


def chunks(tiles: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Blocks of each tile (nrows, ncols) with their halo: row, col, nrows, ncols of what is read and of what is owned."""
    d = tiles.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1, F.lit(size)))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("ncols") - 1, F.lit(size))))
    r1, c1 = F.least(F.col("_r") + size, F.col("nrows")), F.least(F.col("_c") + size, F.col("ncols"))
    row, col = F.greatest(F.col("_r") - overlap, F.lit(0)), F.greatest(F.col("_c") - overlap, F.lit(0))
    return d.select(
        "tile", F.col("_r").alias("own_row"), F.col("_c").alias("own_col"), (r1 - F.col("_r")).alias("own_nrows"), (c1 - F.col("_c")).alias("own_ncols"),
        row.alias("row"), col.alias("col"), (F.least(r1 + overlap, F.col("nrows")) - row).alias("nrows"), (F.least(c1 + overlap, F.col("ncols")) - col).alias("ncols"),
    )


def locate(points: DataFrame, tiles: DataFrame, strict: bool = True) -> DataFrame:
    """Adds tile, row and col of the cells that hold points (longitude, latitude); strict: not on a tile's edge.

    Points and tiles meet on a plan of cells as large as the largest tile, so a tile is in four of them at most.
    """
    x, y = F.col("longitude"), F.col("latitude")
    inside = (x > F.col("xmin")) & (x < F.col("xmax")) & (y > F.col("ymin")) & (y < F.col("ymax")) if strict else x.between(F.col("xmin"), F.col("xmax")) & y.between(F.col("ymin"), F.col("ymax"))
    w, h = tiles.agg(F.max(F.col("xmax") - F.col("xmin")), F.max(F.col("ymax") - F.col("ymin"))).first()
    w, h = float(w or 1), float(h or 1)
    cells = tiles.select("tile", *BOX, "xres", "yres", F.explode(F.sequence(F.floor(F.col("xmin") / w), F.floor(F.col("xmax") / w))).alias("_cx"), F.sequence(F.floor(F.col("ymin") / h), F.floor(F.col("ymax") / h)).alias("_s"))
    cells = cells.withColumn("_cy", F.explode("_s")).drop("_s")
    d = points.withColumns({"_cx": F.floor(x / w), "_cy": F.floor(y / h)}).join(cells, ["_cx", "_cy"]).where(inside)
    return d.select(*points.columns, "tile", F.floor((F.col("ymax") - y) / F.col("yres")).cast("int").alias("row"), F.floor((x - F.col("xmin")) / F.col("xres")).cast("int").alias("col"))


def get_data(points: DataFrame, tiles: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Series at sample points within their own dates; the first row of equal locations, dates and labels stays."""
    at = locate(points.dropDuplicates(keys), tiles)
    return at.join(pixels, ["tile", "row", "col"]).where(F.col("date").between(F.col("start_date"), F.col("end_date"))).drop("tile", "row", "col")


def get_values(points: DataFrame, tiles: DataFrame, pixels: DataFrame, strict: bool = True) -> DataFrame:
    """Classes or probabilities at points."""
    return locate(points, tiles, strict).join(pixels, ["tile", "row", "col"])


def average_polygon(df: DataFrame, bands: list[str]) -> DataFrame:
    """Mean series of the points of a polygon."""
    return df.groupBy("polygon_id", "label", "date").agg(*(F.avg(c).alias(c) for c in ("longitude", "latitude", *bands)))


def resample(pixels: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """Pixels of a coarser grid: the mean, the mode (of several the least) or the first cell of each block."""
    keys = ["tile", "band", "date", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")]
    if how == "mean":
        return pixels.groupBy(*keys).agg(F.avg("value").alias("value"))
    if how == "first":
        return pixels.groupBy(*keys).agg(F.min(F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.col("value").alias("v"))).alias("_m")).select("tile", "band", "date", "row", "col", F.col("_m.v").alias("value"))
    n = pixels.groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    return n.groupBy("tile", "band", "date", "row", "col").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("value").alias("v"))).alias("_m")).select("tile", "band", "date", "row", "col", F.col("_m.v").alias("value"))


def copy(pixels: DataFrame, tiles: DataFrame, path: str, roi: tuple[float, float, float, float] | None = None, factor: int = 1, mode: str = "errorifexists") -> DataFrame:
    """A local copy, cropped and resampled; the written cube."""
    from ..sources.sinks import write_cube

    d = crop(pixels, tiles, roi) if roi is not None else pixels
    write_cube(resample(d, factor) if factor > 1 else d, path, mode=mode)
    return pixels.sparkSession.read.parquet(path)


def is_regular(assets: DataFrame) -> bool:
    """Whether all tiles have the same bands, and all bands the same dates."""
    per = assets.groupBy("tile", "band").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    t = per.groupBy("tile").agg(F.array_sort(F.collect_list("band")).alias("bands"), F.count_distinct("dates").alias("n"), F.min("dates").alias("dates"))
    r = t.agg(F.count_distinct("bands"), F.max("n"), F.count_distinct("dates")).first()
    return tuple(r) == (1, 1, 1)


def merge(a: DataFrame, b: DataFrame, days: tuple[int, int] = (16, 16)) -> DataFrame:
    """Two cubes as one, by what they are: regular ones must share tiles and add bands, on the dates of the first."""
    if is_regular(a) and is_regular(b):
        if not a.select("tile").exceptAll(b.select("tile")).isEmpty() and a.select("tile").intersect(b.select("tile")).isEmpty():
            raise ValueError("regular cubes must have tiles in common")
        new = b.join(a.select("band").distinct(), "band", "left_anti").join(a.select("tile").distinct(), "tile", "left_semi")
        if a.select("date").distinct().exceptAll(b.select("date").distinct()).isEmpty():
            return a.unionByName(new, allowMissingColumns=True)
        pairs = merge_overlap(a, new, *days).withColumnsRenamed({"date2": "date"})
        return a.unionByName(new.join(pairs, ["tile", "date"]).drop("date").withColumnRenamed("date1", "date"), allowMissingColumns=True)
    same = a.select("band").distinct().exceptAll(b.select("band").distinct()).isEmpty() and b.select("band").distinct().exceptAll(a.select("band").distinct()).isEmpty()
    return merge_densify(a, b) if same else merge_compactify(a, b)


def deseasoned(df: DataFrame, band: str, quantile: float = 0.95, date: str = "date", tile: str = "tile") -> DataFrame:
    """A band less its quantile over all of a tile's pixels at the date."""
    q = quantiles(df, band, [quantile], [tile, date], "_q")
    return df.join(q, [tile, date]).withColumn(band, F.col(band) - F.col("_q")[0]).drop("_q")


def validate(points: DataFrame, tiles: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """predicted and reference labels of a map at validation points; a point on a tile's edge counts."""
    at = locate(points.select(F.col(label).alias("reference"), "longitude", "latitude"), tiles, strict=False)
    return at.join(classes.select("tile", "row", "col", F.col("label").alias("predicted")), ["tile", "row", "col"]).select("predicted", "reference")
