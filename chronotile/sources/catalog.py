"""Catalogs of images: from file names, from tables, and from providers.

A provider is a set of items of its catalog service, saved as JSON; collections are rows of (source, collection, band,
scale, offset, missing, least, most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS = "source string, collection string, tile string, band string, date date, fid string, cloud_cover double, xmin double, ymin double, xmax double, ymax double, crs string, path string"
DERIVED = "source string, collection string, tile string, band string, start_date date, end_date date, labels map<int, string>, path string"
TILES = "source string, collection string, satellite string, sensor string, tile string, xmin double, ymin double, xmax double, ymax double, xres double, yres double, nrows int, ncols int, crs string, labels map<int, string>"
BANDS = "source string, collection string, band string, scale double, offset double, missing double, least double, most double"


def create_tile(spark: SparkSession, **values) -> DataFrame:
    """A catalog of one tile; what isn't given is null."""
    names = [f.split()[0] for f in TILES.replace("map<int, string>", "map").split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], TILES)


def parse_names(paths: DataFrame, parts: list[str], delim: str = "_", path: str = "path") -> DataFrame:
    """Columns of a file name's parts, by their names; X1, X2 .. are left out. A date is parsed, a band is upper case."""
    from ..functions.dates import parse_date

    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    fields = F.split(name, f"\\Q{delim}\\E")
    d = paths.withColumn("_f", fields).where(F.size("_f") >= len(parts))
    out: dict[str, Column] = {}
    for k, p in enumerate(parts):
        if not p.upper().startswith("X"):
            v = F.col("_f")[k]
            out[p] = parse_date(v) if p in ("date", "start_date", "end_date") else F.upper(v) if p == "band" else v
    return d.withColumns(out).drop("_f")


def local_cube(spark: SparkSession, folder: str, parts: list[str], delim: str = "_", suffix: str = "tif") -> DataFrame:
    """Assets of a folder by their file names; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(folder).select("path")
    return parse_names(files, parts, delim)


def results_cube(spark: SparkSession, path: str, labels: dict[int, str]) -> DataFrame:
    """A written probability, class or uncertainty cube, with the names of its labels."""
    d = spark.read.parquet(path)
    if "class" in d.columns:
        names = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
        d = d.withColumn("label", names[F.col("class")])
    return d


def vector_cube(tiles: DataFrame, segments: DataFrame) -> DataFrame:
    """A cube's tiles with their segments."""
    return tiles.join(segments, "tile")


def cube(spark: SparkSession, source: str = "LOCAL", **options):
    """Chooses the reader: data_dir with bands' names (local), with labels (results), vector segments, or a provider's items."""
    if "segments" in options:
        return vector_cube(options["tiles"], options["segments"])
    if "data_dir" in options:
        if "labels" in options:
            return results_cube(spark, options["data_dir"], options["labels"])
        return local_cube(spark, options["data_dir"], options["parse_info"], options.get("delim", "_"))
    return provider_cube(spark, source, **options)


#: An item of a catalog service, as JSON.
ITEM = "id string, collection string, bbox array<double>, properties struct<tile: string, datetime: string, `eo:cloud_cover`: double, `proj:epsg`: int>, assets map<string, struct<href: string>>"


def items_cube(spark: SparkSession, source: str, items: list[str]) -> DataFrame:
    """Assets of saved items, a line of JSON for each; paths are of any store that Spark reads."""
    d = spark.read.schema(ITEM).json(items).select("*", F.explode("assets").alias("_band", "_asset"))
    box = [F.col("bbox")[k].alias(n) for k, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    return d.select(
        F.lit(source).alias("source"), "collection", F.col("properties.tile").alias("tile"), F.upper("_band").alias("band"), F.substring("properties.datetime", 1, 10).cast("date").alias("date"),
        F.col("id").alias("fid"), F.col("properties.`eo:cloud_cover`").alias("cloud_cover"), *box, F.col("properties.`proj:epsg`").cast("string").alias("crs"), F.col("_asset.href").alias("path"),
    )


def provider_cube(spark: SparkSession, source: str, items: list[str], collection: str | None = None, bands=None, tiles=None, start=None, end=None, roi=None) -> DataFrame:
    """A provider's assets by collection, bands, tiles or region, and interval."""
    from ..operators import cube as C

    d = items_cube(spark, source, items)
    if collection is not None:
        d = d.where(F.col("collection") == collection)
    if tiles is not None and roi is not None:
        raise ValueError("tiles or a region, not both")
    d = C.select(d, bands=bands, start=start, end=end, tiles=tiles)
    return C.filter_spatial(d, roi) if roi is not None else d


def list_collections(bands: DataFrame) -> DataFrame:
    """Sources, collections, and their bands."""
    return bands.groupBy("source", "collection").agg(F.array_sort(F.collect_set("band")).alias("bands"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """longitude, latitude, start_date, end_date, label of a CSV file with a header."""
    return read_points(spark, path).where("start_date is not null and end_date is not null")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.dates import parse_date

    d = spark.read.option("header", "true").csv(path)
    text = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    return d.select(F.col("longitude").cast("double").alias("longitude"), F.col("latitude").cast("double").alias("latitude"), parse_date(text("start_date")).alias("start_date"), parse_date(text("end_date")).alias("end_date"), text("label").alias("label"))


def with_defaults(df: DataFrame, start=None, end=None, label: str = "NoClass") -> DataFrame:
    """Points of any frame with longitude and latitude; what is missing takes the defaults."""
    col = lambda c, kind, v: F.coalesce(F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind), F.lit(v).cast(kind)).alias(c)
    rest = [c for c in df.columns if c not in ("label", "start_date", "end_date")]
    return df.select(*rest, col("label", "string", label), col("start_date", "date", start), col("end_date", "date", end))


def masked_bands(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    """Stored values as physical ones, by each band's missing value, range, scale and offset."""
    from ..functions.scalars import masked

    b = F.broadcast(bands.select("band", "scale", "offset", "missing", "least", "most"))  # a collection's bands
    v = masked(F.col("value"), F.col("missing"), F.col("least"), F.col("most"), F.col("scale"), F.col("offset"))
    return pixels.join(b, "band").withColumn("value", v).select(*pixels.columns)
