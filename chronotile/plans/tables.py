"""The engine's inputs from the sample tables: series, observations, a raster grid, probabilities, a catalog and points.

Each function has its SQL beside it under the same name in `SQL`; oracle queries prepend what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly sums of quantity and price for each supplier; the label is its region."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("index")).agg(F.sum("l_quantity").alias("QTY"), F.round(F.sum("l_extendedprice"), 2).alias("PRICE"))
    n = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("label"))  # 25 and 5 rows
    who = read(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample_id"), "label")
    return s.join(who, "sample_id")


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """The series with values missing where quantity is a multiple of 3."""
    return series(spark, d).withColumn("QTY", F.when(F.col("QTY") % 3 != 0, F.col("QTY")))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Irregular observations: a user's events by type, with a cloud cover; values of cloudy ones are missing."""
    cloud = F.pmod(F.col("event_id") * 37, F.lit(100))
    return read(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("band"), F.to_date("ts").alias("date"), cloud.cast("int").alias("cloud_cover"), F.when(cloud < 80, F.col("value")).alias("value"))


def grid(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 20 x 20 pixels."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        F.concat(F.lit("T"), F.floor(k / 400).cast("string")).alias("tile"), F.floor(k % 400 / 20).cast("int").alias("row"), (k % 20).cast("int").alias("col"),
        F.col("p_retailprice").alias("value"), (F.col("p_size") % 5 + 1).alias("class"), F.col("p_size").cast("double").alias("size"), k.alias("pixel"),
    )


PROBS = ["a", "b", "c"]


def probs(spark: SparkSession, d: str) -> DataFrame:
    """Three probabilities for each pixel."""
    g = grid(spark, d).withColumns({"a": 1 + F.col("size") % 7, "b": (1 + F.col("pixel") * 7 % 11).cast("double"), "c": (1 + F.col("pixel") * 13 % 5).cast("double")})
    t = F.col("a") + F.col("b") + F.col("c")
    return g.withColumn("_t", t).select("tile", "row", "col", "pixel", *((F.col(p) / F.col("_t")).alias(p) for p in PROBS))


def assets(spark: SparkSession, d: str) -> DataFrame:
    """A catalog: a tile for each nation, an image for each order priority and month."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("tile"), F.substring("o_orderpriority", 1, 1).alias("band"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.min("o_orderkey").alias("fid"), (F.count("*") * 13 % 100).cast("int").alias("cloud_cover"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of nations on a 5 x 5 plan of cells 10 wide and 12 high."""
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select(F.concat(F.lit("N"), k.cast("string")).alias("tile"), (k % 5 * 10).cast("double").alias("xmin"), (F.floor(k / 5) * 10).cast("double").alias("ymin"), (k % 5 * 10 + 10).cast("double").alias("xmax"), (F.floor(k / 5) * 10 + 12).cast("double").alias("ymax"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Customers as points of the grid's tiles, with a period of interest."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("sample_id"), (k * 37 % 997 / 10.0).alias("longitude"), (k * 53 % 199 / 10.0).alias("latitude"), F.lit("1996-01-01").cast("date").alias("start_date"), F.lit("1998-12-31").cast("date").alias("end_date"), F.col("c_mktsegment").alias("label"))


def grid_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of the grid's tiles: each 20 wide and high, side by side."""
    k = F.floor(F.col("p_partkey") / 400)
    t = read(spark, d, "part").select(k.alias("k")).distinct()
    return t.select(F.concat(F.lit("T"), F.col("k").cast("string")).alias("tile"), (F.col("k") * 20).cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), (F.col("k") * 20 + 20).cast("double").alias("xmax"), F.lit(20.0).alias("ymax"), F.lit(1.0).alias("xres"), F.lit(1.0).alias("yres"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Predicted and reference classes: lines' status by return flag."""
    x = read(spark, d, "lineitem")
    return x.select(F.col("l_returnflag").alias("predicted"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("A")).when(F.col("l_linestatus") == "O", F.lit("N")).otherwise(F.col("l_returnflag")).alias("reference"), "l_orderkey")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Feature vectors with a label."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


SQL = {
    "series": """series as (select l.l_suppkey as sample_id, cast(date_trunc('month', l.l_shipdate) as date) as idx, sum(l.l_quantity) as qty, round(sum(l.l_extendedprice), 2) as price, any_value(r.r_name) as label
      from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2)""",
    "gappy": """gappy as (select sample_id, idx, case when qty % 3 <> 0 then qty end as qty, price, label from series)""",
    "obs": """obs as (select user_id as sample_id, event_type as band, cast(ts as date) as date, cast(event_id * 37 % 100 as int) as cloud_cover, case when event_id * 37 % 100 < 80 then value end as value from events)""",
    "grid": """grid as (select 'T' || cast(p_partkey // 400 as varchar) as tile, cast(p_partkey % 400 // 20 as int) as row, cast(p_partkey % 20 as int) as col, p_retailprice as value, p_size % 5 + 1 as class, cast(p_size as double) as size, p_partkey as pixel from part)""",
    "probs": """probs0 as (select tile, row, col, pixel, 1 + size % 7 as a, cast(1 + pixel * 7 % 11 as double) as b, cast(1 + pixel * 13 % 5 as double) as c from grid),
    probs as (select tile, row, col, pixel, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from probs0)""",
    "assets": """assets as (select 'N' || cast(c_nationkey as varchar) as tile, substring(o_orderpriority, 1, 1) as band, cast(date_trunc('month', o_orderdate) as date) as date, min(o_orderkey) as fid, cast(count(*) * 13 % 100 as int) as cloud_cover from orders join customer on o_custkey = c_custkey group by 1, 2, 3)""",
    "tiles": """tiles as (select 'N' || cast(n_nationkey as varchar) as tile, cast(n_nationkey % 5 * 10 as double) as xmin, cast(n_nationkey // 5 * 10 as double) as ymin, cast(n_nationkey % 5 * 10 + 10 as double) as xmax, cast(n_nationkey // 5 * 10 + 12 as double) as ymax from nation)""",
    "points": """points as (select c_custkey as sample_id, c_custkey * 37 % 997 / 10.0 as longitude, c_custkey * 53 % 199 / 10.0 as latitude, c_mktsegment as label from customer)""",
    "grid_tiles": """grid_tiles as (select 'T' || cast(k as varchar) as tile, k * 20.0 as xmin, 0.0 as ymin, k * 20.0 + 20 as xmax, 20.0 as ymax from (select distinct p_partkey // 400 as k from part))""",
    "pairs": """pairs as (select l_returnflag as predicted, case when l_linenumber % 3 = 0 then 'A' when l_linestatus = 'O' then 'N' else l_returnflag end as reference from lineitem)""",
    "vectors": """vectors as (select vec_id as sample_id, 'L' || cast(label as varchar) as label, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings)""",
}


def sql(*parts: str) -> str:
    """`with` the named inputs."""
    return "with " + ",\n".join(SQL[p] for p in parts)
