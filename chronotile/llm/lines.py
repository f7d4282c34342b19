"""Boilerplate lines by the number of distinct sites that hold them.

Every line is hashed (64 bits, its white space trimmed); sketches of the sites of each hash merge by aggregation. Lines
whose estimate lies within the sketch's error of the threshold get an exact distinct count. Lines on `min_sites` sites
or more go from all documents that hold something else; a document in which every line with a word is such a line is a
copy as a whole, which is not this operator's to remove, and stays as it is.

Null text stays null; null sites count as one site; blank lines are never counted nor removed. A line on exactly
`min_sites` sites goes. Repeated rows are cleaned alike. Texts of any length are cleaned whole. An empty table gives an
empty result. Extra columns pass through `clean_lines` untouched; of those named as its own two, `columns` says which
names it gives them instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, sized, written

TRIM = " \t\r\x0b\f"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(TRIM)))


def site_lines(docs: DataFrame, site: str) -> DataFrame:
    """(_h, _s): line hash and site, once for each document that holds the line."""
    d = docs.select(F.xxhash64(F.col(site)).alias("_s"), _lines(F.col("text")).alias("_l"))
    d = d.select("_s", F.explode(F.array_distinct(F.transform(F.filter("_l", lambda x: F.btrim(x, F.lit(TRIM)) != ""), _hash))).alias("_h"))
    return d.select("_h", "_s")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10, lg_k: int = 10) -> DataFrame:
    """line_hash and n_sites of lines on at least `min_sites` sites; n_sites is an estimate where it is far above."""
    error = 3 * 1.04 / (1 << lg_k) ** 0.5
    low, high = min_sites / (1 + error) - 1, min_sites * (1 + error) + 1
    lines = site_lines(docs, site)
    spread = lines.groupBy("_h").agg(F.hll_sketch_agg("_s", F.lit(lg_k)).alias("_k"), F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    spread = spread.where("_a < _b").select("_h", F.hll_sketch_estimate("_k").alias("_n"))
    spread = written(spread.where(F.col("_n") >= low), "lines-spread")
    near = spread.where(F.col("_n") < high).select(F.col("_h").alias("_g"))
    exact = looked_up(lines, near, "_h", "_g").groupBy("_h", "_s").agg(F.lit(1).alias("_1")).groupBy("_h").agg(F.count("*").alias("_n"))
    found = spread.where(F.col("_n") >= high).unionByName(exact.where(F.col("_n") >= min_sites))
    return written(found.select(F.col("_h").alias("line_hash"), F.col("_n").cast("long").alias("n_sites")), "lines-boilerplate")


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = 10, lg_k: int = 10, columns: tuple[str, str] | None = ("lines_found", "lines_removed")) -> DataFrame:
    """The documents, their columns, with text cleaned, and two long columns; with `columns` None the documents' own alone."""
    found = boilerplate(docs, site, min_sites, lg_k).select(F.col("line_hash").alias("_b"))
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    lines = docs.select(key.alias("_r"), F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _hash))).alias("_h"))
    hits = looked_up(lines, found, "_h", "_b").groupBy("_r").agg(F.collect_set("_h").alias("_drop"))
    hits = written(hits, "lines-hits")
    hashes = hits.agg(F.sum(F.size("_drop"))).first()[0] or 0
    d = docs.select(F.struct("*").alias("__d"), key.alias("__key"), F.col("text").alias("__t"))
    d = d.join(sized(hits, hashes), F.col("__key") == F.col("_r"), "left").withColumn("__all", _lines(F.col("__t")))
    d = d.withColumn("__left", F.expr("if(_drop is null, __all, filter(__all, x -> not array_contains(_drop, xxhash64(btrim(x, ' \t\r\x0b\f')))))"))
    d = d.withColumn("__go", F.col("_drop").isNotNull() & F.exists("__left", lambda x: F.btrim(x, F.lit(TRIM)) != ""))
    own = columns or ()
    counts = (
        F.greatest(F.coalesce(F.size("__all"), F.lit(0)), F.lit(0)).cast("long"),
        F.when(F.col("__go"), F.size("__all") - F.size("__left")).otherwise(0).cast("long"),
    )
    return d.select(
        *(F.when(F.col("__go"), F.array_join("__left", "\n")).otherwise(F.col("__t")).alias("text") if c == "text" else F.col(f"__d.`{c}`") for c in docs.columns if c not in own),
        *(c.alias(name) for c, name in zip(counts, own, strict=False)),
    )
