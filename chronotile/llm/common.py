"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, drop_tables, written  # noqa: F401

#: Separators of words: space and the control characters tab to carriage return.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"

#: Row limit up to which a table of short rows is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if its counted rows are within the limit; else leaves the join to a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def in_few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """A table of about so many rows, in as many tasks as that takes: what follows a shuffle is short without a task for each
    of its partitions."""
    return df.coalesce(1 + rows // each)


def looked_up(big: DataFrame, small: DataFrame, left: str, right: str, rows: int | None = None, salts: int = 32) -> DataFrame:
    """Inner join of big.left with the distinct keys small.right, some of which may be hot.

    Up to BROADCAST_ROWS keys are broadcast. More of them are repeated for each salt, and rows of big take one by turns.
    """
    n = small.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), F.col(left) == F.col(right))
    many = small.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return dealt.join(many, (F.col(left) == F.col(right)) & (F.col("_salt") == F.col("_salt2"))).drop("_salt", "_salt2")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, an empty array if there is none."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(*caches: dict) -> Callable:
    """A decorator for functions of batches: at a task's end its caches are emptied and freed memory goes back.

    Python workers outlive their tasks; without this each of them keeps what its largest task took.
    """

    def wrap(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(batches: Iterator) -> Iterator:
            try:
                yield from fn(batches)
            finally:
                for c in caches:
                    c.clear()
                gc.collect()
                pa.default_memory_pool().release_unused()
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

        return run

    return wrap
