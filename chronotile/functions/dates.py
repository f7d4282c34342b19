"""Dates, timelines and ISO periods (P16D, P1M, P1Y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """Dates written as year, year-month, year-month-day, or eight digits."""
    t = F.trim(text)
    return (
        F.when(t.rlike("^[0-9]{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        .when(t.rlike("^[0-9]{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
        .when(t.rlike("^[0-9]{4}-[0-9]{1,2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01")), F.lit("yyyy-M-dd")))
        .otherwise(F.try_to_timestamp(t, F.lit("yyyy-M-d")))
        .cast("date")
    )


def period_value(period: Column) -> Column:
    return F.regexp_extract(period, "^P([0-9]+)[DMY]$", 1).cast("int")


def period_unit(period: Column) -> Column:
    unit = F.regexp_extract(period, "^P[0-9]+([DMY])$", 1)
    return F.when(unit == "D", "day").when(unit == "M", "month").when(unit == "Y", "year")


def parse_period(period: str) -> tuple[int, str]:
    n, unit = period[1:-1], period[-1]
    if period[:1] != "P" or not n.isdigit() or unit not in "DMY" or int(n) < 1:
        raise ValueError(f"not a period: {period!r}")
    return int(n), {"D": "day", "M": "month", "Y": "year"}[unit]


def step(date: Column, period: str, times: Column | int = 1) -> Column:
    """The date after so many periods."""
    n, unit = parse_period(period)
    k = (F.lit(times) if isinstance(times, int) else times) * n
    if unit == "day":
        return F.date_add(date, k.cast("int"))
    return F.add_months(date, (k * (12 if unit == "year" else 1)).cast("int"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


#: Mean lengths of a unit in days, for spans that slide by a duration and not by the calendar.
DAYS = {"day": 1.0, "month": 30.4375, "year": 365.25}


def period_windows(spans: DataFrame, period: str, every: str, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Each row's windows of `period`, one every `every` while it begins before the end; none goes beyond the end.

    Months and years are mean durations, whose parts of a day add up from window to window.
    """
    (n, unit), (m, by) = parse_period(period), parse_period(every)
    length, step_days = n * DAYS[unit], m * DAYS[by]
    span = F.datediff(F.col(end), F.col(start))
    last = F.ceil(span / F.lit(step_days)).cast("int") - 1
    d = spans.where(span > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    d = d.withColumn("window_start", F.date_add(start, F.floor(F.col("_k") * F.lit(step_days)).cast("int")))
    return d.withColumn("window_end", F.least(F.date_add(start, F.floor(F.col("_k") * F.lit(step_days) + F.lit(length)).cast("int")), F.col(end))).drop("_k")


def valid_timeline(first: Column, last: Column, period: str) -> Column:
    """Dates from the first, taken back to the start of its month or year for such periods, on by the period."""
    n, unit = parse_period(period)
    start = first if unit == "day" else F.trunc(first, unit)
    return F.sequence(start.cast("date"), last, F.expr(f"interval {n} {unit}"))


def date_in_timeline(date: Column, first: Column, second: Column, before_last: Column, last: Column) -> Column:
    """Within a timeline, or within one of its steps before the first or after the last date."""
    return date.between(first, last) | ((date < first) & (F.datediff(first, date) <= F.datediff(second, first))) | ((date > last) & (F.datediff(date, last) <= F.datediff(last, before_last)))
