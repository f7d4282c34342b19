"""Series verbs against closed forms."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronotile.functions import dates as D
from chronotile.functions import scalars, temporal
from chronotile.operators import series as S


def frame(spark, *values, sample=1):
    return spark.createDataFrame([(sample, date(2020, 1, 1 + k), None if v is None else float(v)) for k, v in enumerate(values)], "sample_id long, index date, V double")


def reduced(spark, *values):
    by = [*temporal.REDUCTIONS, "t_fslope"]
    return S.reduce(frame(spark, *values), "V", by).first().asDict()


def test_reductions(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    r = reduced(spark, *x)
    m = x.mean()
    skew = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    assert r["t_max"] == 9 and r["t_min"] == 1 and r["t_mean"] == 4 and r["t_median"] == 3 and r["t_amplitude"] == 8 and r["t_fslope"] == 5
    assert r["t_std"] == pytest.approx(x.std(ddof=1))
    assert r["t_skewness"] == pytest.approx(skew * (math.sqrt(12) / 4 - 2))
    assert r["t_kurtosis"] == pytest.approx(((x - m) ** 4).mean() / ((x - m) ** 2).mean() ** 2)
    assert r["t_mse"] == pytest.approx((np.abs(np.fft.fft(x)) ** 2).mean())
    assert r["t_fqr"] == pytest.approx(np.quantile(x, 0.25, method="hazen"))
    assert r["t_iqr"] == pytest.approx(np.quantile(x, 0.75, method="hazen") - np.quantile(x, 0.25, method="hazen"))


def test_a_single_value_has_no_spread(spark):
    r = reduced(spark, 5)
    assert r["t_std"] == 0 and r["t_amplitude"] == 0 and r["t_fslope"] is None and r["t_fqr"] == 5


@pytest.mark.parametrize(
    ("given_", "filled"),
    [
        ([None, 1, None, 3, None], [1, 1, 2, 3, 3]),
        ([None, None], [None, None]),
        ([2, None, None, 8], [2, 4, 6, 8]),
        ([1, 2], [1, 2]),
    ],
)
def test_impute(spark, given_, filled):
    once = S.impute_linear(frame(spark, *given_), "V")
    assert [r.V for r in once.orderBy("index").collect()] == filled
    assert [r.V for r in S.impute_linear(once, "V").orderBy("index").collect()] == filled


def test_whittaker_solves_its_system(spark):
    x = np.array([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0])
    z = np.array([r.V for r in S.whittaker(frame(spark, *x), "V", 0.5).orderBy("index").collect()])
    d = np.diff(np.eye(7), 2, axis=0)
    assert np.allclose((np.eye(7) + 0.5 * d.T @ d) @ z, x)


def test_sgolay_keeps_cubics_and_refuses_bad_lengths(spark):
    x = np.arange(9.0) ** 3
    assert np.allclose([r.V for r in S.sgolay(frame(spark, *x), "V").orderBy("index").collect()], x)
    with pytest.raises(ValueError):
        S.sgolay_matrix(9, 3, 4)
    with pytest.raises(ValueError):
        S.sgolay_matrix(9, 5, 5)


def test_select_needs_both_ends_of_an_interval(spark):
    f = frame(spark, 1, 2, 3)
    assert S.select(f, start="2020-01-02").count() == 3
    assert S.select(f, start="2020-01-02", end="2020-01-02").count() == 1
    with pytest.raises(ValueError):
        S.select(f, bands=["X"])


def test_nest_round_trip(spark):
    f = frame(spark, 3, None, 1)
    back = S.unnest(S.nest(f, ["V"])).select("sample_id", "index", "V")
    assert sorted(map(str, back.collect())) == sorted(map(str, f.collect()))


def test_predictors_and_split(spark):
    f = frame(spark, *range(7)).withColumn("label", F.lit("a"))
    r = S.predictors(f, ["V"], 3).first()
    assert (r.V1, r.V2, r.V3) == (0, 1, 2)
    assert sorted(r["chunk"] for r in S.split(f, 3).select("chunk").distinct().collect()) == [0, 1]


def test_merge_renames_common_bands(spark):
    m = S.merge(frame(spark, 1, 2), frame(spark, 5, 6))
    assert [(r["V.1"], r["V.2"]) for r in m.orderBy("index").collect()] == [(1, 5), (2, 6)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=2, max_size=6))
def test_softmax_sums_to_one(spark, values):
    d = spark.createDataFrame([(values,)], "x array<double>").select(scalars.softmax(F.col("x")).alias("p")).first().p
    e = np.exp(np.array(values) - max(values))
    assert np.allclose(d, e / e.sum())


def test_label_of_ties_missing_and_zero(spark):
    d = spark.createDataFrame([([0.5, 0.5],), ([0.2, None],), ([0.0, 0.0],)], "p array<double>")
    assert [r[0] for r in d.select(scalars.label_max(F.col("p"))).collect()] == [1, 0, None]


def test_dates_and_periods(spark):
    d = spark.createDataFrame([("2020",), ("2020-03",), ("2020-03-07",), ("20200307",), ("x",)], "t string")
    assert [r[0] for r in d.select(D.parse_date(F.col("t"))).collect()] == [date(2020, 1, 1), date(2020, 3, 1), date(2020, 3, 7), date(2020, 3, 7), None]
    s = spark.createDataFrame([(date(2024, 1, 1), date(2024, 12, 31))], "start_date date, end_date date")
    w = D.period_windows(s, "P6M", "P1M").orderBy("window_start").collect()
    assert len(w) == 12 and w[0].window_end == date(2024, 7, 1) and w[1].window_start == date(2024, 1, 31) and w[-1].window_end == date(2024, 12, 31)
    with pytest.raises(ValueError):
        D.parse_period("P1W")
    t = spark.createDataFrame([(date(2020, 3, 7), date(2020, 6, 1))], "a date, b date").select(D.valid_timeline(F.col("a"), F.col("b"), "P1M")).first()[0]
    assert t == [date(2020, k, 1) for k in range(3, 7)]
