"""Windows, maps and cubes against plain loops."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.operators import accuracy, change, cube, learn, maps, sampling
from chronotile.operators import neighbourhood as N


def pixels(spark, a, name="value"):
    rows = [("T", r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"tile string, row int, col int, {name} double")


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("name", ["w_median", "w_mean", "w_sd", "w_min", "w_max", "w_var"])
def test_kernels_over_chunks(spark, name):
    a = np.random.default_rng(1).integers(0, 9, (11, 7)).astype(float)
    a[2, 3] = np.nan
    padded = np.pad(a, 1, mode="symmetric")
    fn = {"w_median": np.nanmedian, "w_mean": np.nanmean, "w_sd": lambda x: np.nanstd(x, ddof=1), "w_min": np.nanmin, "w_max": np.nanmax, "w_var": lambda x: np.nanvar(x, ddof=1)}[name]
    want = np.array([[fn(padded[r : r + 3, c : c + 3]) for c in range(7)] for r in range(11)])
    for chunk in (4, 64):
        assert np.allclose(array(N.kernel(pixels(spark, a), "value", name, 3, chunk), name, a.shape), want)


def test_modal_ties_go_to_the_least(spark):
    a = np.array([[1.0, 2.0], [2.0, 1.0]])
    assert (array(N.kernel(pixels(spark, a), "value", "w_modal", 1), "w_modal", a.shape) == a).all()
    assert N.w_modal(np.array([[3.0, 1, 3, 1, 2], [1, np.nan, 1, 1, 1]])).tolist()[0] == 1
    assert np.isnan(N.w_modal(np.array([[1, np.nan, 1.0]]))[0])


def test_smoothing_keeps_sums_and_constants(spark):
    p = np.full((6, 6), 0.3)
    d = pixels(spark, p, "a").withColumn("b", 1 - F.col("a"))
    s = N.smooth(d, ["a", "b"], 5, chunk=4)
    assert np.allclose(array(s, "a", p.shape), 0.3) and np.allclose(array(s, "b", p.shape), 0.7)
    with pytest.raises(ValueError):
        N.smooth(d, ["a", "b"], 4)


def test_texture_of_a_flat_image(spark):
    d = pixels(spark, np.full((4, 4), 5.0))
    for m, v in {"glcm_contrast": 0, "glcm_homogeneity": 1, "glcm_energy": 1, "glcm_mean": 5, "glcm_correlation": 1}.items():
        assert np.allclose(array(N.texture(d, "value", m), m, (4, 4)), v)
    with pytest.raises(ValueError):
        N.texture(d, "value", "glcm_x")


def test_reclassify_last_rule_wins_and_null_masks(spark):
    d = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, mask int").withColumn("label", F.lit("old"))
    r = maps.reclassify(d, {"x": F.col("mask") > 4, "y": F.col("mask") > 6}).orderBy("k").collect()
    assert [x.label for x in r] == ["x", None, "y"]
    assert maps.new_codes({1: "a", 4: "b"}, ["b", "c"]) == {1: "a", 4: "b", 5: "c"}


def test_combine_checks_weights(spark):
    d = pixels(spark, np.full((2, 2), 0.5), "a")
    with pytest.raises(ValueError):
        maps.combine_average([d, d], ["a"], [0.5, 0.6])
    assert maps.combine_average([d, d], ["a"]).first().a == 0.5


def test_certain_classifiers_weigh_more(spark):
    from chronotile.functions import scalars

    x, y = pixels(spark, np.full((1, 1), 0.2), "a"), pixels(spark, np.full((1, 1), 0.8), "a")
    u = [pixels(spark, np.full((1, 1), v), "entropy") for v in (0.1, 0.3)]
    assert maps.combine_uncertainty([x, y], u, ["a"]).first().a == pytest.approx((0.2 * 3 + 0.8) / 4)
    one = spark.range(1).select(scalars.inverse_uncertainty([F.lit(0.2), F.lit(0.8)], [F.lit(0.1), F.lit(0.3)], compat=True).alias("v")).first().v
    assert one == pytest.approx(0.75 * 0.2 + 0.75 * 0.8)


def test_degenerate_tables_give_nulls(spark):
    t = accuracy.confusion(spark.createDataFrame([("a", "a")], "predicted string, reference string"))
    assert accuracy.overall(t).first().kappa is None
    assert accuracy.area_assess(t, spark.createDataFrame([("a", 5.0)], "label string, area double")).first().stderr_area is None
    assert accuracy.rand_indices(spark.createDataFrame([("a", "b")], "x string, y string"), "x", "y").first().rand is None


def test_regularize_takes_the_least_cloudy(spark):
    rows = [(1, date(2020, 1, 1), 50, 1.0), (1, date(2020, 1, 9), 10, 2.0), (1, date(2020, 1, 17), 0, None), (1, date(2020, 1, 18), 9, 3.0), (1, date(2019, 12, 31), 0, 9.0)]
    d = spark.createDataFrame(rows, "k int, date date, cloud_cover int, value double")
    r = cube.regularize(d, "P16D", "2020-01-01", ["k"]).orderBy("period").collect()
    assert [(x.period, x.value) for x in r] == [(date(2020, 1, 1), 2.0), (date(2020, 1, 17), 3.0)]
    full = cube.with_calendar(cube.regularize(d, "P16D", "2020-01-01", ["k"]), "P16D", "2020-01-01", "2020-02-20", ["k"]).orderBy("period").collect()
    assert [x.value for x in full] == [2.0, 3.0, None, None]


def test_accuracy_drops_unknown_predictions(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("z", "a")], "predicted string, reference string")
    t = accuracy.confusion(d)
    assert t.agg(F.sum("n")).first()[0] == 3
    r = accuracy.overall(t).first()
    assert r.accuracy == pytest.approx(2 / 3) and r.kappa == pytest.approx(0.4)


def test_sampling_is_stratified_and_repeats(spark):
    d = spark.range(100).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 30, "x").otherwise("y").alias("label"))
    a = sorted(r[0] for r in sampling.stratified(d, 0.1).select("sample_id").collect())
    assert a == sorted(r[0] for r in sampling.stratified(d.repartition(7), 0.1).select("sample_id").collect())
    assert {r.label: r["count"] for r in sampling.stratified(d, 0.1).groupBy("label").count().collect()} == {"x": 3, "y": 7}
    with pytest.raises(ValueError):
        sampling.sample(d, 1.5)
    s = sampling.smote(d.withColumns({"f": F.col("sample_id").cast("double"), "g": F.lit(1.0)}), ["f", "g"], 40)
    assert s.count() == 10 and s.where("f < 0 or f > 29 or g <> 1").count() == 0


def test_ranks_are_exact_over_many_buckets(spark):
    d = spark.range(5000).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"))
    for bits in (2, 12):
        r = sampling.ranked(d, "sample_id", "label", bits=bits).toPandas()
        for _, part in r.groupby("label"):
            order = part.sort_values("_rank").sample_id.to_numpy()
            keys = (order * sampling.MIX) % sampling.PRIME
            assert sorted(part._rank) == list(range(1, len(part) + 1)) and (np.diff(keys) >= 0).all() and (part._n == len(part)).all()


def test_change_runs_and_layouts(spark):
    from chronotile.operators import series as S

    d = spark.createDataFrame([("T", 0, c, 3) for c in (0, 1, 4)] + [("T", 1, 1, 3), ("T", 1, 2, None)], "tile string, row int, col int, change int")
    assert sorted((r.row, r.col_from, r.col_to, r.cells) for r in change.change_polygons(d).collect()) == [(0, 0, 1, 2), (0, 4, 4, 1), (1, 1, 1, 1)]
    f = spark.createDataFrame([(1, 1, 5.0, 7.0), (1, 2, 6.0, 8.0), (2, 1, 9.0, 1.0)], "sample_id int, index int, A double, B double")
    assert {r.sample_id: r["values"] for r in S.values(f, ["A", "B"]).collect()} == {1: [[5, 7], [6, 8]], 2: [[9, 1]]}
    assert {(r[0], r[1]): r[2] for r in S.values(f, ["A"], "bands_dates_cases").collect()} == {("A", 1): [5, 9], ("A", 2): [6]}
    assert {(r[0], r[1]): r[2] for r in S.values(f, ["A"], "bands_cases_dates").collect()} == {("A", 1): [5, 6], ("A", 2): [9]}
    with pytest.raises(ValueError):
        S.values(f, ["A"], "x")


def test_dtw_and_changes(spark):
    x = np.array([1.0, 2.0, 3.0])
    assert change.dtw(x, x) == 0
    assert change.dtw(np.array([0.0, 0.0]), np.array([1.0, 1.0])) == 3
    rows = [(1, date(2020, 1, k + 1), p) for k, p in enumerate([0.1, 0.2, 0.8, 0.9, 0.9])] + [(2, date(2020, 1, k + 1), 0.2) for k in range(5)]
    r = change.detect_changes(spark.createDataFrame(rows, "sample_id long, index date, p double"), "p").orderBy("sample_id").collect()
    assert r[0].change == date(2020, 1, 4) and r[1].change is None


def test_a_refused_run_is_tried_again():
    state = change.ChangeState()
    got = [state.update(p, k) for k, p in enumerate([0.4, 0.6, 0.55, 0.3, 0.85, 0.85])]
    assert got == [None, None, None, None, None, 5]
    again = change.ChangeState()
    for k, p in enumerate([0.4, 0.6, 0.55]):
        again.update(p, k)
    resumed = change.ChangeState(previous=again.previous, run=again.run)
    assert resumed.change == pytest.approx(again.change) and [resumed.update(p, k) for k, p in ((3, 0.3), (4, 0.85), (5, 0.85))] == [None, None, 5]


def test_unmixing_and_clusters(spark):
    m = np.array([[1.0, 0, 0], [0, 1.0, 0.5]])
    assert np.allclose(learn.nnls(np.array([[0.3, 0.7, 0.35], [0, 0, 0.0]]), m), [[0.3, 0.7], [0, 0]], atol=1e-5)
    merges = learn.dendrogram(np.array([[0.0], [0.1], [5.0], [5.1]]))
    c = learn.cut(merges, 4, 2)
    assert c.tolist() == [1, 1, 2, 2] and learn.adjusted_rand(c, np.array([1, 1, 2, 2])) == 1


def test_zipper_keeps_ends_and_first(spark):
    t = lambda *days: spark.createDataFrame([("T", date(2020, 1, x)) for x in days], "tile string, date date")
    kept = sorted(r.date.day for r in cube.zipper(t(1, 10, 20), t(3, 5, 10, 15, 20)).collect())
    assert kept == [1, 3, 10, 15, 20]
