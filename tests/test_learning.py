"""Classifiers, segments, quantiles, warping and change detection against plain versions."""

from __future__ import annotations

import itertools
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.operators import accuracy, boosting, change, cube, learn, machines, neural, sampling
from chronotile.operators import series as S
from chronotile.operators.quantiles import quantiles
from chronotile.sources import sinks


def test_quantiles_of_groups(spark):
    g = np.random.default_rng(1)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in [*g.normal(0, 10, 400), *[3.5] * 300]] + [("c", 7.0), ("d", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in quantiles(d, "v", shares, ["k"]).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for i, v in rows if i == k and v is not None], shares))
    assert np.allclose(quantiles(d, "v", shares).first().q, np.quantile([v for _, v in rows if v is not None], shares))
    assert quantiles(d.where("k = 'd'"), "v", shares).count() == 0


def test_changes_equal_those_of_the_state_machine(spark):
    g = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(120):
        p = g.choice([0.1, 0.3, 0.45, 0.5, 0.55, 0.7, 0.9], 12).tolist()
        days = [date(2020, 1, 1) + timedelta(days=10 * i) for i in range(12)]
        state = change.ChangeState()
        want[k] = next((at for v, day in zip(p, days, strict=True) if (at := state.update(v, day)) is not None), None)
        rows += [(k, day, v) for v, day in zip(p, days, strict=True)]
    rows.append((500, date(2020, 1, 1), None))
    got = {r.sample_id: r.change for r in change.detect_changes(spark.createDataFrame(rows, "sample_id long, index date, p double"), "p").collect()}
    assert got == want and None in want.values() and sum(v is not None for v in want.values()) > 20


def test_warping_against_a_plain_table(spark):
    def plain(a, b, band):
        n, m = len(a), len(b)
        d = [[float(np.sqrt(((a[i] - b[j]) ** 2).sum())) if band is None or abs(i * m / n - j) <= max(band, abs(n - m)) else np.inf for j in range(m)] for i in range(n)]
        t = [[0.0] * m for _ in range(n)]
        for i, j in itertools.product(range(n), range(m)):
            ways = [t[i - 1][j - 1] + 2 * d[i][j]] * (i > 0 and j > 0) + [t[i - 1][j] + d[i][j]] * (i > 0) + [t[i][j - 1] + d[i][j]] * (j > 0)
            t[i][j] = min(ways, default=d[i][j])
        return t[-1][-1]

    g = np.random.default_rng(5)
    for n, m, band in ((6, 6, None), (9, 4, None), (1, 5, None), (8, 8, 2)):
        x, y = g.normal(0, 1, (7, n, 2)), g.normal(0, 1, (m, 2))
        assert np.allclose(change.dtw_many(x, y, band=band), [plain(s, y, band) for s in x])


def test_overlapping_intervals(spark):
    g = np.random.default_rng(7)
    rows = [(int(g.integers(0, 4)), k, date(2020, 1, 1) + timedelta(days=int(a)), date(2020, 1, 1) + timedelta(days=int(a + n))) for k, (a, n) in enumerate(zip(g.integers(0, 400, 80), g.integers(-3, 150, 80), strict=True))]
    got = [tuple(r) for r in S.overlapping(spark.createDataFrame(rows, "c int, id long, a date, b date"), ["c"], "id", "a", "b", 30).collect()]
    want = [(x[0], x[1], y[1]) for x, y in itertools.combinations(rows, 2) if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(got) == sorted(want)


def test_draws_of_great_keys(spark):
    keys = [0, 1, 3_474_701_532, 2**62, -5]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(sampling.draw("k")).collect()]
    assert got == [k * sampling.MIX % sampling.PRIME for k in keys]


def test_numbers_follow_the_order(spark):
    g = np.random.default_rng(9)
    rows = [(float(x), float(y), date(2020, 1, 1), date(2020, 2, 1), "l") for x, y in zip(g.integers(0, 20, 300), g.normal(0, 1, 300), strict=True)] + [(None, 0.0, date(2020, 1, 1), date(2020, 2, 1), "l")]
    out = sinks.numbered(spark.createDataFrame(rows, "longitude double, latitude double, start_date date, end_date date, label string")).orderBy("id").collect()
    assert [r.id for r in out] == list(range(1, 302)) and [tuple(r)[1:] for r in out] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_pixels_on_another_grid(spark):
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 4.0, 4.0, 1.0, 1.0), ("b", 4.0, 0.0, 8.0, 4.0, 1.0, 1.0)], "tile string, xmin double, ymin double, xmax double, ymax double, xres double, yres double")
    grid = spark.createDataFrame([("X", 2.0, 1.0, 6.0, 4.0, 0.5, 0.5), ("Y", 20.0, 0.0, 21.0, 1.0, 0.5, 0.5)], tiles.schema)
    rows = [(t, "B", date(2020, 1, 1), r, c, float(100 * (t == "b") + 10 * r + c)) for t in "ab" for r in range(4) for c in range(4)]
    out = {(r.row, r.col): (r.tile, r.value) for r in cube.retile_pixels(spark.createDataFrame(rows, "tile string, band string, date date, row int, col int, value double"), tiles, grid).collect()}
    assert len(out) == 48
    for (r, c), (t, v) in out.items():
        x, y = 2 + (c + 0.5) * 0.5, 4 - (r + 0.5) * 0.5
        assert t == "X" and v == 100 * (x > 4) + 10 * int(4 - y) + int(x - 4 * (x > 4))


def labelled(spark, n=600):
    g = np.random.default_rng(2)
    x = g.normal(0, 1, (n, 3))
    label = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 < 1, "in", np.where(x[:, 2] > 0, "up", "down"))
    return spark.createDataFrame([(k, *map(float, r), str(c)) for k, (r, c) in enumerate(zip(x, label, strict=True))], "sample_id long, a double, b double, c double, label string")


def test_boosted_trees_of_three_classes(spark):
    d = labelled(spark)
    m = boosting.train(d.where("sample_id < 450"), ["a", "b", "c"], rounds=12, depth=3, rate=0.4, bins=32)
    out = boosting.classify(m, d.where("sample_id >= 450").withColumn("a", F.when(F.col("sample_id") != 599, F.col("a")))).collect()
    assert np.mean([r.predicted == r.label for r in out]) > 0.85 and all(abs(sum(r.probs) - 1) < 1e-9 for r in out)
    again = boosting.train(d.where("sample_id < 450"), ["a", "b", "c"], rounds=2, depth=3, rate=0.4, bins=32)
    assert all((x[0] == y[0]).all() and np.allclose(x[2], y[2]) for t, u in zip(again.rounds, m.rounds, strict=False) for x, y in zip(t, u, strict=True))


def test_boosting_stops_when_held_out_loss_does(spark):
    g = np.random.default_rng(4)
    d = spark.createDataFrame([(k, float(g.normal()), str(g.integers(0, 2))) for k in range(200)], "sample_id long, a double, label string")
    assert len(boosting.train(d, ["a"], rounds=40, depth=3, rate=0.9, gamma=0.0, patience=3).rounds) < 10


def test_one_split_against_all_splits():
    g = np.random.default_rng(6)
    sums = np.stack([g.normal(0, 3, (4, 9)), g.random((4, 9)) + 0.5])
    sums[:, 1:] *= (sums[:, :1].sum(2) / sums[:, 1:].sum(2))[..., None]  # every feature has the same totals
    trees = [(np.full(7, -1), np.zeros(7, int), np.zeros(7))]
    boosting._split(trees, {0: sums}, 0, 2, 0.3, 0.0, 1.0, 1.0, 0.0)
    total = sums[:, 0].sum(1)
    best = max((0.5 * (a * a / (h + 1) + (total[0] - a) ** 2 / (total[1] - h + 1)), f, c) for f in range(4) for c in range(8) for a, h in [sums[:, f, : c + 1].sum(1)] if h >= 1 and total[1] - h >= 1)
    assert (trees[0][0][0], trees[0][1][0]) == best[1:] and trees[0][2][0] == pytest.approx(-0.3 * total[0] / (total[1] + 1))


def test_radial_machines_see_rings(spark):
    d = labelled(spark)
    m = machines.train(d, ["a", "b", "c"])
    out = machines.classify(m, d).collect()
    assert np.mean([r.predicted == r.label for r in out]) > 0.93 and all(abs(sum(r.probs) - 1) < 1e-9 for r in out)
    with pytest.raises(ValueError):
        machines.train(d, ["a", "b", "c"], max_rows=100)


def test_multipliers_are_optimal():
    """The conditions of the greatest dual value: no multiplier can move inwards to gain."""
    g = np.random.default_rng(8)
    x = g.normal(0, 1, (60, 2))
    y = np.where(x[:, 0] * x[:, 1] > 0, 1.0, -1.0)
    k = machines.kernel(x, x, 0.5) + 1
    a = machines.dual(k, y, 5.0)
    slope = (k * y[:, None] * y[None]) @ a - 1
    assert (slope[a <= 0] > -1e-3).all() and (slope[a >= 5] < 1e-3).all() and (np.abs(slope[(a > 0) & (a < 5)]) < 1e-3).all()


def test_rectified_perceptron():
    g = np.random.default_rng(2)
    x = g.normal(0, 1, (500, 2, 2))
    y = (np.abs(x[:, 0, 0]) + np.abs(x[:, 1, 1]) < 1.2).astype(int)
    net = neural.fit(neural.Perceptron(["0", "1"], (32, 32), (0.1, 0.1)), x[:400], y[:400], epochs=80, rate=5e-3)
    assert (net.probabilities(x[400:]).argmax(1) == y[400:]).mean() > 0.9
    with pytest.raises(ValueError):
        neural.Perceptron(["0", "1"], (32,), (0.1, 0.2))


def test_balance_by_the_map(spark):
    g = np.random.default_rng(3)
    rows = [(k, float(g.normal(3 * (k % 4), 0.2)), float(g.normal()), "rich") for k in range(400)] + [(1000 + k, 50.0 + k, 0.0, "poor") for k in range(12)] + [(2000 + k, 90.0, float(k), "fair") for k in range(50)]
    out = learn.reduce_imbalance(spark.createDataFrame(rows, "sample_id long, a double, b double, label string"), ["a", "b"], 40, 64, rounds=5).toPandas()
    n = out.label.value_counts()
    assert n["poor"] == 40 and n["fair"] == 50 and 16 <= n["rich"] <= 64
    assert all((abs(out[out.label == "rich"].a - 3 * c) < 1).any() for c in range(4))  # every part of the map is kept


def test_segments_do_not_depend_on_chunks(spark):
    g = np.random.default_rng(1)
    rows = [(t, r, c, float(10 * ((r // 9 + c // 11) % 2) + g.normal(0, 0.1)) if (r, c) != (3, 3) else None) for t in "ab" for r in range(30) for c in range(34)]
    d = spark.createDataFrame(rows, "tile string, row int, col int, v double")
    runs = [{(r.tile, r.row, r.col): r.pol_id for r in learn.segment(d, ["v"], step=6, compactness=2.0, rounds=3, chunk=chunk).collect()} for chunk in (7, 16, 64)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2 * 30 * 34 and 10 < len(set(runs[0].values())) <= 30


def test_intervals_of_accuracy(spark):
    for hits, n, want in ((8, 10, (0.4439045, 0.9747893)), (0, 20, (0.0, 0.1684335)), (20, 20, (0.8315665, 1.0)), (450, 500, (0.8702919, 0.9248623))):
        assert accuracy.binomial_interval(hits, n) == pytest.approx(want, abs=1e-3 if n == 500 else 1e-6)
    t = spark.createDataFrame([("a", "a", 5), ("a", "b", 2), ("b", "b", 3)], "predicted string, reference string, n long")
    r = accuracy.overall_interval(t).first()
    assert r.accuracy == pytest.approx(0.8) and (r.lower, r.upper) == pytest.approx((0.4439045, 0.9747893)) and r.no_information == 0.5


def test_segments_count_once(spark):
    segments = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, "b")], "tile string, pol_id long, label string")
    points = spark.createDataFrame([("t", 1, "a"), ("t", 1, "a"), ("t", 2, "a"), ("t", 2, "b"), ("t", 9, "b")], "tile string, pol_id long, reference string")
    assert {tuple(r) for r in accuracy.segment_confusion(segments, points).collect()} == {("a", "a", 1), ("b", "a", 1), ("b", "b", 1)}


def test_splines_follow_a_season(spark):
    """Cross-validation smooths noise away, and keeps a season; a straight line stays one."""
    g = np.random.default_rng(4)
    days = [date(2020, 1, 1) + timedelta(days=8 * i) for i in range(46)]
    season = [float(np.sin(2 * np.pi * i / 46)) for i in range(46)]
    rows = [("wave", d, s + float(g.normal(0, 0.3))) for _ in range(30) for d, s in zip(days, season, strict=True)]
    rows += [("line", d, 2.0 + 0.1 * i) for i, d in enumerate(days)]
    out = learn.smooth_patterns(spark.createDataFrame(rows, "label string, index date, v double"), ["v"], 8).toPandas()
    wave, line = (out[out.label == x].sort_values("index").v.to_numpy() for x in ("wave", "line"))
    assert np.abs(wave - season).max() < 0.12 and np.allclose(line, 2 + 0.1 * np.arange(46), atol=1e-6)


def test_clusters_of_many_samples(spark):
    """Beyond max_rows the tree is over neurons, and every sample has its neuron's cluster."""
    g = np.random.default_rng(11)
    rows = [(k, float(8 * (k % 3) + g.normal(0, 0.5)), float(g.normal(0, 0.5)), "abc"[k % 3]) for k in range(700)]
    d = spark.createDataFrame(rows, "sample_id long, x double, y double, label string")
    for most in (50, 1000):
        out = learn.cluster_dendro(d, ["x", "y"], max_rows=most).toPandas()
        assert len(out) == 700 and out.groupby("label").cluster.nunique().max() == 1 and out.cluster.nunique() == 3
