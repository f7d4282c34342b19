"""Tables of many rows, files with empty splits, and samples beyond what the driver holds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.operators import accuracy, learn, machines, neighbourhood, neural
from chronotile.plans import registry


def test_pixels_are_not_broadcast(spark, tmp_path):
    g = np.random.default_rng(1)
    cells = [("t", r, c, float(g.normal())) for r in range(6) for c in range(7) if (r, c) != (2, 2)]
    spark.createDataFrame(cells, "tile string, row int, col int, v double").write.parquet(f"{tmp_path}/pixels")
    d = spark.read.parquet(f"{tmp_path}/pixels")
    x = neighbourhood.neighbours(d.select("tile", "row", "col"), d, 3, ["v"])
    assert "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    got = {(r.row, r.col): [(n["_r"], n["_c"], n.v) for n in r.neighbors] for r in x.collect()}
    assert got == {(r, c): [(i, j, v) for _, i, j, v in cells if abs(i - r) <= 1 and abs(j - c) <= 1] for _, r, c, _ in cells}


def blobs(spark, n=900):
    g = np.random.default_rng(2)
    rows = [(k, float(6 * (k % 3) + g.normal(0, 0.4)), float(g.normal(0, 0.4)), "abc"[k % 3]) for k in range(n)]
    return spark.createDataFrame(rows, "sample_id long, x double, y double, label string")


def with_empty_parts(df):
    """As the splits of a file whose rows are in few groups."""
    spark = df.sparkSession
    return spark.createDataFrame(df.rdd.union(spark.sparkContext.parallelize([], 3)), df.schema)


def test_a_map_of_parts_without_rows(spark):
    d = with_empty_parts(blobs(spark))
    som = learn.Som.fit(d, ["x", "y"], 3, 3, 4)
    assert np.allclose(som.codes, learn.Som.fit(blobs(spark), ["x", "y"], 3, 3, 4).codes)
    for r in som.map(d.withColumn("y", F.when(F.col("sample_id") != 5, F.col("y"))), ["x", "y"]).collect():
        far = np.sqrt(((som.codes - [r.x, r.y if r.y is not None else np.nan]) ** 2).sum(1))
        assert (r.neuron, r.distance) == (1, None) if r.sample_id == 5 else r.neuron == far.argmin() + 1 and r.distance == pytest.approx(far.min())


def test_clusters_of_parts_without_rows(spark):
    out = learn.cluster_dendro(with_empty_parts(blobs(spark)), ["x", "y"], max_rows=50).toPandas()
    assert len(out) == 900 and out.groupby("label").cluster.nunique().max() == 1 and out.cluster.nunique() == 3


def test_purity_of_parts_without_rows(spark):
    d = with_empty_parts(blobs(spark))
    out = accuracy.purity(learn.Som.fit(d, ["x", "y"], 2, 3, 4).map(d, ["x", "y"]), "neuron", "label").collect()
    assert {r.label for r in out} == set("abc")


def test_undersampling_of_parts_without_rows(spark):
    d = with_empty_parts(blobs(spark))
    out = learn.som_undersample(learn.Som.fit(d, ["x", "y"], 2, 3, 4).map(d, ["x", "y"]), 4).toPandas()
    assert set(out.label) == set("abc") and out.groupby(["label", "neuron"]).size().max() == 4


def test_balance_of_parts_without_rows(spark):
    n = {r.label: r["count"] for r in learn.reduce_imbalance(with_empty_parts(blobs(spark)), ["x", "y"], 40, 64, rounds=3).groupBy("label").count().collect()}
    assert set(n) == set("abc") and all(16 <= v <= 64 for v in n.values())


def test_machines_of_any_number_of_samples(spark):
    """Rings, which one line can't part; one label has a single sample."""
    g = np.random.default_rng(2)
    x = g.normal(0, 1, (1500, 2))
    rows = [(k, float(a), float(b), "in" if a * a + b * b < 1 else "out") for k, (a, b) in enumerate(x)] + [(9000, 40.0, 40.0, "far")]
    d = spark.createDataFrame(rows, "sample_id long, x double, y double, label string")
    m = machines.train(d, ["x", "y"], block=400)
    out = machines.classify(m, d).collect()
    assert len(m.machines) == 4 and m.labels == ["far", "in", "out"] and np.mean([r.predicted == r.label for r in out]) > 0.93
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in out) and len(out) == 1501
    one = machines.train(d, ["x", "y"])
    assert np.mean([a.predicted == b.predicted for a, b in zip(out, machines.classify(one, d).collect(), strict=True)]) > 0.95


def test_samples_stream_by_an_online_map(spark):
    d = with_empty_parts(blobs(spark))
    som = learn.Som.online(d, ["x", "y"], 2, 3, 6, resident=100)
    assert som.codes.shape == (6, 2) and np.array_equal(som.codes, learn.Som.online(blobs(spark).repartition(3), ["x", "y"], 2, 3, 6, resident=100).codes)
    out = som.map(d, ["x", "y"]).toPandas()
    assert len(out) == 900 and out.groupby("neuron").label.nunique().max() == 1 and out.distance.mean() < 1.0


def test_places_that_differ_in_the_last_bits(spark, tmp_path):
    """Longitudes of 31.3 and 1.3 degrees, by the rest of 30, at one latitude."""
    at = lambda k: (k * 37 % 997, k * 53 % 199)
    keys = {at(k): k for k in range(997 * 199)}
    pair = [keys[13, 50], keys[313, 50], keys[100, 50]]
    spark.createDataFrame([(k, "m") for k in pair], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.sample_id: r.distance for r in registry.QUERIES["geo_distances"](spark, str(tmp_path)).collect()}
    assert 313 / 10 % 30 != 13 / 10 and got[pair[0]] == got[pair[1]] == 0.0 and got[pair[2]] > 900


@pytest.mark.parametrize("name", ["rectified", "convolution", "residual", "attention", "light"])
def test_networks_over_parts(spark, name):
    """Of more samples than the driver holds, all train, in parts."""
    make = {
        "rectified": lambda labels: neural.Perceptron(labels, (16,), (0.1,)),
        "convolution": lambda labels: neural.TempCNN(labels, filters=8, kernel=3, dense=16),
        "residual": lambda labels: neural.ResNet(labels, blocks=(8,)),
        "attention": lambda labels: neural.Attention(labels, np.arange(12) * 16, width=16, heads=2, keys=4),
        "light": lambda labels: neural.Attention(labels, np.arange(12) * 16, width=16, heads=2, keys=4, light=True),
    }[name]
    g = np.random.default_rng(0)
    y, t = g.integers(0, 3, 600), np.linspace(0, 1, 12)
    rows = [(k, [[float(v)] for v in np.sin(2 * np.pi * t * (c + 1)) + g.normal(0, 0.2, 12)], "abc"[c]) for k, c in enumerate(y)]
    d = spark.createDataFrame(rows, "sample_id long, x array<array<double>>, label string")
    net = neural.train(d, make, resident=100, part=200, epochs=12, rate=1e-2)
    assert neural.classify(net, d).where("label = predicted").count() > 540


def _networks(name):
    return {
        "residual": neural.ResNet(["a", "b"], blocks=(8, 8)),
        "attention": neural.Attention(["a", "b"], np.arange(12) * 16, width=16, heads=2, keys=4),
    }[name]


@pytest.mark.parametrize("name", ["attention", "residual"])
def test_networks_predict_in_blocks(name):
    """A computation holds all its arrays, so a batch of any number of series goes through in blocks."""
    net, seen, x = _networks(name), [], np.random.default_rng(3).normal(0, 1, (2500, 12, 1))
    net.training = True
    net.forward(x[:64])
    forward, net.values = net.forward, {}
    net.training = False
    whole = neural.softmax(forward(x)).data
    net.forward = lambda v: seen.append(len(v)) or forward(v)
    assert np.allclose(net.probabilities(x), whole, atol=1e-12) and sum(seen) == 2500 and max(seen) <= 1000
    assert net.probabilities(x[:0]).shape == (0, 2)


def test_parts_of_samples_are_a_file_each(spark, monkeypatch):
    """Else the tasks of an epoch would get several parts or none."""
    seen = []
    monkeypatch.setattr(neural, "fit_parts", lambda parts, network, **p: seen.append((parts.count(), [len(r.folds) for r in parts.groupBy(F.input_file_name().alias("f")).agg(F.collect_set("fold").alias("folds")).collect()])) or network)
    rows = [(k, [[float(k % 7)]] * 3, "ab"[k % 2]) for k in range(900)]
    d = spark.createDataFrame(rows, "sample_id long, x array<array<double>>, label string")
    neural.train(d, lambda labels: neural.Perceptron(labels, (4,), (0.1,)), resident=10, part=60)
    assert seen == [(15, [1] * 15)]


@pytest.mark.parametrize("name", ["reduce_imbalance", "som_evaluate", "som_undersample"])
def test_queries_over_a_file_of_one_row_group(spark, tmp_path, name):
    """Splits of the file beyond its only row group hold no row."""
    x = np.random.default_rng(4).normal(0, 1, (640, 64))
    label = np.repeat([0, 1, 2], [230, 205, 205])
    x[np.arange(640), label] = x[:, :3].max(1) + 0.1
    rows = [(k, [float(v) for v in row], 0) for k, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "32k")
        assert 0 in spark.read.parquet(f"{tmp_path}/embeddings.parquet").rdd.glom().map(len).collect()
        out = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if name == "reduce_imbalance":  # of A alone there are 210 or more
        n = dict(zip(out.label, out.n, strict=True))
        assert n.keys() == set("ABC") and n["B"] == n["C"] == 205 and 64 < n["A"] <= 230
    elif name == "som_evaluate":
        assert set(out.label) == set("ABC") and np.allclose(out.groupby("neuron").percent.sum(), 100, atol=1e-4)
    else:
        assert out.sample_id.is_unique and out.groupby(["label", "neuron"]).size().max() == 4
        assert all("ABC"[label[k]] == c for k, c in zip(out.sample_id, out.label, strict=True))


def test_a_residual_network_of_more_samples_than_the_driver_holds(spark):
    """By the parameters that the query leaves as they are."""
    x = F.when(F.col("sample_id") % 2 == 0, 1.0).otherwise(-1.0) + F.col("sample_id") % 10 / 20
    d = spark.range(100_500).withColumnRenamed("id", "sample_id").select("sample_id", F.array(F.array(x), F.array(-x)).alias("x"), F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b").alias("label"))
    net = neural.train(d, lambda labels: neural.ResNet(labels, blocks=(2,)), epochs=1, rate=1e-2)
    out = neural.classify(net, d)
    assert out.count() == 100_500 and out.where("label = predicted").count() > 98_000
