"""Networks: gradients against differences, and learning on separable series."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.operators import neural as N

LABELS = ["a", "b", "c"]
MAKE = {
    "cnn": lambda: N.TempCNN(LABELS, filters=8, kernel=3, dense=16, dropout=0.0),
    "residual": lambda: N.ResNet(LABELS, blocks=(8, 8)),
    "attention": lambda: N.Attention(LABELS, np.arange(12) * 16, width=16, heads=2, keys=4, dropout=0.0),
    "light": lambda: N.Attention(LABELS, np.arange(12) * 16, width=16, heads=2, keys=4, dropout=0.0, light=True),
}


def series(n=180):
    g = np.random.default_rng(0)
    y = g.integers(0, 3, n)
    t = np.linspace(0, 1, 12)
    return np.stack([np.sin(2 * np.pi * t * (k + 1)) + g.normal(0, 0.2, 12) for k in y])[:, :, None], y


@pytest.mark.parametrize("name", MAKE)
def test_gradients(name):
    x, _ = series(6)
    net, g = MAKE[name](), np.random.default_rng(1)
    net.drop = lambda v, rate: v
    w = g.normal(0, 1, (6, 3))

    def out():
        net.training, net.values = True, {}
        return net.forward(x)

    out().backward(w)
    grads = {k: v.grad for k, v in net.values.items()}
    for k in list(net.params)[::4]:
        at = tuple(int(g.integers(0, s)) for s in net.params[k].shape)
        sides = []
        for step in (1e-5, -2e-5):
            net.params[k] = net.params[k].copy()
            net.params[k][at] += step
            sides.append((out().data * w).sum())
        net.params[k][at] += 1e-5
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grads[k][at], rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("name", MAKE)
def test_learning(name):
    x, y = series()
    net = N.fit(MAKE[name](), x[:140], y[:140], epochs=80, rate=1e-2)
    assert (net.probabilities(x[140:]).argmax(1) == y[140:]).mean() > 0.85


def test_on_frames(spark):
    x, y = series(120)
    d = spark.createDataFrame([(k, [[float(v[0])] for v in s], LABELS[c]) for k, (s, c) in enumerate(zip(x, y, strict=True))], "sample_id long, x array<array<double>>, label string")
    net = N.train(d, lambda labels: N.TempCNN(labels, filters=8, kernel=3, dense=16), epochs=30, rate=1e-2)
    out = N.classify(net, d)
    assert out.where("label = predicted").count() > 110
    assert out.select(F.max(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v) - 1))).first()[0] < 1e-6
    with pytest.raises(ValueError):
        N.train(d, lambda labels: N.TempCNN(labels), max_rows=5)
