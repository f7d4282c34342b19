"""Neural classifiers of time series: temporal convolutions, residual networks and temporal attention.

Networks are written over a small reverse-mode differentiator on arrays and trained by Adam: on the driver up to `resident`
samples; of more, every epoch goes over parts of them in tasks, whose networks are averaged. A trained network is broadcast and predicts series batch by
batch. Series are arrays (dates, bands), all of one length, already normalised.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written
from . import sampling


class Value:
    """An array in a computation, with what it was made of and how its gradient goes back."""

    __slots__ = ("data", "grad", "parts", "back")

    def __init__(self, data: np.ndarray, parts: tuple = (), back: Callable | None = None):
        self.data, self.grad, self.parts, self.back = data, None, parts, back

    def add(self, g: np.ndarray) -> None:
        while g.ndim > self.data.ndim:
            g = g.sum(0)
        for k, n in enumerate(self.data.shape):
            if n == 1 and g.shape[k] != 1:
                g = g.sum(k, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g

    def backward(self, g: np.ndarray) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parts]
        self.add(g)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                v.back(v.grad)


def plus(a: Value, b: Value) -> Value:
    return Value(a.data + b.data, (a, b), lambda g: (a.add(g), b.add(g)))


def times(a: Value, b: Value) -> Value:
    return Value(a.data * b.data, (a, b), lambda g: (a.add(g * b.data), b.add(g * a.data)))


def matmul(a: Value, b: Value) -> Value:
    if b.data.ndim == 2 and a.data.ndim > 2:  # one product of all rows, instead of a small one for each series
        flat = a.data.reshape(-1, a.data.shape[-1])

        def back(g: np.ndarray) -> None:
            rows = g.reshape(-1, g.shape[-1])
            a.add((rows @ b.data.T).reshape(a.data.shape))
            b.add(flat.T @ rows)

        return Value((flat @ b.data).reshape(*a.data.shape[:-1], b.data.shape[-1]), (a, b), back)
    return Value(a.data @ b.data, (a, b), lambda g: (a.add(g @ np.swapaxes(b.data, -1, -2)), b.add(np.swapaxes(a.data, -1, -2) @ g)))


def relu(a: Value) -> Value:
    on = a.data > 0
    return Value(a.data * on, (a,), lambda g: a.add(g * on))


def transpose(a: Value) -> Value:
    return Value(np.swapaxes(a.data, -1, -2), (a,), lambda g: a.add(np.swapaxes(g, -1, -2)))


def reshape(a: Value, *shape: int) -> Value:
    return Value(a.data.reshape(shape), (a,), lambda g: a.add(g.reshape(a.data.shape)))


def mean(a: Value, axis: int) -> Value:
    n = a.data.shape[axis]
    return Value(a.data.mean(axis), (a,), lambda g: a.add(np.repeat(np.expand_dims(g, axis), n, axis) / n))


def softmax(a: Value) -> Value:
    e = np.exp(a.data - a.data.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    return Value(p, (a,), lambda g: a.add(p * (g - (g * p).sum(-1, keepdims=True))))


def standard(a: Value, axes: tuple[int, ...], running: list, training: bool) -> Value:
    """Zero mean and unit variance over axes; running keeps both for prediction. running None: each row's own."""
    if running is None or training:
        m, v = a.data.mean(axes, keepdims=True), a.data.var(axes, keepdims=True)
        if running is not None:
            running[0], running[1] = (m, v) if running[0] is None else (0.9 * running[0] + 0.1 * m, 0.9 * running[1] + 0.1 * v)
        s = 1 / np.sqrt(v + 1e-5)
        x = (a.data - m) * s
        return Value(x, (a,), lambda g: a.add(s * (g - g.mean(axes, keepdims=True) - x * (g * x).mean(axes, keepdims=True))))
    s = 1 / np.sqrt(running[1] + 1e-5)
    return Value((a.data - running[0]) * s, (a,), lambda g: a.add(g * s))


def unfold(a: Value, k: int) -> Value:
    """(n, t, c) to (n, t, k c): each place's neighbourhood, zeros beyond the ends."""
    n, t, c = a.data.shape
    left = k // 2
    padded = np.pad(a.data, ((0, 0), (left, k - 1 - left), (0, 0)))
    out = np.concatenate([padded[:, i : i + t] for i in range(k)], 2)

    def back(g: np.ndarray) -> None:
        full = np.zeros_like(padded)
        for i in range(k):
            full[:, i : i + t] += g[:, :, i * c : (i + 1) * c]
        a.add(full[:, left : left + t])

    return Value(out, (a,), back)


class Network:
    """Parameters by name, and a function that applies them."""

    def __init__(self, seed: int = 1):
        self.params: dict[str, np.ndarray] = {}
        self.running: dict[str, list] = {}
        self.random, self.training, self.dropout = np.random.default_rng(seed), True, 0.0
        self.values: dict[str, Value] = {}
        self.labels: list[str] = []

    def p(self, name: str, *shape: int, scale: float | None = None) -> Value:
        if name not in self.params:
            fan = shape[0] if len(shape) > 1 else 1
            self.params[name] = self.random.normal(0, scale if scale is not None else np.sqrt(2 / fan), shape) if scale != 0 else np.zeros(shape)
        if name not in self.values:
            self.values[name] = Value(self.params[name])
        return self.values[name]

    def dense(self, x: Value, name: str, out: int) -> Value:
        return plus(matmul(x, self.p(f"{name}.w", x.data.shape[-1], out)), self.p(f"{name}.b", out, scale=0))

    def norm(self, x: Value, name: str) -> Value:
        axes = tuple(range(x.data.ndim - 1))
        y = standard(x, axes, self.running.setdefault(name, [None, None]), self.training)
        one = self.p(f"{name}.s", x.data.shape[-1], scale=0)
        return plus(plus(y, times(y, one)), self.p(f"{name}.o", x.data.shape[-1], scale=0))

    def layer_norm(self, x: Value) -> Value:
        return standard(x, (x.data.ndim - 1,), None, self.training)

    def drop(self, x: Value, rate: float) -> Value:
        if not self.training or rate <= 0:
            return x
        keep = (self.random.random(x.data.shape) >= rate) / (1 - rate)
        return Value(x.data * keep, (x,), lambda g: x.add(g * keep))

    def conv(self, x: Value, name: str, out: int, kernel: int) -> Value:
        return self.dense(unfold(x, kernel), name, out)

    def forward(self, x: np.ndarray) -> Value:
        raise NotImplementedError

    def probabilities(self, x: np.ndarray, block: int = 1000) -> np.ndarray:
        """Block by block, as a computation holds all its arrays."""
        self.training, self.values = False, {}
        return np.concatenate([np.zeros((0, len(self.labels))), *(softmax(self.forward(x[k : k + block])).data for k in range(0, len(x), block))])


class Perceptron(Network):
    """Dense layers, each rectified and with its own dropout, over all dates and bands at once."""

    def __init__(self, labels: list[str], layers: tuple[int, ...] = (512, 512, 512), dropout: tuple[float, ...] = (0.2, 0.3, 0.4), seed: int = 1):
        if len(layers) != len(dropout):
            raise ValueError("each layer needs its dropout")
        super().__init__(seed)
        self.labels, self.layers, self.rates = labels, layers, dropout

    def forward(self, x: np.ndarray) -> Value:
        v = Value(x.reshape(len(x), -1))
        for k, (units, rate) in enumerate(zip(self.layers, self.rates, strict=True)):
            v = self.drop(relu(self.dense(v, f"d{k}", units)), rate)
        return self.dense(v, "out", len(self.labels))


class TempCNN(Network):
    """Three convolutions over time, each with normalisation and dropout, then a dense layer."""

    def __init__(self, labels: list[str], filters: int = 64, kernel: int = 5, dense: int = 256, dropout: float = 0.2, seed: int = 1):
        super().__init__(seed)
        self.labels, self.filters, self.kernel, self.units, self.dropout = labels, filters, kernel, dense, dropout

    def forward(self, x: np.ndarray) -> Value:
        v = Value(x)
        for k in range(3):
            v = self.drop(relu(self.norm(self.conv(v, f"c{k}", self.filters, self.kernel), f"n{k}")), self.dropout)
        v = reshape(v, len(x), -1)
        v = self.drop(relu(self.norm(self.dense(v, "d", self.units), "dn")), 0.5)
        return self.dense(v, "out", len(self.labels))


class ResNet(Network):
    """Blocks of three convolutions with a shortcut, then the mean over time."""

    def __init__(self, labels: list[str], blocks: tuple[int, ...] = (64, 128, 128), kernels: tuple[int, ...] = (7, 5, 3), seed: int = 1):
        super().__init__(seed)
        self.labels, self.blocks, self.kernels = labels, blocks, kernels

    def forward(self, x: np.ndarray) -> Value:
        v = Value(x)
        for b, width in enumerate(self.blocks):
            short = self.norm(self.conv(v, f"s{b}", width, 1), f"sn{b}")
            for k, size in enumerate(self.kernels):
                v = self.norm(self.conv(v, f"b{b}c{k}", width, size), f"b{b}n{k}")
                v = relu(v) if k < len(self.kernels) - 1 else v
            v = relu(plus(v, short))
        return self.dense(mean(v, 1), "out", len(self.labels))


def positions(days: np.ndarray, width: int, base: float = 1000.0) -> np.ndarray:
    angle = days[:, None] / base ** (2 * (np.arange(width) // 2) / width)
    return np.where(np.arange(width) % 2 == 0, np.sin(angle), np.cos(angle))


class Attention(Network):
    """An encoder of each date, places in time by days since the first, several heads of attention, and a decoder.

    light: each head has its own share of the channels and one learnt query, with layer norms.
    """

    def __init__(self, labels: list[str], days: np.ndarray, width: int = 128, heads: int = 4, keys: int = 32, light: bool = False, dropout: float = 0.2, seed: int = 1):
        super().__init__(seed)
        self.labels, self.days, self.width, self.heads, self.keys, self.light, self.dropout = labels, np.asarray(days, float), width, heads, keys, light, dropout

    def forward(self, x: np.ndarray) -> Value:
        v = Value(x)
        for k, units in enumerate((32, 64, self.width)):
            v = relu(self.norm(self.dense(v, f"e{k}", units), f"en{k}"))
        if self.light:
            v = self.layer_norm(v)
        v = plus(v, Value(positions(self.days, self.width)))
        heads = []
        for h in range(self.heads):
            key = self.dense(v, f"k{h}", self.keys)
            query = self.p(f"q{h}", self.keys, 1, scale=self.keys**-0.5) if self.light else transpose(reshape(mean(self.dense(v, f"q{h}", self.keys), 1), len(x), 1, self.keys))
            score = transpose(matmul(key, query))
            weight = softmax(times(score, Value(np.array(self.keys**-0.5))))
            own = self.dense(v, f"v{h}", self.width // self.heads) if self.light else v
            heads.append(reshape(matmul(self.drop(weight, self.dropout), own), len(x), -1))
        total = None
        for h, out in enumerate(heads):
            part = matmul(out, self.p(f"m{h}", out.data.shape[-1], self.width))
            total = part if total is None else plus(total, part)
        v = relu(self.norm(total, "mn"))
        if self.light:
            v = self.layer_norm(v)
        for k, units in enumerate((64, 32)):
            v = relu(self.norm(self.dense(v, f"d{k}", units), f"dn{k}"))
        return self.dense(v, "out", len(self.labels))


def _held(y: np.ndarray, validation: float, g: np.random.Generator) -> np.ndarray:
    """A share of each class's rows."""
    held = np.zeros(len(y), bool)
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        held[g.permutation(at)[: round(validation * len(at))]] = True
    return held


def _epoch(network: Network, x: np.ndarray, y: np.ndarray, order: np.ndarray, m: dict, s: dict, step: int, batch: int, rate: float, decay: float) -> int:
    """Steps of Adam over the rows in this order; returns the number of steps so far."""
    for k in range(0, len(order), batch):
        rows = order[k : k + batch]
        if len(rows) < 2 and k:
            continue
        network.training, network.values = True, {}
        out = network.forward(x[rows])
        p = np.exp(out.data - out.data.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows]] -= 1
        out.backward(p / len(rows))
        step += 1
        for name, v in network.values.items():
            if v.grad is None:
                continue
            m[name] = 0.9 * m.get(name, 0) + 0.1 * v.grad
            s[name] = 0.999 * s.get(name, 0) + 0.001 * v.grad**2
            network.params[name] = network.params[name] - rate * (m[name] / (1 - 0.9**step) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8) + decay * network.params[name])
    return step


def _losses(network: Network, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(network.probabilities(x)[np.arange(len(y)), y], 1e-12))


def fit(network: Network, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, validation: float = 0.2, patience: int = 20, least: float = 0.01, seed: int = 1) -> Network:
    """Adam on cross-entropy; stops when the loss on held-out rows hasn't gone down by `least` for `patience` epochs."""
    g = np.random.default_rng(seed)
    held = _held(y, validation, g)
    train, test = np.flatnonzero(~held), np.flatnonzero(held)
    m: dict[str, np.ndarray] = {}
    s: dict[str, np.ndarray] = {}
    best, waited, step, kept = np.inf, 0, 0, None
    for _ in range(epochs):
        step = _epoch(network, x, y, g.permutation(train), m, s, step, batch, rate, decay)
        if len(test):
            loss = _losses(network, x[test], y[test]).mean()
            if loss < best - least:
                best, waited, kept = loss, 0, (dict(network.params), {k: list(v) for k, v in network.running.items()})
            else:
                waited += 1
                if waited >= patience:
                    break
    if kept is not None:
        network.params, network.running = kept
    network.values = {}
    return network


def fit_parts(parts: DataFrame, network: Network, epochs: int = 60, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, validation: float = 0.2, patience: int = 20, least: float = 0.01, seed: int = 1) -> Network:
    """`fit` over parts (fold, x, y: pickled arrays): each epoch every part goes on from the common network, and parameters, running
    statistics and moments are averaged by the parts' rows."""
    spark = parts.sparkSession
    first = pickle.loads(parts.orderBy("fold").select("x").first()[0])
    network.forward(first[:2])  # makes the parameters
    network.running, network.values = {}, {}
    m: dict = {}
    s: dict = {}
    best, waited, step, kept = np.inf, 0, 0, None
    for t in range(epochs + 1):  # the last pass only tells the loss of the one before
        shared = spark.sparkContext.broadcast(pickle.dumps((network, m, s, step)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, t=t) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for fold, x, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    net, m, s, step = pickle.loads(shared.value)
                    x, y = pickle.loads(x), pickle.loads(y)
                    held = _held(y, validation, np.random.default_rng((seed, fold)))
                    loss = float(_losses(net, x[held], y[held]).sum()) if t and held.any() else 0.0
                    if t < epochs:
                        g = np.random.default_rng((seed, fold, t))
                        net.random = g
                        step = _epoch(net, x, y, g.permutation(np.flatnonzero(~held)), m, s, step, batch, rate, decay)
                    n = int((~held).sum())
                    sums = {"params": net.params, "m": m, "s": s} | {f"running{k}": {name: v[k] for name, v in net.running.items()} for k in (0, 1)}
                    made = pickle.dumps({part: {name: n * v for name, v in d.items()} for part, d in sums.items()})
                    yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([int(held.sum())], pa.int64()), pa.array([step], pa.int64()), pa.array([made], pa.binary())], names=["fold", "n", "loss", "held", "step", "made"])

        out = parts.mapInArrow(run, "fold int, n long, loss double, held long, step long, made binary").collect()  # a network for each part
        shared.unpersist()
        out = sorted(out, key=lambda r: r["fold"])  # sums don't depend on which task ends first
        if t and sum(r["held"] for r in out):
            loss = sum(r["loss"] for r in out) / sum(r["held"] for r in out)
            if loss < best - least:
                best, waited, kept = loss, 0, (dict(network.params), {k: list(v) for k, v in network.running.items()})
            else:
                waited += 1
                if waited >= patience:
                    break
        if t < epochs:
            n, total = sum(r["n"] for r in out), {}
            for r in out:
                for part, d in pickle.loads(r["made"]).items():
                    of = total.setdefault(part, {})
                    for name, v in d.items():
                        of[name] = of[name] + v if name in of else v
            mean = {part: {name: v / n for name, v in d.items()} for part, d in total.items()}
            network.params, m, s, step = mean["params"], mean["m"], mean["s"], max(r["step"] for r in out)
            network.running = {name: [v, mean["running1"][name]] for name, v in mean["running0"].items()}
    if kept is not None:
        network.params, network.running = kept
    network.values = {}
    return network


def train(df: DataFrame, make: Callable[[list[str]], Network], series: str = "x", label: str = "label", max_rows: int | None = None, key: str = "sample_id", resident: int = 20_000, part: int = 10_000, **parameters) -> Network:
    """Fits a network to the samples; series: an array (dates) of arrays (bands). More than max_rows, where given, is an error.

    The key, which deals samples over parts of about `part`, is needed for more than `resident`.
    """
    n = df.count()
    if max_rows is not None and n > max_rows:
        raise ValueError(f"training takes at most {max_rows} samples")
    array = lambda p: np.array([[list(r) for r in s] for s in p[series]], float)
    if n <= resident:
        p = df.select(series, label).toPandas()
        labels = sorted(p[label].unique())
        return fit(make(labels), array(p), p[label].map(labels.index).to_numpy(), **parameters)
    labels = sorted(r[0] for r in df.select(label).distinct().collect())  # a legend
    k = -(-n // part)

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(key)
        return pd.DataFrame({"fold": [p["fold"].iloc[0]], "x": [pickle.dumps(array(p))], "y": [pickle.dumps(p[label].map(labels.index).to_numpy())]})

    dealt = sampling.folds(df.select(key, series, label), k, key, label).repartition(k, "fold")
    packed = dealt.groupBy("fold").applyInPandas(pack, "fold int, x binary, y binary")
    parts = written(packed.repartitionByRange(k, "fold"), "series")  # a file for each, so that no task of an epoch gets several by chance
    try:
        return fit_parts(parts, make(labels), **parameters)
    finally:
        discard(parts)


def classify(network: Network, df: DataFrame, series: str = "x") -> DataFrame:
    """Adds probs, in the order of the network's labels, and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(network)  # the parameters of one network

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for part in batches:
            x = np.array([[list(r) for r in s] for s in part[series]], float)
            p = net.probabilities(x)
            yield part.drop(columns=[series]).assign(probs=list(p), predicted=[net.labels[k] for k in p.argmax(1)] if len(part) else [])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != series)
    return df.mapInPandas(run, f"{fields}, probs array<double>, predicted string")


def series_of(df: DataFrame, bands: list[str], keys: list[str], index: str = "index") -> DataFrame:
    """keys and x, each sample's values in time order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, F.array(*(F.col(b).cast("double") for b in bands)).alias("v")))).alias("_s")).select(*keys, F.col("_s.v").alias("x"))
