"""Gradient-boosted trees of several classes under one soft-max objective, grown by distributed histograms.

Features fall into bins by their quantiles. For each level of a round's trees (one for each class) a pass over the rows adds
gradients and curvatures by class, node, feature and bin; tasks send sums alone, which are added before the driver picks each
node's best split by the regularised gain. Held-out rows' loss stops the rounds early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, written
from . import sampling


class Trees:
    """Rounds of trees as arrays in heap order: feature (-1: a leaf), last bin that goes left, and weight of each node."""

    def __init__(self, labels: list[str], features: list[str], edges: list[np.ndarray]):
        self.labels, self.features, self.edges = labels, features, edges
        self.rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1; 0 where a value is missing."""
        return np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k], "left") + 1) for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    @staticmethod
    def nodes(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray, depth: int) -> np.ndarray:
        """Each row's node after at most `depth` steps."""
        feature, cut, _ = tree
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = feature[at]
            inner = f >= 0
            right = bins[rows, np.maximum(f, 0)] > cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at

    def margins(self, bins: np.ndarray, depth: int) -> np.ndarray:
        m = np.zeros((len(bins), len(self.labels)))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                m[:, k] += tree[2][self.nodes(tree, bins, depth)]
        return m


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_SUMS = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by slot as rows stream by."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = np.frombuffer(x.as_py(), float)
            held[slot] = held[slot] + v if slot in held else v
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], schema=_SUMS)


def train(
    df: DataFrame, features: list[str], label: str = "label", key: str = "sample_id", rounds: int = 100, rate: float = 0.15, depth: int = 5, gamma: float = 1.0, penalty: float = 1.0,
    min_child: float = 1.0, max_step: float = 1.0, subsample: float = 0.85, bins: int = 64, validation: float = 0.2, patience: int = 20, seed: int = 1,
) -> Trees:
    """Fits trees to df; rows of a null label don't train."""
    spark = df.sparkSession
    d = df.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(label).alias("_label"), *(F.col(f).cast("double").alias(f) for f in features))
    d = sampling.split(d, validation, "_key", "_label", seed) if validation > 0 else d.withColumn("train", F.lit(True))
    labels = sorted(r["_label"] for r in d.select("_label").distinct().collect())  # a legend
    quantiles = d.approxQuantile(features, [k / bins for k in range(1, bins)], 0.25 / bins)
    model = Trees(labels, features, [np.unique(q) for q in quantiles])
    n_classes, width = len(labels), bins + 1

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(3 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(features))], 1)
            y = [labels.index(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, pa.int32()), b.column(2), pa.array([r.tobytes() for r in model.binned(x)], pa.binary())], names=["k", "y", "train", "bins"])

    rows = written(d.select("_key", "_label", "train", *features).mapInArrow(prepare, "k long, y int, train boolean, bins binary"), "boosting-rows")
    best, waited, keep = np.inf, 0, 0
    try:
        for t in range(rounds):
            trees = [(np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1, np.int64), np.zeros(2 ** (depth + 1) - 1)) for _ in labels]
            loss = None
            for level in range(depth + 1):
                sums = _level(rows, spark.sparkContext.broadcast((model, trees)), level, depth, t, subsample, seed, n_classes, len(features), width)
                held = sums.pop(-1, None)
                loss = held if level == 0 else loss
                _split(trees, sums, level, depth, rate, gamma, penalty, min_child, max_step)
            if loss is not None and loss[1] > 0:  # of the rounds before this one
                if loss[0] / loss[1] < best - 1e-9:
                    best, waited, keep = loss[0] / loss[1], 0, t
                else:
                    waited += 1
                    if waited >= patience:
                        break
            model.rounds.append(trees)
        if waited >= patience:
            model.rounds = model.rounds[:keep]
    finally:
        discard(rows)
    model.depth = depth
    return model


def _level(rows: DataFrame, shared, level: int, depth: int, t: int, subsample: float, seed: int, n_classes: int, n_features: int, width: int) -> dict[int, np.ndarray]:
    """By slot, class times the level's nodes plus node: sums (gradient and curvature, features, bins). Slot -1: held-out loss and rows."""
    nodes = 1 << level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, trees = shared.value
        total = np.zeros((n_classes * nodes, 2, n_features * width))
        seen, loss = np.zeros(n_classes * nodes, bool), np.zeros(2)
        for b in batches:
            if not b.num_rows:
                continue
            bins = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, n_features)
            y, learn = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            p = _softmax(model.margins(bins, depth))
            held = ~learn
            loss += [-np.log(np.maximum(p[held, y[held]], 1e-12)).sum(), held.sum()]
            drawn = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 7919 + seed)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)
            learn &= drawn < subsample * 2**24
            bins, y, p = bins[learn], y[learn], p[learn]
            place = bins.astype(np.int64) + np.arange(n_features) * width
            for k in range(n_classes):
                at = Trees.nodes(trees[k], bins, level) - (nodes - 1)
                live = at >= 0  # rows in leaves above this level are done
                g, h = (p[:, k] - (y == k))[live], np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)[live]
                flat = (at[live][:, None] * (n_features * width) + place[live]).ravel()
                for i, v in enumerate((g, h)):
                    s = np.bincount(flat, np.repeat(v, n_features), nodes * n_features * width).reshape(nodes, -1)
                    total[k * nodes : (k + 1) * nodes, i] += s
                seen[k * nodes : (k + 1) * nodes] |= np.bincount(at[live], minlength=nodes) > 0
        slots = np.flatnonzero(seen).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([*slots, -1], pa.int32()), pa.array([*(total[s].tobytes() for s in slots), loss.tobytes()], pa.binary())], schema=_SUMS)

    parts = rows.mapInArrow(sums, "slot int, sums binary").withColumn("_salt", F.spark_partition_id() % 32)
    parts = parts.repartition("slot", "_salt").select("slot", "sums").mapInArrow(_added, "slot int, sums binary")  # tasks' sums in two steps
    out = parts.repartition("slot").mapInArrow(_added, "slot int, sums binary").collect()  # classes times nodes rows
    return {r["slot"]: np.frombuffer(bytes(r["sums"]), float) if r["slot"] < 0 else np.frombuffer(bytes(r["sums"]), float).reshape(2, n_features, width) for r in out}


def _split(trees, sums: dict[int, np.ndarray], level: int, depth: int, rate: float, gamma: float, penalty: float, min_child: float, max_step: float) -> None:
    """Weights of the level's nodes, and the split of each whose gain is above gamma."""
    nodes = 1 << level
    for slot, s in sums.items():
        feature, cut, weight = trees[slot // nodes]
        node = nodes - 1 + slot % nodes
        g, h = s[:, 0].sum(1)
        step = -g / (h + penalty)
        weight[node] = rate * (np.clip(step, -max_step, max_step) if max_step > 0 else step)
        if level == depth:
            continue
        gl, hl = np.cumsum(s[0], 1)[:, :-1], np.cumsum(s[1], 1)[:, :-1]
        score = lambda a, b: a * a / (b + penalty)
        gain = 0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h)) - gamma
        gain[(hl < min_child) | (h - hl < min_child)] = -np.inf
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 0:
            feature[node], cut[node] = f, b


def classify(model: Trees, df: DataFrame) -> DataFrame:
    """Adds probs, in the order of the model's labels, and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # rounds times classes times nodes
    columns = df.columns
    schema_out = df.withColumn("probs", F.array(F.lit(0.0))).withColumn("predicted", F.lit("")).schema
    values = F.array(*(F.col(f).cast("double") for f in model.features)).alias("_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            x = np.array([[np.nan if v is None else v for v in r] for r in b.column(b.num_columns - 1).to_pylist()], float).reshape(n, len(m.features))
            p = _softmax(m.margins(m.binned(x), m.depth)) if n else np.zeros((0, len(m.labels)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(list(p), pa.list_(pa.float64())), pa.array([m.labels[k] for k in p.argmax(1)] if n else [], pa.string())], names=[*columns, "probs", "predicted"])

    return df.select("*", values).mapInArrow(run, schema_out)
