"""Toxicity by a factorization machine over hashed terms.

A text is a bag of hashed lower-cased terms, scaled to one length. Beside a bias and a weight for each term the machine
learns a short vector for each, whose inner products weigh pairs of terms that meet in a text: an insult with the mention
of a group counts for more, or for less, than both alone. It is fitted by proximal AdaGrad on a bounded sample of labelled
rows: the `sample_rows` rows of the least hash of their doc_id. Terms of fewer than `min_docs` of them have no weight. No
term is screened by its own association with the label, as a term may count in pairs alone; instead weights and vectors
shrink at each step (`shrink_weight`, `shrink_vector`), and those that the labels don't keep up become zero; the terms that
are left are fitted on with a tenth of it.

Every whole text is scored. Null and empty texts have the score of the bias alone, or 0 where nothing could be learnt (no
labelled row, an empty table). Repeated rows are scored alike; of rows that share a doc_id the least text is learnt from, and
of equal hashes the lesser label comes first. Very long texts are read whole. Columns other than doc_id and text, whatever
their names, are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, tidy, written

TERM = re.compile(r"[^\W\d_]+")
HASH_BITS = 20


#: Of the vector of a document's values.
LENGTH = 4.0
#: Epochs after which the terms that count are found, and shrinking goes down to a tenth.
SETTLED = 12
#: Beside a term itself its beginnings of these lengths are terms, so that inflected forms share weights.
BEGINNINGS = (4, 5)


class _Memo(dict):
    """A row of `table`, the hashes of a term and of its beginnings (-1: it is no longer), for each term met."""

    def __init__(self):
        self.table = np.zeros((1 << 12, 1 + len(BEGINNINGS)), np.int64)

    def __missing__(self, term: str) -> int:
        k = self[term] = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = [_hash(term), *(_hash(f"{n}:{term[:n]}") if len(term) > n else -1 for n in BEGINNINGS)]
        return k


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) >> (64 - HASH_BITS)


_memo = _Memo()


def terms(text: str | None) -> np.ndarray:
    """The hashed terms of a text, one for each occurrence."""
    if len(_memo) > 300_000:
        _memo.clear()
    found = TERM.findall((text or "").lower())
    rows = np.fromiter(map(_memo.__getitem__, found), np.int64, len(found))
    hashes = _memo.table[rows].ravel()
    return hashes[hashes >= 0]


def _value(counts: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)).astype(np.float32)


class Machine:
    def __init__(self, columns: np.ndarray, rank: int, seed: int):
        self.columns = columns  # of hash: the row of w and v, -1 without weight
        n, g = int(columns.max(initial=-1)) + 1, np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(n, np.float32), g.normal(0, 0.1, (n, rank)).astype(np.float32)

    def bag(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.columns[hashes]
        at, n = np.unique(c[c >= 0], return_counts=True)
        return at, _value(n)

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents whose terms stand one after another; also the sums of vectors."""
        some = lengths > 0
        s = np.zeros((len(lengths), self.v.shape[1]), np.float32)
        m = np.full(len(lengths), self.b, np.float32)
        if some.any():
            vx = self.v[at] * x[:, None]
            s[some] = np.add.reduceat(vx, starts[some])
            m[some] += np.add.reduceat(self.w[at] * x, starts[some]) + 0.5 * ((s[some] ** 2).sum(1) - np.add.reduceat((vx**2).sum(1), starts[some]))
        return m, s

    def step(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the mean logistic loss: of the bias, the rows that occur, of their weights and vectors."""
        m, s = self.margins(at, x, starts, lengths)
        e = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - y) / len(y)).astype(np.float32)
        ex = np.repeat(e, lengths) * x
        own, back = np.unique(at, return_inverse=True)
        each = ex[:, None] * (np.repeat(s, lengths, 0) - self.v[at] * x[:, None])
        by = np.argsort(back, kind="stable")
        dv = np.add.reduceat(each[by], np.searchsorted(back[by], np.arange(len(own)))) if len(own) else each
        return float(e.sum()), own, np.bincount(back, ex, len(own)).astype(np.float32), dv

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, rate: float, shrink: tuple[float, float], seed: int) -> None:
        g = np.random.default_rng(seed)
        gb, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full(len(self.w), 1e-6, np.float32)
        self.b = float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
        sizes = [np.sqrt((x**2).sum()) for _, x in bags]  # by all terms, also those that go
        for epoch in range(epochs):
            if epoch in (3, 6, 12):  # terms that have become zero are left behind
                live = (self.w != 0) | (self.v != 0).any(1)
                bags = [(a[keep], x[keep]) for a, x in bags for keep in (live[a],)]
                self.v[~live] = 0
            pull = 1.0 if epoch < SETTLED else 0.1
            order = g.permutation(len(bags))
            for k in range(0, len(order), 128):
                rows = order[k : k + 128]
                at, x, starts, lengths = joined([bags[i] for i in rows], np.array([sizes[i] for i in rows], np.float32))
                db, own, dw, dv = self.step(at, x, starts, lengths, y[rows])
                gb += db**2
                self.b -= rate * db / gb**0.5
                gw[own] += dw**2
                gv[own] += (dv**2).mean(1)
                pace, slow = rate / np.sqrt(gw[own]), 0.3 * rate / np.sqrt(gv[own])
                w = self.w[own] - pace * dw
                self.w[own] = np.sign(w) * np.maximum(np.abs(w) - pull * shrink[0] * pace, 0)
                v = self.v[own] - slow[:, None] * dv
                size = np.sqrt((v**2).sum(1))
                self.v[own] = v * np.maximum(1 - pull * shrink[1] * slow / np.maximum(size, 1e-9), 0)[:, None]


def joined(bags: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents' terms one after another, their values, each document's scaled to LENGTH, first places, numbers of terms."""
    lengths = np.array([len(a) for a, _ in bags], np.int64)
    at, x = np.concatenate([a for a, _ in bags]), np.concatenate([x for _, x in bags])
    starts = np.minimum(np.concatenate([[0], np.cumsum(lengths)[:-1]]), max(len(at) - 1, 0))
    if sizes is None:
        sizes = np.array([np.sqrt((x**2).sum()) for _, x in bags], np.float32)
    return at, (x * np.repeat(LENGTH / np.maximum(sizes, 1e-6), lengths)).astype(np.float32), starts, lengths


_BAGS = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])
_TERMS = pa.schema([("term", pa.int32()), ("held", pa.int64())])


@tidy(_memo)
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct hashed terms and their counts."""
    for batch in batches:
        found = [np.unique(terms(t.as_py()), return_counts=True) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], schema=_BAGS)


@tidy()
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term the texts that hold it."""
    held = np.zeros(1 << HASH_BITS, np.int64)
    for batch in batches:
        for at in batch.column(2):
            held[np.frombuffer(at.as_py(), np.int32)] += 1
    at = np.flatnonzero(held)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], schema=_TERMS)


def train(chosen: DataFrame, min_docs: int, rank: int, epochs: int, rate: float, shrink: tuple[float, float], seed: int) -> Machine | None:
    """chosen(id, toxic, text): the bounded sample to learn from. The driver gets its rows' terms of `min_docs` rows and more."""
    bags = written(chosen.select("id", "toxic", "text").mapInArrow(_bags, "id long, toxic int, at binary, n binary"), "toxicity-bags")
    if bags.isEmpty():
        return None
    found = bags.mapInArrow(_count_terms, "term int, held long").groupBy("term").agg(F.sum("held").alias("held"))
    kept = np.sort(found.where(F.col("held") >= min_docs).select("term").toArrow()["term"].to_numpy())  # of 2^20 terms
    columns = np.full(1 << HASH_BITS, -1, np.int32)
    columns[kept] = np.arange(len(kept))
    shared = chosen.sparkSession.sparkContext.broadcast(columns)

    @tidy()
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for a, c in zip(batch.column(2), batch.column(3), strict=True):
                own = shared.value[np.frombuffer(a.as_py(), np.int32)]
                at.append(own[own >= 0].tobytes())
                n.append(np.frombuffer(c.as_py(), np.int32)[own >= 0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], schema=_BAGS)

    made = bags.mapInArrow(select, "id long, toxic int, at binary, n binary").toArrow()  # the sample's rows, of the kept terms alone
    y = made["toxic"].to_numpy().astype(np.float32)
    order = np.lexsort((y, made["id"].to_numpy()))  # a model doesn't depend on the order of tasks
    pairs = [(np.frombuffer(a.as_buffer(), np.int32), _value(np.frombuffer(n.as_buffer(), np.int32))) for a, n in zip(made["at"], made["n"], strict=True)]
    del made
    m = Machine(columns, rank, seed)
    m.fit([pairs[k] for k in order], y[order], epochs, rate, shrink, seed)
    return m


def score(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = 20_000, min_docs: int = 8, rank: int = 8, epochs: int = 24, rate: float = 0.2, shrink_weight: float = 3e-3, shrink_vector: float = 1e-3, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labelled rows that aren't held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    learn = d.where("not held_out").select("doc_id", "text")
    ids = written(marks.join(learn.select("doc_id").distinct(), F.col("_id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("_id"), "toxic").limit(sample_rows), "toxicity-sample")
    texts = learn.join(sized(ids), F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.min("text").alias("text"))  # of repeated ids one row
    machine = train(texts.select(F.col("_id").cast("long").alias("id"), "toxic", "text"), min_docs, rank, epochs, rate, (shrink_weight, shrink_vector), seed)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 2^20 numbers and the weights of at most as many terms

    @tidy(_memo)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None:
                value = np.zeros(batch.num_rows)
            else:
                bags = [m.bag(terms(t.as_py())) for t in batch.column(2)]
                margins = np.concatenate([m.margins(*joined(bags[k : k + 256]))[0] for k in range(0, len(bags), 256)])
                value = 1 / (1 + np.exp(-np.clip(margins.astype(float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return d.select("doc_id", "held_out", "text").mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
