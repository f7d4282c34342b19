"""Language identification of texts in several languages.

Training counts hashed byte trigrams of all labelled rows by language. A document is a mixture: expectation-maximisation
estimates the shares of the languages from the likelihoods of its trigrams. The likelihood of a set of languages, fitted
by itself, less a penalty for each language after the first is the set's value; the set with the greatest value is taken,
and the prediction is the language of the largest share in it. The sets compared are each single language, all sets of
the `leading` languages of the largest shares in the full mixture, and beyond that number the k largest for every k.
A document for which no set of two or more can reach the best single language, by an upper bound of the full mixture's
likelihood, needs no further fits; so a text in one language, the usual case, costs one.

A null text, an empty one and one without a letter (Unicode's L classes; numerals are none) are `und` with score 0. Rows
without a language don't train. Without any training row everything is `und`. Of equal values the smaller set, of equal
shares the first language by name is taken. Repeated rows are rows of their own. Very long texts are read whole. Other
columns, whatever their names, are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

BUCKET_BITS = 15
#: Overlapping trigrams say the same three times.
TEMPER = 1 / 3


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text in lower case."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


@tidy()
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text := text.as_py():
                if lang not in held:
                    held[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
                held[lang] += np.bincount(trigrams(text), minlength=1 << BUCKET_BITS)
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], schema=_COUNTS)


class Model:
    """Languages, and the probability of each bucket in each of them."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        c = np.stack([counts[x] for x in self.languages], 1) + 0.5
        self.p = (c / c.sum(0)).astype(np.float32)

    def predict(self, texts: list[str], penalty: float, rounds: int, leading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language indices, scores, and the shares of all languages (0 outside the chosen set)."""
        n_docs, n_langs = len(texts), len(self.languages)
        codes = [trigrams(t) for t in texts]
        doc = np.repeat(np.arange(n_docs), [len(c) for c in codes])
        key, weight = np.unique((doc.astype(np.int64) << BUCKET_BITS) | np.concatenate(codes), return_counts=True)
        bags = _Bags(key >> BUCKET_BITS, self.p[key & ((1 << BUCKET_BITS) - 1)], weight.astype(np.float32), n_docs)
        single = np.add.reduceat(np.log(bags.p) * bags.w[:, None], bags.starts, axis=0).astype(np.float64)

        best_share = np.zeros((n_docs, n_langs))
        best_share[np.arange(n_docs), single.argmax(1)] = 1
        best = single.max(1) * TEMPER
        full = bags.em(np.full((n_docs, n_langs), 1 / n_langs), rounds)
        likelihood, slope = bags.likelihood(full)
        # The likelihood is concave in the shares, so its greatest value is at most this one and the steepest slope from here.
        bound = (likelihood + bags.size * np.maximum(slope.max(1) - 1, 0)) * TEMPER - penalty * np.log(bags.size + 1)
        open_ = np.flatnonzero(bound > best)
        if len(open_) and n_langs > 1:
            some = bags.of(open_)
            order = np.argsort(-full[open_], 1, kind="stable")
            sets = [x for k in range(2, min(leading, n_langs) + 1) for x in combinations(range(min(leading, n_langs)), k)]
            sets += [tuple(range(k)) for k in range(leading + 1, n_langs + 1)]
            for ranks in sets:
                mask = np.zeros((len(open_), n_langs))
                np.put_along_axis(mask, order[:, list(ranks)], 1, 1)
                start = (full[open_] + 1e-3) * mask
                share = some.em(start / start.sum(1, keepdims=True), rounds)
                value = some.likelihood(share)[0] * TEMPER - penalty * (len(ranks) - 1) * np.log(some.size + 1)
                better = value > best[open_]
                best[open_[better]] = value[better]
                best_share[open_[better]] = share[better]
        lang = best_share.argmax(1)
        t = single * TEMPER
        odds = np.exp(t[np.arange(n_docs), lang] - t.max(1)) / np.exp(t - t.max(1, keepdims=True)).sum(1)
        score = np.clip(best_share[np.arange(n_docs), lang] * np.where(best_share.max(1) < 1, 1, odds), 0, 1)
        return lang, score, best_share


class _Bags:
    """The distinct trigrams of documents, one after another: probabilities in each language and counts."""

    def __init__(self, doc: np.ndarray, p: np.ndarray, w: np.ndarray, n_docs: int):
        self.doc, self.p, self.w = doc, p, w
        self.starts = np.searchsorted(doc, np.arange(n_docs))
        self.size = np.add.reduceat(w, self.starts).astype(np.float64)

    def of(self, docs: np.ndarray) -> _Bags:
        place = np.full(len(self.starts), -1)
        place[docs] = np.arange(len(docs))
        at = np.flatnonzero(place[self.doc] >= 0)
        return _Bags(place[self.doc[at]], self.p[at], self.w[at], len(docs))

    def em(self, share: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            joint = self.p * share.astype(np.float32)[self.doc]
            joint *= (self.w / np.maximum(joint.sum(1), 1e-30))[:, None]
            share = np.add.reduceat(joint, self.starts, axis=0) / self.size[:, None]
        return share

    def likelihood(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, and its slope along each language's share, a trigram."""
        total = np.maximum((self.p * share.astype(np.float32)[self.doc]).sum(1), 1e-30)
        slope = np.add.reduceat(self.p * (self.w / total)[:, None], self.starts, axis=0) / self.size[:, None]
        return np.add.reduceat(np.log(total) * self.w, self.starts).astype(np.float64), slope


def train(docs: DataFrame) -> Model | None:
    """Counts over all rows of docs(lang, text) that have both."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    counts: dict[str, np.ndarray] = {}
    for r in written(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts").toLocalIterator():  # languages x 2^15 rows
        counts.setdefault(r["lang"], np.zeros(1 << BUCKET_BITS))[r["bucket"]] = r["n"]
    return Model(counts) if counts else None


_RESULT = "doc_id long, held_out boolean, lang_pred string, score double, shares map<string, double>"


def identify(docs: DataFrame, held_out: Column, penalty: float = 3.0, rounds: int = 8, leading: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares; learnt from the rows that aren't held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out.alias("held_out"))
    model = train(d.where("not held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2^15 numbers

    @tidy()
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])
        for batch in batches:
            pred, score, shares = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [[]] * batch.num_rows
            block, size = [], 0
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                if m is not None and text and any(map(str.isalpha, text)):
                    block.append((k, text))
                    size += len(text)
                if block and (size > 200_000 or k == batch.num_rows - 1):
                    for (i, _), l, s, row in zip(block, *m.predict([t for _, t in block], penalty, rounds, leading), strict=True):
                        pred[i], score[i] = m.languages[l], float(s)
                        shares[i] = [(m.languages[x], float(row[x])) for x in np.flatnonzero(row)]
                    block, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score, pa.float64()), pa.array(shares, schema.field("shares").type)], schema=schema)

    return d.select("doc_id", "held_out", "text").mapInArrow(predict, _RESULT)
