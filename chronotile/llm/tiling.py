"""Benchmark decontamination by greedy string tiling.

A benchmark's words are cut into windows of `min_match` words, whose Karp-Rabin hashes are the seeds. A document's
rolling hashes are looked up among them, and items whose shared seeds can't cover enough are passed over. Of the others
the longest common runs of words are found by running Karp-Rabin on windows whose length is halved in on, marked in the
order of document and item, and so on with what is unmarked, until no run of `min_match` words is left (greedy string
tiling). Tiles may come in any order, so a reordered passage is covered as well. A document is contaminated by an item if
tiles cover at least `coverage` of the item's words. No list of pairs of positions is ever made: time and memory follow
the lengths of text and item, also where one word fills both.

Words are runs of letters and digits of the lower-cased text. An item of fewer than `min_match` words is matched by a text
of just these words, as it could be anywhere by chance. Items without words, and those without an id, which a result could
not name, match nothing in `contaminations`; `decontaminated` numbers items itself and so holds all of them. Null and empty
texts have no matches. Of equal runs the first in the document, then in the item, is a tile. Repeated rows give repeated
results. Very long texts are read whole. Other columns, whatever their names, are neither read nor returned. An empty table
or benchmark gives an empty result. The benchmark is read in blocks of at most `block_items` items and `block_bytes` bytes
on average, each broadcast and held against all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, tidy, written

WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
RESULT = "doc_id long, item_id long, item_words int, covered int, n_tiles int, coverage double, tiles array<struct<doc_start: int, item_start: int, length: int>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered", pa.int32()), ("n_tiles", pa.int32()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())])))])


def prefixes(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of the beginnings of ids, times the powers that make them comparable."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), BASE)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(ids * powers[:-1], dtype=np.uint64)])


#: Powers of the inverse of BASE, which shift a window's hash to the beginning.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def window_hashes(sums: np.ndarray, starts: np.ndarray, n: int, back: np.ndarray) -> np.ndarray:
    """Hashes of the windows of n ids from the given starts; back: powers of INVERSE."""
    return (sums[starts + n] - sums[starts]) * back[starts]


def powers_back(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]), dtype=np.uint64)


class Index:
    """The seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.n = min_match
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.whole: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        holders: dict[int, set[int]] = defaultdict(set)
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if not words or item_id is None:
                continue
            if len(words) < min_match:
                self.whole[tuple(words)].append((item_id, len(words)))
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            for h in set(self._seeds(ids).tolist()):
                holders[h].add(len(self.items))
            self.items.append((item_id, ids))
        self.known = np.array(sorted(holders), np.uint64)
        self.holders = [sorted(holders[h]) for h in self.known.tolist()]

    def _seeds(self, ids: np.ndarray) -> np.ndarray:
        return rolling(ids, np.arange(max(len(ids) - self.n + 1, 0)), self.n)

    def matches(self, text: str, coverage: float) -> list[tuple]:
        words = WORD.findall(text.lower())
        out = [(item_id, n, n, [(0, 0, n)]) for item_id, n in self.whole.get(tuple(words), ())] if len(words) < self.n else []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        run = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(run[self.n :] - run[: -self.n] == self.n) if len(ids) >= self.n else []
        if not len(at) or not len(self.known):
            return out
        h = rolling(ids, at, self.n)
        place = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        found = self.known[place] == h
        at, h = at[found], h[found]
        for item in sorted({i for k in np.unique(place[found]).tolist() for i in self.holders[k]}):
            item_id, own = self.items[item]
            seeds = self._seeds(own)
            reach = np.zeros(len(own) + 1, np.int64)
            shared = np.flatnonzero(np.isin(seeds, h))
            np.add.at(reach, shared, 1)
            np.add.at(reach, shared + self.n, -1)
            if np.count_nonzero(np.cumsum(reach[:-1])) < coverage * len(own):
                continue  # not even overlapping matches would cover enough
            tiles = greedy_tiles(ids, own, self.n, at[np.isin(h, seeds)])
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(own):
                out.append((item_id, len(own), covered, tiles))
        return out


def rolling(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of n ids from the given starts."""
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h *= BASE
        h += ids[at + j]
    return h


def greedy_tiles(doc: np.ndarray, item: np.ndarray, n: int, seeds: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of the tiles; seeds: starts of the document's windows of n words to look at."""
    starts = np.arange(len(doc) - n + 1) if seeds is None else seeds
    if not len(starts) or len(item) < n:
        return []
    # Only words in some seed can be in a tile; the rest is left out, with a gap that no window spans.
    words = np.unique((starts[:, None] + np.arange(n)).ravel())
    doc = doc[words]
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    gap = np.concatenate([np.diff(words) > 1, [True]])  # after a word
    sums, back = (prefixes(doc), prefixes(item)), powers_back(max(len(doc), len(item)))
    tiles: list[tuple[int, int, int]] = []

    def windows(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the free windows that are in both."""
        blocked = np.concatenate([[0], np.cumsum(~free_doc)]), np.concatenate([[0], np.cumsum(gap)]), np.concatenate([[0], np.cumsum(~free_item)])
        p = np.flatnonzero((blocked[0][length:] == blocked[0][:-length]) & (blocked[1][length - 1 : -1] == blocked[1][: len(doc) - length + 1])) if len(doc) >= length else np.zeros(0, np.int64)
        q = np.flatnonzero(blocked[2][length:] == blocked[2][:-length]) if len(item) >= length else np.zeros(0, np.int64)
        hp, hq = window_hashes(sums[0], p, length, back), window_hashes(sums[1], q, length, back)
        a, b = np.isin(hp, hq), np.isin(hq, hp)
        return p[a], hp[a], q[b], hq[b]

    longest = min(len(doc), len(item))
    while longest >= n:
        low, high = n, longest
        if not len(windows(n)[0]):
            break
        while low < high:  # the greatest length of a common free window
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(windows(middle)[0]) else (low, middle - 1)
        p, hp, q, hq = windows(low)
        at: dict[int, list[int]] = defaultdict(list)
        for place, h in zip(q[::-1].tolist(), hq[::-1].tolist(), strict=True):
            at[h].append(place)  # the first is the last of the list
        end = 0
        for place, h in zip(p.tolist(), hp.tolist(), strict=True):
            if place < end:
                continue
            while at[h]:
                other = at[h][-1]
                if not free_item[other : other + low].all():
                    at[h].pop()  # it stays marked
                    continue
                if (doc[place : place + low] == item[other : other + low]).all():
                    tiles.append((int(words[place]), other, low))
                    free_doc[place : place + low] = False
                    free_item[other : other + low] = False
                    end = place + low
                break
        longest = low - 1
    return sorted(tiles)


def contaminations(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.5, block_items: int = 20_000, block_bytes: int = 32_000_000) -> DataFrame:
    """A row for each document and item that it contains, with the tiles (starts and lengths in words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // block_items), -(-(size or 0) // block_bytes))
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # block_items rows and block_bytes bytes on average
        held = spark.sparkContext.broadcast(Index([tuple(r) for r in rows], min_match))

        @tidy()
        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if text := text.as_py():
                        out += [(doc_id, i, n, c, len(t), c / n, [{"doc_start": p, "item_start": q, "length": k} for p, q, k in t]) for i, n, c, t in index.matches(text, coverage)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)

        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, RESULT))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that contain no item, with their columns."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item_id"), "text")
    bad = written(contaminations(keyed, items, **parameters).select(F.col("doc_id").alias("_bad")).distinct(), "tiling-bad")
    return docs.join(sized(bad), F.xxhash64(docs["doc_id"], docs["text"]) == bad["_bad"], "left_anti")
