"""Exact similarity join of shingle sets, with index-level and answer-level skipping by relations between sets.

1. A pass over the texts gives each document's set size, a 128-bit fingerprint of its set, its four least shingle
   hashes, and a fixed-size sketch of how many documents hold a shingle. Equal sets become one class.
2. Classes that share one of the four hashes are verified against the least class of that hash; the links found give
   most groups, and each class a highly similar leader, with the few shingles in which the two differ.
3. A second pass emits the prefix of every class, its n - ceil(0.8 n) + 1 rarest shingles: two linked sets share one of
   them. Posting lists meet by shingle. A list whose sets are in one component is skipped whole. The others are cut into
   blocks of equal set size, each in the order of positions: a set skips the blocks of sizes that can't link, and in the
   other blocks all positions beyond the one that leaves too few shingles (index-level skipping).
4. Of what is left, the leaders are verified first. Pairs that are then in one component need no answer. Jaccard distance
   is a metric, so a pair whose leaders lie further apart than its own distances to them allow can't link. The overlap
   of any other pair is derived from its leaders' overlap and the differences of both sets (answer-level skipping): no
   set but a leader's is read again.

Nothing is capped: the sketch only orders shingles, and any order gives the same links. Lists of very common shingles are
dealt over several tasks, and each pair of tasks' entries meets in a task of its own unless all are in one component. The
number of tasks follows the counted postings.

Shingles are 64-bit hashes of five lower-cased words, or of the whole sequence if there are fewer. A document without
words is linked with nothing. Rows that share a doc_id count as one document; `one_of_each` keeps the least of their texts.
Repeated rows give repeated results. A row without doc_id gets the component of the documents with its shingles, null if
there is none. Of a group the least doc_id is its id. Very long texts are read whole. Other columns, whatever their names,
pass through `one_of_each` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_few, partitions, sized, tidy, written

WORDS = 5
#: Least similarity as a whole percentage.
PERCENT = 80
SKETCH_BITS, CHUNK_BITS = 22, 16
#: Bytes of the postings that meet in a task, on average.
PART_BYTES = 16_000_000
#: Postings of one shingle beyond which they are dealt over several tasks.
LIST_ROWS = 2048
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
POSTING = np.dtype([("key", "<u8"), ("sub", "<i4"), ("n", "<u4"), ("pos", "<u4"), ("id", "<i8"), ("comp", "<i8")])


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_memo = _Memo()


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    w = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    h = w[:n] * _MULTIPLIERS[0]
    for j in range(1, WORDS):
        h ^= h >> np.uint64(29)
        h += w[j : j + n] * _MULTIPLIERS[j]
    h ^= h >> np.uint64(32)
    h *= _MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("low", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])


@tidy(_memo)
def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), False
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = shingle_set(text.as_py())
            if len(s):
                seen = True
                np.add.at(sketch, s >> np.uint64(64 - SKETCH_BITS), 1)
            rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:4].astype(np.int64).tolist(), None, None))
        if rows:
            yield _batch(rows, _FIRST)
    if seen:
        for k, part in enumerate(sketch.reshape(-1, 1 << CHUNK_BITS)):
            yield _batch([(None, None, None, None, k, zlib.compress(part.tobytes(), 1))], _FIRST)


@tidy()
def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by chunk as they stream by, held to 32 bits."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k not in total:
                total[k] = np.zeros(1 << CHUNK_BITS, np.uint64)
            total[k] += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes(), 1) for v in total.values()], pa.binary())], names=["chunk", "counts"])


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ids(id)."""

    @tidy(_memo)
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((i, shingle_set(text.as_py()).tobytes()))
                if len(rows) == 1024:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return docs.join(sized(ids), docs["doc_id"] == ids["id"]).select("id", "text").mapInArrow(build, "id long, set binary")


_OVERLAP = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("plus", pa.binary()), ("minus", pa.binary())])
_OVERLAP_DDL = "a long, b long, common long, na long, nb long, plus binary, minus binary"


def common_values(s: np.ndarray, t: np.ndarray) -> int:
    """How many values two arrays of distinct values share."""
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _overlaps(differences: bool):
    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                c = common_values(s, t)
                near = differences and 100 * c >= PERCENT * (len(s) + len(t) - c)
                rows.append((a, b, c, len(s), len(t), np.setdiff1d(s, t, True).tobytes() if near else None, np.setdiff1d(t, s, True).tobytes() if near else None))
            if rows:
                yield _batch(rows, _OVERLAP)

    return run


def verify(docs: DataFrame, pairs: DataFrame, differences: bool = False) -> DataFrame:
    """a, b, common, na, nb of the pairs (a, b): sizes of the intersection and of both sets; what a linked a has more and less."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "join-ids")
    sets = written(sets_of(docs, ids), "join-sets")
    one = sized(pairs).join(sets.select(F.col("id").alias("_i"), F.col("set").alias("sa")), F.col("a") == F.col("_i")).select("a", "b", "sa")
    leaders = written(pairs.select(F.col("b").alias("_j")).distinct(), "join-leaders")
    other = sets.join(sized(leaders), F.col("id") == F.col("_j")).select("_j", F.col("set").alias("sb"))
    two = one.join(other, F.col("b") == F.col("_j")).select("a", "b", "sa", "sb")
    out = written(two.mapInArrow(_overlaps(differences), _OVERLAP_DDL), "join-verified")
    discard(sets)
    return out


@tidy()
def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of a and b from those of their leaders: a is its leader plus and minus some shingles, and so is b."""
    read = lambda x: np.frombuffer(x.as_py() or b"", np.uint64)
    for batch in batches:
        rows = []
        for a, b, common, pa_, ma, pb, mb, la, lb in zip(*(batch.column(k).to_pylist() for k in range(3)), *(map(read, batch.column(k)) for k in range(3, 9)), strict=True):
            common += common_values(pa_, lb) - common_values(ma, lb) + common_values(la, pb) - common_values(la, mb)
            common += common_values(pa_, pb) - common_values(pa_, mb) - common_values(ma, pb) + common_values(ma, mb)
            rows.append((a, b, common, len(la) + len(pa_) - len(ma), len(lb) + len(pb) - len(mb), None, None))
        if rows:
            yield _batch(rows, _OVERLAP)


def derived(docs: DataFrame, pairs: DataFrame, lead: DataFrame) -> DataFrame:
    """a, b, common, na, nb of pairs(a, b, la, lb, common): common is the overlap of the leaders la and lb."""
    ids = written(pairs.select(F.explode(F.array("la", "lb")).alias("id")).distinct(), "join-ids")
    sets = written(sets_of(docs, ids), "join-sets")
    own = lambda c: lead.select(F.col("id").alias(f"_{c}"), F.col("plus").alias(f"p{c}"), F.col("minus").alias(f"m{c}"))
    of = lambda c: sets.select(F.col("id").alias(f"_s{c}"), F.col("set").alias(f"s{c}"))
    d = pairs.join(own("a"), F.col("a") == F.col("_a"), "left").join(own("b"), F.col("b") == F.col("_b"), "left")
    d = d.join(of("a"), F.col("la") == F.col("_sa")).join(of("b"), F.col("lb") == F.col("_sb"))
    out = written(d.select("a", "b", "common", "pa", "ma", "pb", "mb", "sa", "sb").mapInArrow(_derive, _OVERLAP_DDL), "join-derived")
    discard(sets)
    return out


LINKED = f"100 * common >= {PERCENT} * (na + nb - common)"


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each id's component. Edges: (a, b).

    Each id takes its least neighbour, pointers are followed three times, and the graph is contracted, until no edge is
    left; the number of rounds grows with the logarithm of the longest chain.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-edges")
    left = rows = e.count()
    labels = written(in_few(e.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * rows).withColumn("root", F.col("id")), "component-labels")
    while left > 0:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(in_few(both.groupBy("a").agg(F.min("b").alias("b")), 2 * left).select(F.col("a").alias("x"), F.least("a", "b").alias("y")), "component-pointers")
        n = to.count()
        for _ in range(3 if left > 1 else 0):
            nxt = to.select(F.col("x").alias("_x"), F.col("y").alias("_y"))
            to = written(in_few(to.join(sized(nxt, n), F.col("y") == F.col("_x"), "left").select("x", F.coalesce("_y", "y").alias("y")), n), "component-pointers")
        p = sized(to, n)
        labels = written(in_few(labels.join(p, F.col("root") == F.col("x"), "left").select("id", F.coalesce("y", "root").alias("root")), 2 * rows), "component-labels")
        e = e.join(p, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        e = e.join(p, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
        e = written(in_few(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), left), "component-edges")
        left = e.count()
    return labels


def _postings(sketch, n_parts: int):
    schema = pa.schema([("part", pa.int32()), ("postings", pa.binary())])

    @tidy(_memo)
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint32)
        held, rows = [], 0
        for batch in batches:
            for i, comp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py())
                if n := len(s):
                    often = counts[s >> np.uint64(64 - SKETCH_BITS)]
                    keys = (np.minimum(often, 65535).astype(np.uint64) << np.uint64(48)) | (s & np.uint64((1 << 48) - 1))
                    size = n - (PERCENT * n + 99) // 100 + 1
                    if size < n:
                        last = np.partition(keys, size - 1)[size - 1]
                        at = np.flatnonzero(keys <= last)
                        keys, often = keys[at], often[at]
                    order = np.argsort(keys)
                    keys, often = keys[order], often[order]
                    p = np.empty(len(keys), POSTING)
                    p["key"], p["n"], p["pos"], p["id"], p["comp"] = keys, n, np.arange(len(keys)), i, comp
                    spread = often.astype(np.int64) // LIST_ROWS + 1
                    p["sub"] = np.where(spread > 1, (xxhash.xxh3_64_intdigest(i.to_bytes(8, "little", signed=True)) >> 2) % spread, -1)
                    held.append(p)
                    rows += len(p)
                if rows >= 500_000:
                    yield dealt(held)
                    held, rows = [], 0
        if rows:
            yield dealt(held)

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        p = np.concatenate(held)
        part = (((p["key"] + (p["sub"] + 1).astype(np.uint64) * _MULTIPLIERS[2]) * _MULTIPLIERS[0]) >> np.uint64(33)) % np.uint64(n_parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        p, part = p[order], part[order]
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()]
        return _batch([(int(part[a]), p[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(p)], strict=True)], schema)

    return emit


#: kind 0: the pair (a, b); kind 1: a common shingle's list in one task, with its least and greatest component in a
#: and b; kind 2: one entry of such a list.
_MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("sub", pa.int32()), ("comp", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])


@tidy()
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blobs = [x.as_py() for batch in batches for x in batch.column(1)]
    if not blobs:
        return
    p = np.frombuffer(b"".join(blobs), POSTING)
    del blobs
    p = p[np.lexsort((p["pos"], p["n"], p["sub"], p["key"]))]
    edge = np.flatnonzero((p["key"][1:] != p["key"][:-1]) | (p["sub"][1:] != p["sub"][:-1])) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(p)]])
    least, most = np.minimum.reduceat(p["comp"], starts), np.maximum.reduceat(p["comp"], starts)
    common = np.flatnonzero(p["sub"][starts] >= 0)
    if len(common):
        nothing = [None] * len(common)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([1] * len(common), least[common], most[common], p["key"][starts[common]].view(np.int64), p["sub"][starts[common]], nothing, nothing, nothing), _MET, strict=True)], schema=_MET)
        for k in common.tolist():
            q = p[starts[k] : ends[k]]
            nothing = [None] * len(q)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([2] * len(q), q["id"], nothing, q["key"].view(np.int64), q["sub"], q["comp"], q["n"].astype(np.int64), q["pos"].astype(np.int64)), _MET, strict=True)], schema=_MET)
    mixed = least != most
    p = p[np.repeat(mixed, ends - starts)]
    if len(p):
        yield from _candidates(p, np.repeat(np.arange(np.count_nonzero(mixed)), (ends - starts)[mixed]))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, `count` numbers."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(before - first, count)


def _candidates(p: np.ndarray, row: np.ndarray, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Pairs of postings of one list, of different components, that sizes and positions don't rule out.

    p: postings in the order of list, set size and position; row: each one's list.
    """
    n, pos = p["n"].astype(np.int64), p["pos"].astype(np.int64)
    rest = n - pos
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (n[1:] != n[:-1])])
    block = np.cumsum(new) - 1  # of a list's sets of one size
    begin = np.flatnonzero(new)
    size, sorted_blocks, places = n[begin], (row[begin] << 32) | n[begin], (block << 32) | pos
    # The greatest size that can link with a set, by the sizes alone and by the shingles that its own position leaves.
    widest = np.minimum(100 * n // PERCENT, (100 + PERCENT) * rest // PERCENT - n)
    blocks = np.maximum(np.searchsorted(sorted_blocks, (row << 32) | np.maximum(widest, 0), "right") - block, 0)
    found: list[np.ndarray] = []
    rows = 0
    bounds = np.searchsorted(np.cumsum(blocks), np.arange(0, int(blocks.sum()) + most, most), "left")
    for a, b in zip(np.concatenate([[0], bounds[1:-1] + 1]), np.append(bounds[1:-1] + 1, len(p)), strict=True):
        if a >= b:
            continue
        i = np.repeat(np.arange(a, b), blocks[a:b])
        k = _ranges(block[a:b], blocks[a:b])
        # Of the block the postings up to the last position that leaves enough shingles, and after i itself.
        last = size[k] - -(-PERCENT * (n[i] + size[k]) // (100 + PERCENT))
        stop = np.searchsorted(places, (k << 32) | np.maximum(last, 0), "right")
        start = np.maximum(begin[k], i + 1)
        count = np.where(last >= 0, np.maximum(stop - start, 0), 0)
        some = np.flatnonzero(count)
        for z in np.array_split(some, max(1, int(count.sum()) // most + 1)):
            x, y = np.repeat(i[z], count[z]), _ranges(start[z], count[z])
            other = p["comp"][x] != p["comp"][y]
            u, v = p["id"][x[other]], p["id"][y[other]]
            if len(u):
                found.append(np.stack([np.maximum(u, v), np.minimum(u, v)], 1))
                rows += len(u)
            if rows > most // 2:
                found, rows = [np.unique(np.concatenate(found), axis=0)], 0
                if len(found[0]) > most // 4:
                    yield _pairs(found[0])
                    found = []
    if found:
        yield _pairs(np.unique(np.concatenate(found), axis=0))


def _pairs(x: np.ndarray) -> pa.RecordBatch:
    nothing = [None] * len(x)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([0] * len(x), x[:, 0], x[:, 1], *[nothing] * 5), _MET, strict=True)], schema=_MET)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (null where there are no words and no doc_id)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = written(docs.mapInArrow(_first_pass, "doc_id long, n long, fp binary, low array<long>, chunk int, counts binary"), "join-first")
    rows = first.where("chunk is null").select("doc_id", "n", "fp", "low")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("fp", "n").agg(F.min("doc_id").alias("id"), F.first("low").alias("low")), "join-classes")

    # The links to the least class of each of four hashes.
    low = classes.select("id", "n", F.explode("low").alias("h"))
    heads = written(low.groupBy("h").agg(F.min("id").alias("b"), F.count("*").alias("_c")).where("_c > 1").select(F.col("h").alias("_h"), "b"), "join-heads")
    pairs = low.join(sized(heads), F.col("h") == F.col("_h")).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    size = lambda c: classes.select(F.col("id").alias(f"_{c}"), F.col("n").alias(f"n{c}"))
    near = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
    sizes = classes.count()
    pairs = pairs.join(sized(size("a"), sizes), F.col("a") == F.col("_a")).join(sized(size("b"), sizes), F.col("b") == F.col("_b")).where(near).select("a", "b")
    linked = written(verify(docs, written(pairs, "join-star"), True).where(LINKED), "join-links")
    links = [linked.select("a", "b")]
    labels = components(links[0])
    distance = 1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    lead = linked.groupBy("a").agg(F.min(F.struct(distance.alias("d"), F.col("b").alias("l"), "plus", "minus")).alias("x"))
    lead = written(lead.select(F.col("a").alias("id"), F.col("x.l").alias("leader"), F.col("x.d").alias("d"), "x.plus", "x.minus"), "join-lead")

    # Prefixes of all classes meet.
    sums = "chunk int, counts binary"
    summed = first.where("chunk is not null").select("chunk", "counts").mapInArrow(_sum_counts, sums)  # by task first, then by chunk
    summed = summed.repartition(1 << (SKETCH_BITS - CHUNK_BITS), "chunk").mapInArrow(_sum_counts, sums).collect()  # 2^22 counters at every size
    sketch = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint32)
    for r in summed:
        sketch[r["chunk"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    reps = classes.select("id", "n").groupBy("id").agg(F.max("n").alias("n")).join(sized(labels.select(F.col("id").alias("_i"), "root")), F.col("id") == F.col("_i"), "left").select("id", "n", F.coalesce("root", "id").alias("comp"))
    reps = written(reps, "join-reps")
    prefix = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1")
    n = max(partitions(spark), -(-(reps.agg(F.sum(prefix)).first()[0] or 0) * POSTING.itemsize // PART_BYTES))
    texts = docs.join(sized(reps.select("id", "comp"), sizes), docs["doc_id"] == reps["id"]).select("id", "comp", "text")
    postings = texts.mapInArrow(_postings(spark.sparkContext.broadcast(sketch.tobytes()), 4 * n), "part int, postings binary")
    met = written(postings.repartition(n, "part").mapInArrow(_meet, "kind int, a long, b long, key long, sub int, comp long, n long, pos long"), "join-met")
    # Of lists dealt over several tasks each two tasks' entries meet, unless they hold one component alone.
    tasks = met.where("kind = 1").select("key", "sub", F.col("a").alias("least"), F.col("b").alias("most"))
    second = tasks.select(F.col("key").alias("key2"), F.col("sub").alias("sub2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    two = tasks.join(second, (F.col("key") == F.col("key2")) & F.expr("sub < sub2 and least(least, least2) <> greatest(most, most2)")).select(F.col("key").alias("k"), F.col("sub").alias("x"), F.col("sub2").alias("y"))
    two = written(two, "join-dealt")
    entries = met.where("kind = 2").select("key", "sub", "comp", "n", "pos", "a")
    dealt = two.count()
    e1 = entries.join(sized(two, dealt), (F.col("key") == F.col("k")) & (F.col("sub") == F.col("x"))).select("k", "x", "y", "comp", "n", "pos", "a")
    e2 = entries.join(sized(two, dealt), (F.col("key") == F.col("k")) & (F.col("sub") == F.col("y"))).select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("a").alias("a2"))
    cross = e1.join(e2, (F.col("k") == F.col("k2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & F.expr(f"comp <> comp2 and 100 * least(n, n2) >= {PERCENT} * greatest(n, n2) and least(n - pos, n2 - pos2) * {100 + PERCENT} >= {PERCENT} * (n + n2)"))
    left = met.where("kind = 0").select("a", "b").unionByName(cross.select(F.greatest("a", "a2").alias("a"), F.least("a", "a2").alias("b"))).distinct()
    left = written(left, "join-left")

    # Leaders first, then what their distances leave open.
    known = lambda c: lead.select(F.col("id").alias(f"_{c}"), F.col("leader").alias(f"l{c}"), F.col("d").alias(f"d{c}"))
    leads = lead.count()
    via = left.join(sized(known("a"), leads), F.col("a") == F.col("_a"), "left").join(sized(known("b"), leads), F.col("b") == F.col("_b"), "left")
    via = via.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), F.coalesce("da", F.lit(0.0)).alias("da"), F.coalesce("db", F.lit(0.0)).alias("db"))
    via = written(via, "join-via")
    of_leaders = verify(docs, written(via.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "join-leads"))
    links.append(of_leaders.where(LINKED).select("a", "b"))
    known_pairs = of_leaders.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "common", distance.alias("d"))
    rest = via.where("la <> lb and (la <> a or lb <> b)").join(sized(known_pairs), (F.greatest("la", "lb") == F.col("_a")) & (F.least("la", "lb") == F.col("_b")))
    rest = written(rest.where(f"d - da - db <= {1 - PERCENT / 100} + 1e-9").select("a", "b", "la", "lb", "common"), "join-open")
    if not rest.isEmpty():
        labels = components(links[0].unionByName(links[1]))  # pairs within a component need no answer
        root = lambda c: labels.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"r{c}"))
        roots = labels.count()
        rest = rest.join(sized(root("a"), roots), F.col("a") == F.col("_a"), "left").join(sized(root("b"), roots), F.col("b") == F.col("_b"), "left")
        rest = written(rest.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b", "la", "lb", "common"), "join-rest")
        links.append(derived(docs, rest, lead).where(LINKED).select("a", "b"))

    labels = components(functools.reduce(DataFrame.unionByName, links))
    roots = written(classes.join(sized(labels.select(F.col("id").alias("_i"), "root")), F.col("id") == F.col("_i"), "left").select(F.col("fp").alias("_fp"), F.col("n").alias("_n"), F.coalesce("root", "id").alias("root")), "join-roots")
    out = rows.join(sized(roots, sizes), (F.col("fp") == F.col("_fp")) & (F.col("n") == F.col("_n")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, of which each component's least doc_id stays, once."""
    gone = written(jaccard_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "join-gone")
    kept = docs.join(sized(gone), docs["doc_id"] == gone["_gone"], "left_anti")
    again = kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("_twice"))
    again = written(again, "join-twice")
    if again.isEmpty():
        return kept
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    twice = kept.join(sized(again), kept["doc_id"] == again["_twice"], "left_semi")
    twice = twice.groupBy("doc_id").agg(F.min_by(columns, F.struct("text", F.to_json(columns))).alias("_least")).select("_least.*")
    return kept.join(sized(again), kept["doc_id"] == again["_twice"], "left_anti").unionByName(twice)
