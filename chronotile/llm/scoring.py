"""Language-model scores of texts: prediction by partial matching over bytes, beside a unigram base.

The training texts' strings of `order` + 1 bytes make a context trie (text boundaries are a symbol of their own). A
context of k bytes predicts a symbol it has seen c times among C with c / (C + D), D the number of distinct symbols
(escape method C); the rest of the probability goes to the next shorter context, in which the symbols already refused are
excluded from counts and escape. Below the empty context all remaining symbols are alike. The model doesn't change while
it scores, so the probability of a symbol depends on its `order` bytes before alone; a text's code length is the sum.

1. A pass over all texts packs them into blocks of compressed packs, and writes beside each block its distinct strings
   with their training counts, dealt into parts by the last three bytes of their context. A part has whole contexts of three bytes
   and more; shorter ones come from the counts of strings of three bytes, whose number the alphabet bounds (257^3).
2. The parts' counts are summed as they stream by, and give each string's probability. No string is left out, and no
   table of them is broadcast.
3. Each block's strings of a part meet the part's probabilities, and go back to their block, where its texts are scored.
   Rows meet by a sort on the part or block, one at a time, so memory is bounded by a part's distinct strings or a block.

The number of parts grows with the root of the bytes, as distinct strings do at most in natural text. Words are looked up
in two ways: those with at least a millionth of all tokens, at most a million words, are broadcast; the others meet their
counts in a join. Rows have numbers that are written with their block, so no later read of another split changes them.

Null texts count as empty: they have one token, the end. Repeated rows are rows of their own, ties can't matter. Texts
are read whole, very long ones in pieces that know the bytes before them. Other columns are neither read nor returned.
Without any training row the byte model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, sized, tidy, written

SYMBOLS = 257  # 0: a boundary; else a byte plus 1
SHORT = 3  # symbols of the strings whose counts all parts share
END = b"\n"  # no word holds it
LONG_WORD = 40
BLOCK_BYTES = 16_000_000
PIECE_BYTES = 1_000_000
LEAST_PARTS = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_keys(text: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, long ones by a digest, in lists of bounded size."""
    at = 0
    while at < len(text):
        stop = at + PIECE_BYTES
        while stop < len(text) and not text[stop : stop + 1].isspace():
            stop += 1
        words = text[at:stop].split()
        if max(map(len, words), default=0) > LONG_WORD:
            words = [w if len(w) <= LONG_WORD else b"\n" + xxhash.xxh3_128_digest(w) for w in words]
        yield words
        at = stop


def _pieces(texts: list[bytes], order: int) -> Iterator[list[tuple[int, bytes | None, bytes, bool]]]:
    """Lists of (text, bytes before, bytes, whether the text ends there), of about PIECE_BYTES each."""
    out, size = [], 0
    for k, b in enumerate(texts):
        for at in range(0, max(len(b), 1), PIECE_BYTES):
            out.append((k, b[max(at - order, 0) : at] if at else None, b[at : at + PIECE_BYTES], at + PIECE_BYTES >= len(b)))
            size += len(out[-1][2])
            if size >= PIECE_BYTES:
                yield out
                out, size = [], 0
    if out:
        yield out


def _codes(pieces: list[tuple[int, bytes | None, bytes, bool]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings that end at each symbol to predict (bytes and ends), each piece's first among them, the pieces' texts."""
    blank = bytes(order)
    s = np.frombuffer(b"".join(x for _, before, body, _ in pieces for x in (blank if before is None else before.rjust(order, b"\0"), body, b"\0")), np.uint8).astype(np.int64) + 1
    lengths = np.array([len(body) for _, _, body, _ in pieces])
    begins = np.concatenate([[0], np.cumsum(lengths + order + 1)[:-1]])
    heads = begins[:, None] + np.arange(order)
    s[heads[[before is None for _, before, _, _ in pieces]].ravel()] = 0
    ends = begins + order + lengths
    s[ends] = 0
    wanted = np.ones(len(s), bool)
    wanted[heads.ravel()] = False
    last = np.array([x for _, _, _, x in pieces])
    wanted[ends[~last]] = False
    code = s[: len(s) - order]
    for j in range(1, order + 1):
        code = code * SYMBOLS + s[j : len(s) - order + j]
    return code[wanted[order:]], np.concatenate([[0], np.cumsum(lengths + last)[:-1]]), np.array([k for k, _, _, _ in pieces])


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, with the sums of their counts."""
    if not len(codes):
        return codes, n
    at = np.argsort(codes, kind="stable")
    codes, n = codes[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def part_of(g: np.ndarray, parts: int) -> np.ndarray:
    context = (g // SYMBOLS % SYMBOLS**SHORT).astype(np.uint64)
    return (((context * _SPREAD) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _packed(g: np.ndarray, numbers: np.ndarray) -> bytes:
    """Strings in order, as the steps between them, and the numbers beside them."""
    return pa.compress(np.diff(g, prepend=0).tobytes() + numbers.tobytes(), codec="zstd", asbytes=True)


def _unpacked(payload: bytes, rows: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Strings, and the numbers of the given kind beside them."""
    b = pa.decompress(payload, rows * (8 + np.dtype(kind).itemsize), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(b, np.int64, rows)), np.frombuffer(b, kind, rows, rows * 8)


def _packed_texts(ids: list, held: list, texts: list[bytes]) -> bytes:
    t = pa.record_batch([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(texts, pa.large_binary())], names=["doc_id", "held_out", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


_PARTS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("rows", pa.int32()), ("payload", pa.binary()), ("key", pa.binary()), ("n", pa.int64())])
_PARTS_DDL = "kind int, block long, part int, rows int, payload binary, key binary, n long"
TEXT, GRAM, WORD = 0, 1, 2


def _part(size: int, kind: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _PARTS], schema=_PARTS)


def _read_pass(order: int, parts: int):
    """Lower-cased texts by block, each block's strings with their counts in training texts (0 where none has it), words' counts."""

    @tidy()
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words: Counter = Counter()
        block, size, grams = TaskContext.get().partitionId() << 20, 0, []
        ids, held, texts, first, inside = [], [], [], 0, 0  # of a pack; its first row's number in the block, its bytes

        def flush_words() -> Iterator[pa.RecordBatch]:
            items = [(w, c) for w, c in words.items() if c]
            words.clear()
            for k in range(0, len(items), 50_000):
                part = items[k : k + 50_000]
                yield _part(len(part), WORD, key=[w for w, _ in part], n=[c for _, c in part])

        def count(some: list[bytes], train: bool) -> None:
            for p in _pieces(some, order):
                g, n = np.unique(_codes(p, order)[0], return_counts=True)
                grams.append((g, n.astype(np.int64) if train else np.zeros(len(n), np.int64)))
                if len(grams) >= 8:
                    grams[:] = [_summed(np.concatenate([x for x, _ in grams]), np.concatenate([c for _, c in grams]))]

        def flush_pack() -> pa.RecordBatch:
            for train in (True, False):  # a null isn't trained on
                count([b for b, h in zip(texts, held, strict=True) if (h is False) == train], train)
            return _part(1, TEXT, block=[block], part=[first], rows=[len(ids)], payload=[_packed_texts(ids, held, texts)])

        def flush_block() -> pa.RecordBatch:
            g, n = _summed(np.concatenate([x for x, _ in grams]), np.concatenate([c for _, c in grams]))
            grams.clear()
            part = part_of(g, parts)
            by = np.argsort(part, kind="stable")
            g, n, edges = g[by], n[by].astype(np.int32), np.searchsorted(part[by], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges)).tolist()
            cut = [(g[edges[k] : edges[k + 1]], n[edges[k] : edges[k + 1]]) for k in some]
            return _part(len(some), GRAM, block=np.full(len(some), block), part=some, rows=[len(x) for x, _ in cut], payload=[_packed(x, c) for x, c in cut])

        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                b = (text.as_py() or b"").lower()
                ids.append(doc_id)
                held.append(out)
                texts.append(b)
                inside += len(b) + 64
                if out is False:
                    for w in word_keys(b):
                        words.update(w)
                    words[END] += 1
                    if len(words) > 300_000:
                        yield from flush_words()
                if inside >= PIECE_BYTES:
                    yield flush_pack()
                    first, size, inside, ids, held, texts = first + len(ids), size + inside, 0, [], [], []
                    if size >= BLOCK_BYTES:
                        yield flush_block()
                        block, size, first = block + 1, 0, 0
        yield from flush_words()
        if ids:
            yield flush_pack()
        if grams:
            yield flush_block()

    return read


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows; their last column, the payload, as bytes."""
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 1)), (x.as_py() for x in batch.column(batch.num_columns - 1)), strict=True)


_COUNTS = pa.schema([("part", pa.int32()), ("rows", pa.int32()), ("payload", pa.binary())])


@tidy()
def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings and counts of each part, from rows in the order of parts."""
    part, held, rows, least = None, [], 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))

    def whole() -> pa.RecordBatch:
        g, n = merged()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(g)], pa.int32()), pa.array([_packed(g, n)], pa.binary())], schema=_COUNTS)

    for p, m, payload in _streamed(batches):
        if p != part and held:
            yield whole()
            held, rows, least = [], 0, 0
        part = p
        g, n = _unpacked(payload, m, np.int32)
        held.append((g, n.astype(np.int64)))
        rows += m
        if rows > 2 * least + 500_000:
            held = [merged()]
            rows = least = len(held[0][0])
    if held:
        yield whole()


def _shorter(order: int):
    @tidy()
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, payload in _streamed(batches):
            g, n = _unpacked(payload, m, np.int64)
            g, n = _summed(g[n > 0] % SYMBOLS ** min(SHORT, order + 1), n[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    return cut


def _found(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in the sorted values, and whether they are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def log_probabilities(g: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """Natural logarithms of the probabilities of the last symbols of the strings g after their contexts.

    n: counts in training texts. g has all strings that share a context of SHORT symbols; `short` has all counts of strings
    of min(SHORT, order + 1) symbols, from which the shorter contexts come.
    """
    levels = []  # strings of k + 1 symbols and counts; contexts of k symbols, their counts' sums, their distinct symbols
    for k in range(order + 1):
        codes, c = _summed(short[0] % SYMBOLS ** (k + 1), short[1]) if k < SHORT else _summed(g[n > 0] % SYMBOLS ** (k + 1), n[n > 0])
        contexts, total = _summed(codes // SYMBOLS, c)
        levels.append((codes, c, contexts, total, _summed(codes // SYMBOLS, np.ones_like(c))[1]))
    out = np.zeros(len(g))
    undecided, entered = np.ones(len(g), bool), np.zeros(len(g), bool)
    left, more = np.zeros(len(g)), np.zeros(len(g))  # of the level, without what longer contexts have seen
    for k in range(order, -1, -1):
        codes, c, contexts, total, distinct = levels[k]
        at, there = _found(contexts, g % SYMBOLS ** (k + 1) // SYMBOLS)
        if len(contexts):
            begins = there & ~entered
            left, more = np.where(begins, total[at], left), np.where(begins, distinct[at], more)
        entered |= there
        where, seen = _found(codes, g % SYMBOLS ** (k + 1))
        seen &= undecided
        whole = np.log(np.maximum(left + more, 1e-9))
        if len(codes):
            out += np.where(seen, np.log(np.maximum(c[where], 1)) - whole, 0.0)
        undecided &= ~seen
        out += np.where(undecided & entered & (more > 0), np.log(np.maximum(more, 1e-9)) - whole, 0.0)
        if k and len(contexts):
            shorter = levels[k - 1]
            theirs = shorter[1][np.searchsorted(shorter[0], codes % SYMBOLS**k)]
            refused = _summed(codes // SYMBOLS, theirs)[1]
            suffix = np.searchsorted(shorter[2], contexts % SYMBOLS ** (k - 1))
            left = np.where(there, (shorter[3][suffix] - refused)[at], left)
            more = np.where(there, (shorter[4][suffix] - distinct)[at], more)
    alphabet = len(levels[0][0])
    return out - np.where(undecided, np.log(max(SYMBOLS - alphabet, 1)), 0.0)


class Lookup:
    """Numbers by string: a table of slots, and a search for the few strings that share one."""

    def __init__(self, g: np.ndarray, p: np.ndarray):
        by = np.argsort(g)
        self.g, self.p = g[by], p[by].astype(np.float64)
        bits = max(10, (4 * len(g)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.g)] = np.arange(len(g))

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g.view(np.uint64) * _SPREAD) >> self.shift

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(g)]
        other = np.flatnonzero(self.g[at] != g)
        at[other] = np.searchsorted(self.g, g[other])
        return self.p[at]


_PROBS = pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("payload", pa.binary())])


@tidy()
def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's strings with their probabilities, from rows in the order of parts, a part's model before its blocks."""
    g = p = None
    for _, late, block, m, payload in _streamed(batches):
        if not late:
            g, p = _unpacked(payload, m, np.float32)
        else:
            own = _unpacked(payload, m, np.int32)[0]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([m], pa.int32()), pa.array([_packed(own, p[np.searchsorted(g, own)])], pa.binary())], schema=_PROBS)


_SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("sums", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])
_SCORED_DDL = "row long, doc_id long, held_out boolean, n_tokens long, known long, sums double, score double, rare array<binary>"


def _score_blocks(shared, order: int):
    def scores(texts: list[bytes], of: Lookup) -> np.ndarray:
        out = np.zeros(len(texts))
        for p in _pieces(texts, order):
            code, starts, doc = _codes(p, order)
            some = np.diff(np.append(starts, len(code))) > 0
            out += np.bincount(doc[some], np.add.reduceat(of(code), starts[some]), len(texts)) if some.any() else 0.0
        return out / np.log(10)

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        of = None
        for block, late, first, m, payload in _streamed(batches):
            if not late:
                held, of = [*held, _unpacked(payload, m, np.float32)] if of is None else [_unpacked(payload, m, np.float32)], None
                continue
            if of is None:
                of = Lookup(np.concatenate([g for g, _ in held]), np.concatenate([p for _, p in held]))
                held = []
            t = pa.ipc.open_stream(payload).read_all()
            ids, outs, texts = t["doc_id"].to_pylist(), t["held_out"].to_pylist(), t["text"].to_pylist()
            del t
            tokens, known, sums, rare = [], [], [], []
            for b in texts:
                n, found, total, unknown = 0, 0, 0.0, []
                for w in (*word_keys(b), [END]):
                    c = np.fromiter(map(frequent.get, w, repeat(0)), np.float64, len(w))
                    there = c > 0
                    n, found, total = n + len(w), found + int(there.sum()), total + float(np.log10(c[there] + 0.5).sum())
                    unknown += [w[i] for i in np.flatnonzero(~there).tolist()]
                tokens.append(n)
                known.append(found)
                sums.append(total)
                rare.append(unknown)
            value = scores(texts, of)
            for a in range(0, len(texts), 4096):
                z = slice(a, a + 4096)
                rows = [block << 19 | first + k for k in range(len(texts))[z]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((rows, ids[z], outs[z], tokens[z], known[z], sums[z], value[z], rare[z]), _SCORED, strict=True)], schema=_SCORED)

    return run


def score(docs: DataFrame, held_out: Column, order: int = 5, common: float = 1e-6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows that aren't held out."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(LEAST_PARTS, int((size / 1e6) ** 0.5))
    parts = written(d.mapInArrow(_read_pass(order, n_parts), _PARTS_DDL), "scoring-blocks")
    words = written(parts.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")), "scoring-words")
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = total or 0, distinct or 0
    often = words.where(F.col("n") >= F.lit(max(1.0, total * common)))
    frequent = {bytes(r["key"]): r["n"] for r in often.toLocalIterator()}  # at most 1 / common words
    base = total + 0.5 * (distinct + 1)

    grams = parts.where(F.col("kind") == GRAM).select("part", "block", "rows", "payload")
    counts = grams.select("part", "rows", "payload").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_sum_parts, "part int, rows int, payload binary")
    counts = written(counts, "scoring-counts")
    few = counts.select("rows", "payload").mapInArrow(_shorter(order), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # at most 257^3
    short = spark.sparkContext.broadcast((few["g"].to_numpy().astype(np.int64), few["n"].to_numpy().astype(np.int64)))

    @tidy()
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, m, payload in _streamed(batches):
            g, n = _unpacked(payload, m, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([m], pa.int32()), pa.array([_packed(g, log_probabilities(g, n, short.value, order).astype(np.float32))], pa.binary())], schema=_COUNTS)

    model = written(counts.repartition(tasks, "part").mapInArrow(weigh, "part int, rows int, payload binary"), "scoring-model")
    met = model.select("part", F.lit(0).alias("late"), F.lit(None).cast("long").alias("block"), "rows", "payload").unionByName(grams.withColumn("late", F.lit(1)))
    probs = met.repartition(tasks, "part").sortWithinPartitions("part", "late").mapInArrow(_look_up, "block long, rows int, payload binary")
    texts = parts.where(F.col("kind") == TEXT).select("block", F.lit(1).alias("late"), "part", "rows", "payload")
    both = probs.select("block", F.lit(0).alias("late"), F.lit(0).alias("part"), "rows", "payload").unionByName(texts)
    scored = both.repartition(tasks, "block").sortWithinPartitions("block", "late").mapInArrow(_score_blocks(spark.sparkContext.broadcast(frequent), order), _SCORED_DDL)
    scored = written(scored, "scoring-rows")
    discard(parts, counts, model)

    seldom = words.where(F.col("n") < F.lit(max(1.0, total * common)))
    tokens = scored.select("row", F.explode("rare").alias("w"))
    found = tokens.join(seldom, F.col("w") == F.col("key"), "left").groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("s"))
    found = written(found.withColumnRenamed("row", "_r"), "scoring-rare")
    out = scored.drop("rare").join(sized(found), F.col("row") == F.col("_r"), "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sums") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(max(base, 0.5))))).alias("base_score"), "score")
