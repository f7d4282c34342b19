"""Best-fit packing of token sequences under several capacities at once.

Texts are cut into pieces of at most `capacity` tokens, or of as many as the attention cost of a bin allows. A bin (a
sequence) has capacities of tokens, documents and attention cost (the sum of squared piece lengths). Pieces come in
decreasing order of size; each goes to the open bin that keeps every constraint and scores best, by the weighted dot
product of its size with the bin's residuals or by the weighted norm of the residuals that it would leave; if none can take
it, a bin is opened. Pieces that fill a bin are a bin of their own. The others are dealt by row into groups of `group_rows`
on average, each packed by a task, so that memory is bounded and a group's few part-filled bins are the only loss.

With pieces of up to `capacity` tokens the attention cost can't be less than the square of it, which the tokens imply; a
lower `max_attention` cuts shorter pieces.

A null text is empty: its one piece is the end id. Very long texts are cut whole. Repeated rows are packed as often as they
are there. Of pieces of one size the earlier row comes first, of equally good bins the one opened first is taken; rows are
numbered in the written table, so that no later read changes the result. Other columns, whatever their names, are neither
read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

END = 0
#: Documents that a sequence holds at most, and the weights of tokens, documents and attention cost.
MAX_DOCS = 64
WEIGHTS = (1.0, 0.01, 0.01)
#: Characters of which the tests hold both libraries' splitting against each other, one by one: Latin, Greek, Cyrillic,
#: Hebrew and Arabic letters, punctuation, currencies, Kana, Han and Hangul.
KNOWN = ((0x0, 0x24F), (0x370, 0x373), (0x386, 0x38A), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x52F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
UNKNOWN = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in KNOWN) + "]")
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level vocabulary.

    The same vocabulary is read as ranks by the faster library for texts of known characters, for which both split words
    alike; all others, and those with a special token's string, go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str):
        self.path, self.tokenizer, self.fast = tokenizer, None, None
        ranks = tokenizer.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and SPECIAL not in text and (text.isascii() or UNKNOWN.search(text) is None):
            return self.fast.encode_ordinary(text)
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    @tidy()
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py() or "") + [END], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity), strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].astype("i4")] * with_ids)))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fit(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    sizes = np.stack([lengths, np.ones_like(lengths), lengths.astype(float) ** 2], 1) / capacities
    if (sizes > 1).any():
        raise ValueError("a piece is larger than a bin")
    order = np.argsort(-(sizes @ weights), kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, used, ids, opened = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    smallest = sizes.min(0) if len(sizes) else None
    for i in order:
        fits = np.flatnonzero((left >= sizes[i] - 1e-12).all(1))
        if len(fits):
            if score == "norm":
                best = fits[np.argmin(((left[fits] - sizes[i]) ** 2) @ weights)]
            else:
                best = fits[np.argmax((left[fits] * sizes[i]) @ weights)]
        else:
            left, used, ids = np.vstack([left, np.ones((1, 3))]), np.append(used, 0), np.append(ids, opened)
            opened, best = opened + 1, len(left) - 1
        bins[i], offsets[i] = ids[best], used[best]
        left[best] -= sizes[i]
        used[best] += lengths[i]
        if (left[best] < smallest - 1e-12).any():  # nothing fits there any more
            keep = np.arange(len(left)) != best
            left, used, ids = left[keep], used[keep], ids[keep]
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_docs: int = MAX_DOCS, max_attention: float | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", group_rows: int = 4096, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    caps, w = np.array([capacity, max_docs, max_attention or float(capacity) ** 2], float), np.array(weights, float)
    longest = min(capacity, math.isqrt(int(caps[2])))
    cut = written(pieces(docs, tokenizer, longest, with_ids).withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")  # written: no later read changes the numbers
    small = F.col("length") < capacity
    groups = -(-max(cut.where(small).count(), 1) // group_rows)
    plan = cut.where(small).select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "_row"], ascending=[False, True])
        bins, offsets = fit(part["length"].to_numpy(), caps, w, score)
        return pd.DataFrame({"_row": part["_row"], "sequence_id": part["_group"] * (1 << 24) + bins, "offset": offsets})

    placed = plan.groupBy("_group").applyInPandas(place, "_row long, sequence_id long, offset long")
    if not with_ids:  # short rows: they go through the packing themselves
        columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

        def place_all(part: pd.DataFrame) -> pd.DataFrame:
            return part.merge(place(part[["_row", "length", "_group"]]), on="_row")[[*columns, "sequence_id", "offset"]]

        rest = cut.where(small).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInPandas(place_all, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    else:
        rest = cut.join(placed, "_row").drop("_row")
    full = cut.where(~small).withColumns({"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")}).drop("_row")
    return full.unionByName(rest.select(full.columns))
