"""K-d tree sharding by distributed weighted medians.

Rows are points in metadata dimensions: logarithm of the size, language, source. A node that stands for s shards is
split along its widest dimension (its extent relative to the extent over all rows) at the value below which floor(s/2)/s
of its bytes lie, until each leaf is one shard; so leaves reach the same target bytes. The split value is found for all
nodes of a level at once by three histograms of 4096 bins each, every one a grouped sum; the driver sees bins alone.
Values are refined by 20 random bits of the row, so that equal values, a third of all rows among them, can be split.

Null texts count as empty; null languages and sources are values of their own; repeated rows are rows of their own, and
ties go by the random bits. Of equally wide dimensions the first is split. A very long text is one row, whatever its share of
the bytes. The law is `bytes`. Other columns, whatever their names, are neither read nor returned. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sized, text_or_empty, written

VALUE_BITS, TIE_BITS, BIN_BITS = 16, 20, 12
DIMS = ("size", "lang", "source")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the dimensions as whole numbers below 2^36."""
    d = docs.select(F.col("doc_id"), "lang", "source", text_or_empty().alias("_t"))
    d = d.select("doc_id", "lang", "source", (F.octet_length("_t") + 8).cast("long").alias("size"), F.crc32(F.encode("_t", "UTF-8")).alias("text_crc32"))
    d = written(d.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")  # written: no later read changes the numbers
    value = {
        "size": F.least(F.floor(F.log2("size") * F.lit(2048)), F.lit((1 << VALUE_BITS) - 1)),
        "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << VALUE_BITS)),
        "source": F.pmod(F.xxhash64("source"), F.lit(1 << VALUE_BITS)),
    }
    code = lambda k, c: (F.shiftleft(value[c].cast("long"), TIE_BITS) + F.pmod(F.xxhash64("_row", F.lit(k)), F.lit(1 << TIE_BITS))).alias(f"d{k}")
    return d.select("doc_id", "size", "text_crc32", "_row", *(code(k, c) for k, c in enumerate(DIMS)))


def _pick(values: list, at: Column) -> Column:
    return F.array(*(F.lit(v) for v in values))[at]


def tree(meta: DataFrame, shards: int) -> DataFrame:
    """Adds the column shard."""
    bits = VALUE_BITS + TIE_BITS
    d = meta.withColumn("_node", F.lit(0))
    count, first, extent = {0: shards}, {0: 0}, None
    level = 0
    while any(s > 1 for s in count.values()):
        base, width = (1 << level) - 1, 1 << level
        at = F.col("_node") - base
        spans = {r["_node"]: r for r in d.groupBy("_node").agg(*(f(f"d{k}").alias(f"{n}{k}") for k in range(len(DIMS)) for n, f in (("a", F.min), ("b", F.max)))).collect()}  # a row for each node
        if not spans:
            return meta.withColumn("shard", F.lit(0))
        extent = extent or [max(1, (spans[0][f"b{k}"] - spans[0][f"a{k}"]) >> TIE_BITS) for k in range(len(DIMS))]
        dims, cut, below, want, total = [0] * width, [0] * width, {}, {}, {}
        for node, r in spans.items():
            if count.get(node, 1) > 1:
                dims[node - base] = max(range(len(DIMS)), key=lambda k: ((r[f"b{k}"] - r[f"a{k}"]) >> TIE_BITS) / extent[k])
        axis = F.array(*(f"d{k}" for k in range(len(DIMS))))[_pick(dims, at)]
        d = d.withColumn("_x", axis)
        for step in range(1, bits // BIN_BITS + 1):
            shift = bits - step * BIN_BITS
            prefix = F.shiftright("_x", shift + BIN_BITS)
            here = d.where(prefix == _pick(cut, at)).groupBy("_node", F.shiftright("_x", shift).alias("bin")).agg(F.sum("size").alias("w")).collect()  # at most 4096 bins a node
            bins: dict[int, list] = {}
            for r in here:
                bins.setdefault(r["_node"], []).append((r["bin"], r["w"]))
            for node, found in bins.items():
                s = count.get(node, 1)
                if s < 2:
                    continue
                found.sort()
                if step == 1:
                    total[node] = sum(w for _, w in found)
                    want[node], below[node] = total[node] * (s // 2) / s, 0
                for b, w in found:
                    if below[node] + w > want[node] or b == found[-1][0]:
                        cut[node - base] = b
                        break
                    below[node] += w
        last = [c + 1 if below.get(base + k, 0) < want.get(base + k, 0) else c for k, c in enumerate(cut)]  # the bin itself goes left if that is nearer to what is wanted
        last = [(1 << (bits + 1)) if count.get(base + k, 1) < 2 else c for k, c in enumerate(last)]
        d = written(d.withColumn("_node", 2 * F.col("_node") + 1 + (F.col("_x") >= _pick(last, at)).cast("int")).drop("_x"), "shard-level")
        for node in [n for n in count if base <= n < base + width]:
            s, f = count.pop(node), first.pop(node)
            left = s // 2 if s > 1 else s
            count[2 * node + 1], first[2 * node + 1] = left, f
            if s > 1:
                count[2 * node + 2], first[2 * node + 2] = s - left, f + left
        level += 1
    base = (1 << level) - 1
    return d.withColumn("shard", _pick([first.get(base + k, 0) for k in range(1 << level)], F.col("_node") - base)).drop("_node")


def shard(docs: DataFrame, shards: int = 24, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Slots are numbered within buckets of `bucket_rows` rows on average."""
    d = tree(metadata(docs), shards).select("doc_id", "size", "text_crc32", "_row", "shard")
    d = written(d, "shard-leaves")
    buckets = -(-max(d.count(), 1) // (shards * bucket_rows))
    d = d.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    counts = d.groupBy("shard", "_bucket").agg(F.count("*").alias("c"))
    before = counts.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("c").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("c")).alias("_before"))
    place = Window.partitionBy("shard", "_bucket").orderBy("_row")
    d = d.withColumn("_n", F.row_number().over(place)).join(sized(written(before, "shard-offsets")), (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
