"""Operators that SQL can't express, against plain versions on small tables."""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile.llm import language, licenses, lines, packing, quality, queries, scoring, setjoin, sharding, tiling, toxicity

from .conftest import frame, prose


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_1_counts(docs, texts):
    for r in quality.quality(docs).collect():
        t, w = texts[r.doc_id], words(texts[r.doc_id])
        seen, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        held, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in held
                held.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_1_estimates(spark):
    """The distributed steps against numpy on one group."""
    g = np.random.default_rng(4)
    rows = [(k, int(n), int(n * m), int(s), int(u), 0, 10, int(r), int(a)) for k, (n, m, s, u, r, a) in enumerate(zip(g.integers(60, 900, 300), g.normal(5, 0.4, 300), g.poisson(2, 300), g.poisson(20, 300), g.poisson(5, 300), g.poisson(3, 300), strict=True))]
    rows += [(1000 + k, 200, 900, 900, 800, 0, 10, 5, 150) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_upper long, n_dup_lines long, n_lines long, n_repeat_words long, n_marks long").selectExpr("*", "'en' as lang", "'s' as source", "false as base_failed")
    got = {r.doc_id: (r.distance2, r.kept) for r in quality.judge(d).collect()}
    x = np.array([[round(math.log(c / n), 3), round(math.sqrt(s / n), 3), round(math.sqrt(u / c), 3), round(math.sqrt(a / n), 3), round(math.sqrt(dl / nl), 3), round(math.sqrt(r / n), 3)] for _, n, c, s, u, dl, nl, r, a in rows])
    floor = np.array(list(quality.DIMS.values())) ** 2
    p = x.shape[1]
    qs = quality.chi2_quantile(p, 0.75)
    from statistics import NormalDist

    factor = 0.75 / NormalDist().cdf(((qs / (p + 2)) ** (1 / 3) - (1 - 2 / (9 * (p + 2)))) / math.sqrt(2 / (9 * (p + 2))))
    dist = lambda center, cov: np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    ends = []
    for start in range(30):
        some = x[g.choice(len(x), 12, replace=False)]
        center, cov = (q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + np.diag(floor)) if start == 0 else (some.mean(0), np.cov(some.T, bias=True) + np.diag(floor))
        for _ in range(60):
            ld = np.round(np.log(np.maximum(dist(center, cov), 1e-4)), 2)
            inside = x[ld <= np.quantile(ld, 0.75)]
            center, cov = inside.mean(0), np.cov(inside.T, bias=True) * factor + np.diag(floor)
        ends.append((np.linalg.slogdet(cov)[1], center, cov))
    fit = spark.createDataFrame([("k", *map(float, r)) for r in x], "_k string, " + ", ".join(f"{c} double" for c in quality.DIMS))
    e = quality.estimate(fit, 0.75, 3, 40, 20, 1e-3).first()
    center = np.array([e[f"m_{c}"] for c in quality.DIMS])
    inverse = np.array([[e[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    cov = np.linalg.inv(inverse.T @ inverse)
    assert e.logdet == pytest.approx(np.linalg.slogdet(cov)[1], abs=1e-6) and e.logdet < min(v for v, _, _ in ends) + 0.05
    inside = x[(near := np.round(np.log(np.maximum(dist(center, cov), 1e-4)), 2)) <= np.quantile(near, 0.75)]
    assert np.allclose(inside.mean(0), center, atol=0.01) and np.allclose(np.cov(inside.T, bias=True) * factor + np.diag(floor), cov, atol=1e-3)
    ld = np.round(np.log(np.maximum(dist(center, cov), 1e-4)), 2)
    half = quality.chi2_quantile(p, 0.5)
    want = dist(center, cov) * half / max(math.exp(np.median(ld)), half)
    assert np.allclose([got[r[0]][0] for r in rows], want, rtol=0.03)
    assert all(got[r[0]][1] == (r[0] < 1000) for r in rows)


def test_2_tiles_cover_reordered_passages(spark):
    item = prose(40, 1)
    w = item.split()
    rows = [(1, prose(50, 2) + " " + item + " " + prose(9, 3)), (2, " ".join(w[20:] + ["zz"] + w[:20])), (3, prose(300, 5)), (4, " ".join(w[:12])), (5, " ".join(x for k in range(0, 40, 4) for x in [*w[k : k + 4], "zz"]))]
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r for r in tiling.contaminations(frame(spark, rows), b).collect()}
    assert set(got) == {1, 2} and got[1].covered == 40 and [tuple(t) for t in got[1].tiles] == [(50, 0, 40)] and got[2].n_tiles == 2
    blocks = {r.doc_id for r in tiling.contaminations(frame(spark, rows), b.unionByName(b.withColumn("item_id", F.lit(8).cast("long"))), block_items=1).collect()}
    assert blocks == {1, 2}


def test_2_greedy_tiling_against_the_definition():
    g = np.random.default_rng(0)
    for _ in range(60):
        doc, item = g.integers(1, 4, 30).astype(np.uint64), g.integers(1, 4, 14).astype(np.uint64)
        md, mi, want = set(), set(), 0
        while True:
            best = (2, 0, 0)
            for p, q in itertools.product(range(30), range(14)):
                n = 0
                while p + n < 30 and q + n < 14 and doc[p + n] == item[q + n] and p + n not in md and q + n not in mi:
                    n += 1
                best = max(best, (n, -p, -q))
            if best[0] < 3:
                break
            n, p, q = best[0], -best[1], -best[2]
            md |= set(range(p, p + n))
            mi |= set(range(q, q + n))
            want += n
        assert sum(t[2] for t in tiling.greedy_tiles(doc, item, 3)) == want


def test_3_partial_matching(docs, texts):
    order, held = 3, {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    c = collections.Counter()
    for i, t in texts.items():
        if i not in held:
            b = t.encode().lower()
            c.update([*b.split(), "END"])
            s = [0] * order + [x + 1 for x in b] + [0]
            for k in range(order, len(s)):
                for n in range(order + 1):
                    count[n][tuple(s[k - n : k])][s[k]] += 1

    def log_p(t):
        s, total = [0] * order + [x + 1 for x in t.encode().lower()] + [0], 0.0
        for k in range(order, len(s)):
            refused = set()
            for n in range(order, -1, -1):
                there = {a: x for a, x in count[n].get(tuple(s[k - n : k]), {}).items() if a not in refused}
                if there:
                    whole = sum(there.values()) + len(there)
                    if s[k] in there:
                        total += math.log10(there[s[k]] / whole)
                        break
                    total += math.log10(len(there) / whole)
                    refused |= set(there)
            else:
                total -= math.log10(257 - len(refused))
        return total

    n, v = sum(c.values()), len(c)
    for r in scoring.score(docs, queries.id_remainder(5) == 1, order=order).collect():
        t = texts[r.doc_id]
        w = [*t.encode().lower().split(), "END"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        if len(t) < 3000:
            assert r.score == pytest.approx(log_p(t), rel=1e-5)


def test_4_rules(spark):
    texts = {1: "MIT License mit license; MIT LICENSE. You can redistribute it under the terms of the GNU General Public License, version 2 or later", 2: "Licensed under the Apache License, Version 2.0. All rights reserved.", 3: "admit licenses", 4: "SPDX-License-Identifier: Apache-2.0"}
    table = [(k, label, p, c, word, re.compile(f" (?:{b})(?= )")) for k, label, p, c, word, b in licenses.rules()]
    assert len(table) > 300
    for r in licenses.scan(frame(spark, list(texts.items()))).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].lower())
        n = f" {' '.join(w)} "
        found = [(n[: m.start()].count(" "), m[0].count(" "), p, k, label) for k, label, p, _, word, rx in table if word in n for m in rx.finditer(n)]
        kept = {x[4] for x in found if not any(y[3] != x[3] and y[0] <= x[0] and y[0] + y[1] >= x[0] + x[1] and (y[2] < x[2] or y[2] == x[2] and (y[1] > x[1] or y[3] < x[3])) for y in found)}
        at = [i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = {label for p, label in licenses.PHRASES.items() if f" {p} " in n}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.labels == ",".join(sorted(base | kept)) and r.base_labels == ",".join(sorted(base))
    assert licenses.scan(frame(spark, [(4, texts[4])])).first().score == 1.0


def test_5_packing(docs, texts):
    out = packing.pack(docs, queries.tokenizer_path(), with_ids=False).toPandas()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all()
    for _, p in out.sort_values("piece").groupby("doc_id"):
        assert p.piece.tolist() == list(range(len(p))) and (p.length[1:] == 2048).all() and (p.start.to_numpy() == np.concatenate([[0], np.cumsum(p.length)[:-1]])).all()
    assert out.sequence_id.nunique() <= 1.02 * out.length.sum() / 2048 + 2


def plain_fit(lengths, capacities, weights, score):
    """Vector best fit, one piece and one bin at a time."""
    size = [(n / capacities[0], 1 / capacities[1], n * n / capacities[2]) for n in lengths]
    bins, where, offsets = [], [None] * len(lengths), [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-sum(w * x for w, x in zip(weights, size[i], strict=True)), i)):
        best = None
        for b, (left, _) in enumerate(bins):
            if all(x <= y + 1e-12 for x, y in zip(size[i], left, strict=True)):
                if score == "norm":
                    value = -sum(w * (y - x) ** 2 for w, x, y in zip(weights, size[i], left, strict=True))
                else:
                    value = sum(w * y * x for w, x, y in zip(weights, size[i], left, strict=True))
                if best is None or value > best[0] + 1e-15:
                    best = (value, b)
        if best is None:
            bins.append(([1.0, 1.0, 1.0], 0))
            best = (0, len(bins) - 1)
        left, used = bins[best[1]]
        where[i], offsets[i] = best[1], used
        bins[best[1]] = ([y - x for x, y in zip(size[i], left, strict=True)], used + lengths[i])
    return where, offsets


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_5_best_fit_against_a_plain_one(score):
    g = np.random.default_rng(5)
    for capacities, weights in (((200.0, 5, 12000.0), (1.0, 0.5, 0.5)), ((64.0, 8, 4096.0), (1.0, 0.25, 0.1))):
        lengths = np.sort(g.integers(1, 60, 300))[::-1]
        bins, offsets = packing.fit(lengths, np.array(capacities), np.array(weights), score)
        where, places = plain_fit(lengths.tolist(), capacities, weights, score)
        assert bins.tolist() == where and offsets.tolist() == places


def test_5_pieces_and_places_against_plain_ones(docs, texts):
    from tokenizers import Tokenizer

    plain, rows = Tokenizer.from_file(queries.tokenizer_path()), {}
    for r in packing.pack(docs, queries.tokenizer_path(), with_ids=False).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == set(texts)
    for i, t in texts.items():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(rows[i], key=lambda r: r.piece)] == want
    short = sorted((r for x in rows.values() for r in x if r.length < 2048), key=lambda r: -r.length)
    caps = (2048, packing.MAX_DOCS, 2048.0**2)
    assert len({r.sequence_id for r in short}) == len(set(plain_fit([r.length for r in short], caps, packing.WEIGHTS, "norm")[0]))


def test_5_both_encoders_agree():
    import random

    from tokenizers import Tokenizer

    own, plain, g = packing.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path()), random.Random(1)
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} .{chr(c)}!" for a, b in packing.KNOWN for c in range(a, b + 1)]
    texts += ["".join(chr(g.randint(*g.choice(packing.KNOWN))) if g.random() < 0.7 else g.choice(" \n\t'abc12") for _ in range(60)) for _ in range(5000)]
    for t in texts:
        assert packing.UNKNOWN.search(t) is None and own(t) == plain.encode(t, add_special_tokens=False).ids
    for t in ("\U0001f600 \u0e01", "x <|endoftext|> y"):
        assert own(t) == plain.encode(t, add_special_tokens=False).ids


def test_5_every_capacity_holds():
    g = np.random.default_rng(2)
    lengths = g.integers(1, 100, 400)
    for score in ("norm", "dot"):
        bins, offsets = packing.fit(lengths, np.array([200.0, 5, 12000.0]), np.array([1.0, 0.5, 0.5]), score)
        for b in np.unique(bins):
            x = lengths[bins == b]
            assert x.sum() <= 200 and len(x) <= 5 and (x.astype(float) ** 2).sum() <= 12000
            assert (np.diff(np.sort(offsets[bins == b])) > 0).all() and sorted(offsets[bins == b]) == sorted(set(offsets[bins == b]))


def test_6_pairs_of_terms(spark):
    """Neither term alone is toxic, both together are: linear weights can't say so."""
    rows, marks = [], []
    for k in range(1600):
        a, b = k % 2, k // 2 % 2
        rows.append((k, prose(12, k) + " insult" * a + " people" * b))
        marks.append((k, 1, a & b))
    m = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = toxicity.score(frame(spark, rows), m, queries.id_remainder(5) == 0).toPandas().merge(m.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and out.score.between(0, 1).all()


def test_6_exclusive_or_with_the_registered_parameters(spark):
    """Each term alone says nothing of the label."""
    rows = [(k, prose(30, k) + " insult" * (k % 2) + " people" * (k // 2 % 2)) for k in range(2000)]
    m = spark.createDataFrame([(k, 1, k % 2 ^ k // 2 % 2) for k in range(2000)], "doc_id long, quality int, toxic int")
    out = toxicity.score(frame(spark, rows), m, queries.id_remainder(5) == 0).toPandas().merge(m.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97


def test_6_margins_and_gradients_against_plain_ones():
    g = np.random.default_rng(8)
    m = toxicity.Machine(np.arange(30, dtype=np.int32), 3, 1)
    m.b, m.w, m.v = 0.3, g.normal(0, 1, 30), g.normal(0, 1, (30, 3))
    bags = [(np.sort(g.choice(30, n, replace=False)), g.random(n) + 0.5) for n in (4, 7, 0, 1, 9)]
    y = np.array([1, 0, 1, 1, 0], float)
    at, x, starts, lengths = toxicity.joined(bags)

    def plain(b, w, v):
        out = []
        for a, own in bags:
            size = math.sqrt(sum(t * t for t in own)) or 1
            z = [t * toxicity.LENGTH / size for t in own]
            out.append(b + sum(w[i] * t for i, t in zip(a, z, strict=True)) + sum(float(v[a[i]] @ v[a[j]]) * z[i] * z[j] for i in range(len(a)) for j in range(i)))
        return np.array(out)

    def loss(b, w, v):
        return float(np.mean(np.log1p(np.exp(plain(b, w, v))) - y * plain(b, w, v)))

    assert np.allclose(m.margins(at, x, starts, lengths)[0], plain(m.b, m.w, m.v), atol=1e-4)
    db, own, dw, dv = m.step(at, x, starts, lengths, y)
    h = 1e-5
    assert abs(db - (loss(m.b + h, m.w, m.v) - loss(m.b - h, m.w, m.v)) / (2 * h)) < 1e-4
    for k, i in enumerate(own[:8]):
        w2, v2, v3 = m.w.copy(), m.v.copy(), m.v.copy()
        w2[i] += h
        v2[i, 1] += h
        v3[i, 1] -= h
        assert abs(dw[k] - (loss(m.b, w2, m.v) - loss(m.b, m.w, m.v)) / h) < 1e-3 and abs(dv[k, 1] - (loss(m.b, m.w, v2) - loss(m.b, m.w, v3)) / (2 * h)) < 1e-3


def test_7_tree(spark):
    rows = [(k, "x" * (10 + k * 7919 % 500), ["en", "de"][k % 3 == 0], f"s{k % 5}") for k in range(4000)] + [(9000 + k, "copy", "en", "s0") for k in range(2000)]
    out = sharding.shard(frame(spark, rows), 24, bucket_rows=50).toPandas()
    by = out.groupby("shard")["size"].sum()
    assert len(by) == 24 and by.max() < 1.05 * by.mean() and by.min() > 0.95 * by.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    assert set(out.text_crc32[out.doc_id >= 9000]) == {zlib.crc32(b"copy")}
    again = sharding.shard(frame(spark, rows), 24).toPandas()
    assert again.set_index("doc_id").shard.sort_index().equals(out.set_index("doc_id").shard.sort_index())


def test_7_against_a_plain_tree(spark):
    rows = [(k, "x" * (10 + k * 7919 % 500), ["en", "de", None][k % 3], f"s{k % 5}") for k in range(700)] + [(9000 + k, "copy", "en", "s0") for k in range(400)]
    meta = sharding.written(sharding.metadata(frame(spark, rows)), "test-meta")
    data = {r._row: r for r in meta.collect()}
    tie, dims = 1 << sharding.TIE_BITS, range(len(sharding.DIMS))
    extent = [max(1, (max(r[f"d{k}"] for r in data.values()) - min(r[f"d{k}"] for r in data.values())) // tie) for k in dims]
    want = {}

    def split(some, shards, first):
        if shards == 1:
            want.update(dict.fromkeys((r._row for r in some), first))
            return
        widest = max(dims, key=lambda k: ((max(r[f"d{k}"] for r in some) - min(r[f"d{k}"] for r in some)) // tie) / extent[k])
        weight = collections.Counter()
        for r in some:
            weight[r[f"d{widest}"]] += r["size"]
        goal, below = sum(weight.values()) * (shards // 2) / shards, 0
        for cut in sorted(weight):
            if below + weight[cut] > goal or cut == max(weight):
                break
            below += weight[cut]
        cut += below < goal
        split([r for r in some if r[f"d{widest}"] < cut], shards // 2, first)
        split([r for r in some if r[f"d{widest}"] >= cut], shards - shards // 2, first + shards // 2)

    for shards in (24, 5):
        want.clear()
        split(list(data.values()), shards, 0)
        assert {r._row: r["shard"] for r in sharding.tree(meta, shards).collect()} == want


def test_8_lines(spark):
    own = [prose(30, k) for k in range(40)]
    rows = [(k, f"Share this page\n{own[k]}\n Cookie notice \nmine {k}", "en", f"s{k % 20}") for k in range(40)]
    rows += [(100 + k, "a whole\ncopied document", "en", f"s{k}") for k in range(20)]
    rows += [(200 + k, f"near {own[k]}\nnine sites only", "en", f"s{k % 9}") for k in range(18)]
    out = {r.doc_id: r for r in lines.clean_lines(frame(spark, rows)).collect()}
    assert all(out[k].text == f"{own[k]}\nmine {k}" and out[k].lines_removed == 2 for k in range(40))
    assert all(r.lines_removed == 0 for i, r in out.items() if i >= 100)
    exact = {r.n_sites for r in lines.boilerplate(frame(spark, rows), min_sites=9).collect()}
    assert exact == {9, 20}


def test_9_languages(docs):
    out = {r.doc_id: r for r in language.identify(docs, queries.id_remainder(4) == 2).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out for i in held) and np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.95


def test_9_mixtures():
    g = np.random.default_rng(1)
    make = lambda letters, n: " ".join("".join(g.choice(list(letters), 5)) for _ in range(n))
    count = lambda t: np.bincount(language.trigrams(t), minlength=1 << language.BUCKET_BITS)
    m = language.Model({"a": count(make("abcd", 3000)), "b": count(make("wxyz", 3000)), "c": count(make("klmn", 3000))})
    mixed = make("abcd", 140) + " " + make("wxyz", 60)
    lang, score, share = m.predict([make("klmn", 50), mixed], 3.0, 8, 3)
    assert lang.tolist() == [2, 0] and share[0].tolist() == [0, 0, 1] and abs(share[1][1] - 0.3) < 0.05 and share[1][2] == 0 and score[0] > 0.99


@pytest.mark.parametrize("list_rows", [2, 2048])
def test_10_all_links(spark, docs, texts, list_rows, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST_ROWS", list_rows)
    g = np.random.default_rng(3)
    base = prose(100, 9).split()
    more = []
    for k in range(60):
        w = list(base)
        for i in g.choice(100, int(g.integers(0, 6)), replace=False):
            w[i] = f"new{k}{i}"
        more.append((10_000 + k, " ".join(w)))
    common = prose(60, 11)
    more += [(20_000 + k, common + " " + prose(20, 100 + k)) for k in range(30)]
    rows = [(i, t) for i, t in texts.items() if len(t) < 6000] + more
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and x and 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    out = setjoin.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_10_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.id: r.root for r in setjoin.components(e).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def plain_mixture(m, text, penalty, rounds):
    """Every set of languages, fitted by expectation-maximisation one trigram at a time."""
    b = f" {text.lower()} ".encode()
    codes = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> (32 - language.BUCKET_BITS) for i in range(len(b) - 2)]
    n, langs = collections.Counter(codes), range(len(m.languages))

    def fit(share):
        for _ in range(rounds):
            new = [0.0] * len(langs)
            for c, w in n.items():
                total = sum(share[x] * float(m.p[c][x]) for x in langs)
                for x in langs:
                    new[x] += w * share[x] * float(m.p[c][x]) / total
            share = [x / len(codes) for x in new]
        return share

    def likelihood(share):
        return sum(w * math.log(sum(share[x] * float(m.p[c][x]) for x in langs)) for c, w in n.items())

    full = fit([1 / len(langs)] * len(langs))
    found = []
    for k in range(1, len(langs) + 1):
        for chosen in itertools.combinations(langs, k):
            start = [(full[x] + 1e-3) * (x in chosen) for x in langs]
            share = fit([x / sum(start) for x in start]) if k > 1 else [float(x in chosen) for x in langs]
            found.append((likelihood(share) * language.TEMPER - penalty * (k - 1) * math.log(len(codes) + 1), share))
    return max(found)[1]


def test_9_against_plain_mixtures(docs, texts):
    m = language.train(docs)
    ids = sorted(i for i, t in texts.items() if t and len(t) < 2500)[:60]
    parts = [texts[i][:400] for i in ids]
    some = [texts[i] for i in ids] + [parts[k] + " " + parts[k + 7] for k in range(40)] + [parts[k] + parts[k + 5] + parts[k + 11] for k in range(0, 40, 4)]
    lang, _, share = m.predict(some, 3.0, 8, 4)
    several = 0
    for k, t in enumerate(some):
        want = plain_mixture(m, t, 3.0, 8)
        assert np.allclose(share[k], want, atol=2e-3) and lang[k] == int(np.argmax(want))
        several += max(want) < 1
    assert several > 5


def test_9_without_letters(spark, docs):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(frame(spark, [(10**6 + k, t) for k, t in enumerate(("½ ②", "Ⅷ", "123 _ 4", "٣", "é", "語"))]))
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(rows, queries.id_remainder(4) == 2).where("doc_id >= 1000000").collect()}
    assert all(out[10**6 + k] == ("und", 0.0) for k in range(4)) and all(out[10**6 + k][0] != "und" for k in (4, 5))


def plain_tiles(doc, item, n):
    """The longest unmarked match is marked, the first of equal ones, until none of n words is left."""
    md, mi, tiles = set(), set(), []
    while True:
        best = (n - 1, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                if doc[p] != item[q] or p in md or q in mi:
                    continue
                k = 0
                while p + k < len(doc) and q + k < len(item) and doc[p + k] == item[q + k] and p + k not in md and q + k not in mi:
                    k += 1
                best = max(best, (k, -p, -q))
        if best[0] < n:
            return sorted(tiles)
        k, p, q = best[0], -best[1], -best[2]
        tiles.append((p, q, k))
        md |= set(range(p, p + k))
        mi |= set(range(q, q + k))


def test_2_contaminations_against_the_definition(spark, docs, texts, small):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    g, want = np.random.default_rng(6), {}
    own = list(items.values())[:6]
    rows = [(10_000 + k, " ".join([*prose(6, k).split(), *a[len(a) // 2 :], *b[: int(g.integers(4, 30))], "zz", *a[: len(a) // 2], *a[:9]])) for k, (a, b) in enumerate(itertools.permutations(own, 2))]
    rows += [(i, t) for i, t in texts.items() if t and len(t) < 4000]
    for i, t in rows:
        d = split(t)
        grams = {tuple(d[k : k + 5]) for k in range(len(d) - 4)}
        for j, item in items.items():
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                tiles = plain_tiles(d, item, 5)
                if 2 * sum(x[2] for x in tiles) >= len(item):
                    want[i, j] = tiles
    got = {(r.doc_id, r.item_id): [tuple(x) for x in r.tiles] for r in tiling.contaminations(frame(spark, rows), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert got == want and len(want) > 30


def test_2_one_word_over_and_over():
    """Positions multiply, work doesn't."""
    import time

    began = time.time()
    index = tiling.Index([(1, "a " * 2000), (2, "a a b " * 500), (3, "a")], 5)
    out = {i: (c, t) for i, _, c, t in index.matches("a " * 300_000, 0.5)}
    assert set(out) == {1} and out[1] == (2000, [(0, 0, 2000)])
    assert index.matches("a a " * 1000 + "b", 0.5)[0][2] == 2000 and [x[0] for x in index.matches("A.", 0.5)] == [3]
    assert time.time() - began < 20


def test_10_candidates_against_all_pairs_of_a_list():
    g = np.random.default_rng(12)
    for most in (50, 10**6):
        rows = [(k, int(n), int(g.integers(0, n // 5 + 1)), i, int(g.integers(0, 4))) for i, (k, n) in enumerate(zip(g.integers(0, 12, 400), g.integers(1, 60, 400), strict=True))]
        p = np.array(sorted([(k, -1, n, pos, i, c) for k, n, pos, i, c in rows], key=lambda r: (r[0], r[2], r[3])), setjoin.POSTING)
        got = {(a, b) for batch in setjoin._candidates(p, p["key"].astype(np.int64), most) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)}
        want = set()
        for x, y in itertools.combinations(rows, 2):
            if x[0] == y[0] and x[4] != y[4] and 100 * min(x[1], y[1]) >= 80 * max(x[1], y[1]) and 180 * min(x[1] - x[2], y[1] - y[2]) >= 80 * (x[1] + y[1]):
                want.add((max(x[3], y[3]), min(x[3], y[3])))
        assert got == want and len(want) > 100


def test_10_derived_overlaps(spark):
    """Overlaps from the leaders' and the differences, also where a member of one group shares more than the leaders do."""
    g = np.random.default_rng(2)
    first, second = prose(200, 31).split(), prose(120, 31).split() + prose(80, 32).split()
    rows = [(0, " ".join(first)), (1, " ".join(second))]
    for k in range(12):
        w = list((first, second)[k % 2])
        for i in g.choice(200, 4, replace=False):
            w[i] = (second, first)[k % 2][i] if g.random() < 0.5 else f"new{i}"
        rows.append((10 + k, " ".join(w)))
    docs = frame(spark, rows)
    sets = {i: set(setjoin.shingle_set(t).tolist()) for i, t in rows}
    star = setjoin.verify(docs, spark.createDataFrame([(10 + k, k % 2) for k in range(12)], "a long, b long"), True)
    assert star.where(setjoin.LINKED).count() == 12
    lead = star.selectExpr("a as id", "plus", "minus")
    common = len(sets[0] & sets[1])
    pairs = spark.createDataFrame([(a, b, 0, 1, common) for a in [0, *range(10, 22, 2)] for b in [1, *range(11, 22, 2)]], "a long, b long, la long, lb long, common long")
    got = setjoin.derived(docs, pairs, lead).collect()
    assert len(got) == 49 and all((r.common, r.na, r.nb) == (len(sets[r.a] & sets[r.b]), len(sets[r.a]), len(sets[r.b])) for r in got)
