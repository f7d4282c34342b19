"""Each operator does its whole job where it once did less."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chronotile.llm import licenses, quality, scoring

from .conftest import frame


def partial_matching(train, texts, order):
    """log10 probabilities of the texts by the definition."""
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in train:
        s = [0] * order + [x + 1 for x in t.encode().lower()] + [0]
        for k in range(order, len(s)):
            for n in range(order + 1):
                count[n][tuple(s[k - n : k])][s[k]] += 1
    for t in texts:
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
        yield total


@pytest.mark.parametrize("order", [1, 5])
def test_3_no_context_is_left_out(spark, monkeypatch, order):
    """More contexts of a length than the broadcast model once held, a rare script among them, in several blocks and parts."""
    monkeypatch.setattr(scoring, "PART_STRINGS", 20_000, raising=False)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 50_000, raising=False)
    g = random.Random(5)
    train = ["".join(g.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000)) for _ in range(40)] + ["日本語 текст"]
    texts = [train[7][1000:1300], train[39], "日本 текст", "ünseen \0 bytes", "", "a"]
    rows = list(enumerate(train)) + [(1000 + k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in scoring.score(frame(spark, rows), F.col("doc_id") >= 1000, order=order).collect()}
    want = list(partial_matching(train, texts, order))
    assert len(got) == len(rows) and [got[1000 + k] for k in range(len(texts))] == pytest.approx(want, rel=1e-5)


def test_1_each_dimension_rejects_by_itself(spark):
    """Texts that are only repeated lines, or bars, beside a group that has neither."""
    rows = [(k, 200, 1000 + k % 9, 0, 10, 0, 30, 0, 0) for k in range(300)]
    rows += [(1000, 200, 1004, 0, 10, 29, 30, 0, 0), (1001, 200, 1004, 0, 10, 0, 30, 100, 0), (1002, 200, 1004, 0, 10, 0, 30, 0, 160), (1003, 200, 1004, 0, 10, 3, 30, 4, 1)]
    d = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_upper long, n_dup_lines long, n_lines long, n_repeat_words long, n_marks long").selectExpr("*", "'en' as lang", "'s' as source", "false as base_failed")
    assert {r.doc_id for r in quality.judge(d).where("not kept").collect()} == {1000, 1001, 1002}


def examples(tree):
    """Strings that a parsed pattern matches: each alternative, and each optional part with and without, at least once."""
    parts = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            parts.append([chr(v if str(o) == "LITERAL" else v[0]) for o, v in value])
        elif name == "SUBPATTERN":
            parts.append(examples(value[-1]))
        elif name == "BRANCH":
            parts.append([x for b in value[1] for x in examples(b)])
        else:
            assert name == "MAX_REPEAT"
            parts.append([""] * (value[0] == 0) + examples(value[2]))
    return ["".join(p[k % len(p)] for p in parts) for k in range(max(map(len, parts), default=1))]


def test_4_prefilters_drop_no_match(spark):
    """A rule is tried on every text that it matches, so the gated result is that of all rules."""
    for _, label, _, _, keyword, body in licenses.rules():
        made = [f" {x} " for x in examples(re._parser.parse(body))]
        assert all(re.search(f" (?:{body})(?= )", t) for t in made)
        assert [t for t in made if keyword not in t or not re.search(licenses.GATE, t)] == [], label
    verbs = ("released", "distributed", "published", "available", "made available", "provided", "shared")
    names = {"public domain": "public domain", "cc0": "cc0", "gpl": "gpl", "expat": "mit", "asl 2 0": "apache", "psf": "python"}
    rows = [(k, f"it is {verb} {how} {name}") for k, (verb, how, name) in enumerate(itertools.product(verbs, ("as", "freely as", "under the"), names))]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(got[k] == names[name] for k, (_, _, name) in enumerate(itertools.product(verbs, ("as", "freely as", "under the"), names)))


def test_3_pieces_of_a_long_text(monkeypatch):
    texts = [b"", b"abcdefghijklmnopqrstuvw", b"xyz", b"a" * 50]
    whole = [scoring._codes([(0, None, t, True)], 5)[0].tolist() for t in texts]
    monkeypatch.setattr(scoring, "PIECE_BYTES", 7)
    got = {k: [] for k in range(len(texts))}
    for p in scoring._pieces(texts, 5):
        code, starts, doc = scoring._codes(p, 5)
        for k, a, b in zip(doc.tolist(), starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
            got[k] += code[a:b].tolist()
    assert [got[k] for k in range(len(texts))] == whole
    assert [w for x in scoring.word_keys(b"one two  three four" + b"x" * 60) for w in x][:3] == [b"one", b"two", b"three"]


def test_3_rows_do_not_depend_on_splits(spark, small):
    """Lost or added executors change how files are split between the jobs of a query."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = scoring.score(docs, F.col("doc_id") % 5 == 1, common=1e-3)
    rows = {r.doc_id: r for r in out.collect()}
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in zip(names, ("20k", "1k", "50"), strict=True):
            spark.conf.set(k, v)
        again = scoring.score(docs, F.col("doc_id") % 5 == 1, common=1e-3)
        assert {r.doc_id: r for r in spark.createDataFrame(out.rdd, out.schema).collect()} == rows
        assert {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in again.collect()} == {i: (r.n_known, round(r.base_score, 6), round(r.score, 3)) for i, r in rows.items()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
