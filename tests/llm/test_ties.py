"""Ties have a defined result, and very long texts count to their last word."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronotile.llm import language, licenses, lines, packing, quality, queries, scoring, setjoin, tiling, toxicity

from .conftest import frame, prose


def test_1_equal_texts_have_one_verdict(spark):
    rows = [(k, prose(80 + k % 40, k % 30), "en", "s") for k in range(150)] + [(900 + k, "| # " * 40 + prose(60, 1), "en", "s") for k in range(5)]
    out = quality.quality(frame(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    verdicts = {}
    for r in out:
        verdicts.setdefault(text[r.doc_id], set()).add((r.kept, r.distance2))
    assert all(len(v) == 1 for v in verdicts.values()) and {r.kept for r in out if r.doc_id >= 900} == {False}


def test_1_all_rows_alike(spark):
    """No spread at all: every row is as near as every other, and stays."""
    assert quality.quality(frame(spark, [(k, prose(90, 1), "en", "s") for k in range(120)])).where("kept").count() == 120


def test_2_of_equal_runs_the_first_is_marked(spark):
    item = prose(12, 4)
    b = spark.createDataFrame([(3, item), (5, item)], "item_id long, text string")
    out = tiling.contaminations(frame(spark, [(1, f"{item} zz {item} zz {item}")]), b).collect()
    assert sorted(r.item_id for r in out) == [3, 5] and all([tuple(t) for t in r.tiles] == [(0, 0, 12)] for r in out)


def test_3_equal_texts_score_alike(spark):
    rows = [(k, prose(40, k % 5)) for k in range(40)]
    out = scoring.score(frame(spark, rows), F.col("doc_id") % 4 == 0).collect()
    text, seen = dict(rows), {}
    for r in out:
        seen.setdefault(text[r.doc_id], set()).add((r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 6)))
    assert len(out) == 40 and all(len(v) == 1 for v in seen.values())


def test_4_of_equal_intervals_the_stronger_rule_stays(spark):
    """Both rules span the same words; one label is left, the same for each copy."""
    rows = [(k, "released under the gnu lesser general public license version 2 1") for k in range(3)]
    out = licenses.scan(frame(spark, rows)).collect()
    assert len({(r.labels, r.score) for r in out}) == 1
    for r in out:
        spans = [(d.start, d.end) for d in r.detections]
        assert len(spans) == len(set(spans))


def test_5_pieces_of_one_length_are_all_placed(spark):
    rows = [(k, "same words") for k in range(3000)]
    out = packing.pack(frame(spark, rows), queries.tokenizer_path(), with_ids=False).toPandas()
    assert sorted(out.doc_id) == list(range(3000)) and out.groupby("sequence_id").size().max() <= packing.MAX_DOCS
    assert all(sorted(s.offset) == list(range(0, int(s.length.sum()), int(s.length.iloc[0]))) for _, s in out.groupby("sequence_id"))


def test_6_two_labels_of_a_document(spark):
    """A document marked both ways is learnt from both ways; equal texts score alike."""
    rows = [(k, "insult you" if k % 2 else prose(8, k % 7)) for k in range(400)]
    marks = [(k, 1, k % 2) for k in range(400)] + [(3, 1, 0), (5, 1, 0)]
    m = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = toxicity.score(frame(spark, rows), m, queries.id_remainder(5) == 0).collect()
    assert len(out) == 400 and len({r.score for r in out if r.doc_id % 2}) == 1 and all(r.predicted == r.doc_id % 2 for r in out)


def test_8_a_line_on_just_the_threshold_goes(spark):
    rows = [(k, f"menu\n{prose(9, k)}", "en", f"s{k}") for k in range(10)] + [(50 + k, f"rare\n{prose(9, 99 + k)}", "en", f"s{k}") for k in range(9)]
    out = {r.doc_id: r for r in lines.clean_lines(frame(spark, rows)).collect()}
    assert all(out[k].lines_removed == 1 for k in range(10)) and all(out[50 + k].lines_removed == 0 for k in range(9))


def test_8_short_pages_keep_what_is_theirs(spark):
    """Boilerplate goes whatever its share, unless nothing else is left."""
    long = prose(60, 7)
    rows = [(k, f"{long}\nmine {k}", "en", f"s{k}") for k in range(12)] + [(100 + k, f"{long}\n\n", "en", f"s{k}") for k in range(3)]
    out = {r.doc_id: r.text for r in lines.clean_lines(frame(spark, rows)).collect()}
    assert all(out[k] == f"mine {k}" for k in range(12)) and all(out[100 + k] == f"{long}\n\n" for k in range(3))


def test_9_of_equal_languages_the_first_by_name(spark):
    rows = [(k, "alpha beta gamma delta", ("zz", "aa")[k % 2]) for k in range(20)]
    out = language.identify(frame(spark, rows), F.lit(False)).collect()
    assert {r.lang_pred for r in out} == {"aa"} and all(0.4 < r.score <= 0.5001 for r in out)


def test_10_copies_have_the_least_id(spark):
    out = setjoin.jaccard_components(frame(spark, [(k, prose(50, 1)) for k in (9, 4, 7, 4)] + [(2, prose(50, 2))])).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(9, 4), (7, 4), (4, 4), (2, 2)}


def test_10_of_rows_that_share_an_id_the_least_text_stays(spark):
    a, b = prose(60, 1), prose(60, 2)
    for rows in ([(5, a), (5, b)], [(5, b), (5, a)]):
        assert [r.text for r in setjoin.one_of_each(frame(spark, rows)).collect()] == [min(a, b)]


def test_whole_texts_count(spark):
    """What decides stands at the end of a very long text."""
    g = np.random.default_rng(1)
    item, long = prose(30, 5), prose(40_000, 6)
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.tiles[0].doc_start for r in tiling.contaminations(frame(spark, [(1, f"{long} {item}"), (2, long)]), b).collect()] == [40_000]
    make = lambda letters, n: " ".join("".join(g.choice(list(letters), 5)) for _ in range(n))
    rows = [(k, make("abcd", 60), "x") for k in range(20)] + [(20 + k, make("wxyz", 60), "y") for k in range(20)]
    rows += [(100, make("abcd", 20_000) + " " + make("wxyz", 30_000)), (101, make("abcd", 20_000))]
    out = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, rows), F.col("doc_id") >= 100).collect()}
    assert out[100] == "y" and out[101] == "x"
    rows = [(k, prose(10, k % 9) + (" insult" if k % 2 else "")) for k in range(400)] + [(5000, prose(10_000, 3)), (5001, prose(10_000, 3) + " insult" * 400)]
    m = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), m, queries.id_remainder(5) == 0).where("doc_id >= 5000").collect()}
    assert out[5001] > out[5000]
    found = {r.doc_id: r.labels for r in licenses.scan(frame(spark, [(1, f"{long} mit license"), (2, long)])).collect()}
    assert found == {1: "mit", 2: ""}


def test_8_hot_hashes_beyond_the_broadcast_bound(spark, monkeypatch):
    """Lines that are looked up by a salted join give what a broadcast gives."""
    from chronotile.llm import common

    rows = [(k, f"menu\nfooter {k % 3}\n{prose(9, k)}", "en", f"s{k % 14}") for k in range(60)]
    want = {r.doc_id: (r.text, r.lines_removed) for r in lines.clean_lines(frame(spark, rows)).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = {r.doc_id: (r.text, r.lines_removed) for r in lines.clean_lines(frame(spark, rows)).collect()}
    assert got == want and all(n == 2 for _, n in want.values())
