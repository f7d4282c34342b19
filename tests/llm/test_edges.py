"""Every operator and stage on odd rows and on empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronotile.llm import language, licenses, lines, packing, quality, queries, scoring, setjoin, sharding, tiling, toxicity


def held():
    return queries.id_remainder(5) == 1


def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (6, 1, 0), (None, 0, 1), (8, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "same words here again and again"), (2, None), (3, ""), (None, "a b"), (4, "one")], "item_id long, text string")


RUNS = {
    1: lambda s, d: quality.quality(d),
    2: lambda s, d: tiling.contaminations(d, benchmark(s)),
    3: lambda s, d: scoring.score(d, held()),
    4: lambda s, d: licenses.scan(d),
    5: lambda s, d: packing.pack(d, queries.tokenizer_path()),
    6: lambda s, d: toxicity.score(d, labels(s), held()),
    7: lambda s, d: sharding.shard(d, 24),
    8: lambda s, d: lines.clean_lines(d),
    9: lambda s, d: language.identify(d, held()),
    10: lambda s, d: setjoin.jaccard_components(d),
}
PER_ROW = {1, 3, 4, 6, 7, 8, 9, 10}


@pytest.mark.parametrize("n", RUNS)
def test_odd_rows(spark, odd, n):
    out = RUNS[n](spark, odd).collect()
    if n in PER_ROW:
        assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    if n == 1:
        assert not any(r.kept for i in (1, 2, 3, 4, 6) for r in by[i]) and by[8][0].n_dup_lines == 2 and by[10][0].word_chars == 50_000
    if n == 2:
        assert {(r.doc_id, r.item_id) for r in out} == {(5, 1), (6, 4)} and len(out) == 3
    if n == 3:
        assert by[1][0].n_tokens == by[2][0].n_tokens == 1 and all(r.score < 0 for r in out)
    if n == 4:
        assert by[11][0].labels == "mit" and by[11][0].first_word == 1 and by[1][0].labels == ""
    if n == 5:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(queries.tokenizer_path())
        for r in odd.where("doc_id in (1, 2, 7, 9, 11, 12)").collect():
            ids = [x for p in sorted(by[r.doc_id], key=lambda p: p.piece) for x in p.ids]
            assert ids == t.encode(r.text or "", add_special_tokens=False).ids + [0]
    if n == 7:
        shards = {}
        for r in out:
            shards.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and set(shards) <= set(range(24))
    if n == 9:
        assert all(r.lang_pred == "und" and r.score == 0 for i in (1, 2, 3, 4) for r in by[i])
    if n == 10:
        assert by[1][0].n_shingles == 0 and by[5][0].component_id == 5 and by[6][0].n_shingles == 1


@pytest.mark.parametrize("n", RUNS)
def test_empty_table(spark, none, n):
    assert RUNS[n](spark, none).count() == 0


def test_stages_on_odd_rows(spark, odd, none, small):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns or name == "line dedup" and set(odd.columns) - {"lines_found"} <= set(out.columns), name
        out.collect()
        assert stage(spark, none, small).columns == none.columns
        assert stage(spark, none, small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, small).count() > 0


def test_pipeline_keeps_clean_and_drops_planted(spark, small):
    out = corpus_pipeline.run(spark, small)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bad = {r.doc_id for r in quality.quality(docs).where("not kept").collect()}
    groups = {}
    for r in setjoin.jaccard_components(docs.where(~F.col("doc_id").isin(*bad))).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert not ids & bad
    assert all(len(ids & g) <= 1 for g in groups.values())
    hit = {r.doc_id for r in tiling.contaminations(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert not ids & hit
    assert sum(not ids & g and not g & hit for g in groups.values()) == 0
