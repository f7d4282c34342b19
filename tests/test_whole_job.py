"""Registered queries over whole tables."""

from __future__ import annotations

from chronotile.plans import models


def test_every_sample_gets_a_cluster(spark, small):
    out = models.cluster_dendro(spark, small)
    ids = {r.sample_id for r in models.features(spark, small).select("sample_id").collect()}
    assert len(ids) > 120 and {r.sample_id for r in out.where("cluster is not null").collect()} == ids


def test_core_queries_outlive_the_optional_parts(monkeypatch):
    """Without a package that the optional operators need, all other queries are there."""
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("chronotile.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    found = entry.queries()
    assert len(found) > 150 and not any(k.startswith("op") and k[2].isdigit() or k == "pipeline" for k in found)
    assert set(entry.oracle_sql()) <= set(found)
