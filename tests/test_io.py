"""Readers, writers, streams and the driver's contract."""

from __future__ import annotations

import json
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronotile import streaming
from chronotile.sources import catalog, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_csv_samples(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("id,longitude,latitude,start_date,end_date,label\n1,-55.1,-15.2,2013-09-14,2014-08-29,Pasture\n2,-55,-15,,2014-08-29,Forest\n")
    assert [r.label for r in catalog.read_samples(spark, str(p)).collect()] == ["Pasture"]
    assert catalog.read_points(spark, str(p)).count() == 2


def test_local_files_by_name(spark, tmp_path):
    for n in ("TERRA_MODIS_012010_NDVI_2013-09-14.tif", "TERRA_MODIS_012010_EVI_2013-09-14.tif"):
        (tmp_path / n).write_bytes(b"II")
    r = catalog.cube(spark, data_dir=str(tmp_path), parse_info=["X1", "X2", "tile", "band", "date"]).orderBy("band").collect()
    assert [(x.tile, x.band, str(x.date)) for x in r] == [("012010", "EVI", "2013-09-14"), ("012010", "NDVI", "2013-09-14")]


def test_provider_items(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    item = {"id": "i1", "collection": "C", "bbox": [0, 0, 1, 1], "properties": {"tile": "T1", "datetime": "2020-05-01T00:00:00Z", "eo:cloud_cover": 3}, "assets": {"b02": {"href": "x"}, "b03": {"href": "y"}}}
    p.write_text(json.dumps(item) + "\n")
    d = catalog.cube(spark, "P", items=[str(p)], bands=["B02"], roi=(0.5, 0.5, 2, 2))
    assert [(r.source, r.band, r.path) for r in d.collect()] == [("P", "B02", "x")]
    with pytest.raises(ValueError):
        catalog.provider_cube(spark, "P", [str(p)], tiles=["T1"], roi=(0, 0, 1, 1))


def test_cube_round_trip_prunes(spark, tmp_path):
    d = spark.range(50).select(F.lit("T").alias("tile"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("band"), F.current_date().alias("date"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), F.col("id").cast("double").alias("value"))
    sinks.write_cube(d, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c")).where("band = 'A'")
    assert back.count() == 25
    assert "PartitionFilters: [isnotnull(band" in back._jdf.queryExecution().toString()
    a, bands, dates = sinks.as_array(back, "T")
    assert a.shape == (1, 1, 5, 9) and bands == ["A"]
    with pytest.raises(ValueError):
        sinks.as_array(back, "T", max_cells=3)


def test_style_escapes():
    s = sinks.style({1: "a<b"})
    assert 'label="a&lt;b"' in s and sinks.PALETTE[0] in s


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2020, 1, 1, 0), 50, 1.0), (1, datetime(2020, 1, 3), 10, 2.0), (1, datetime(2020, 1, 30), 5, 3.0), (1, datetime(2020, 3, 30), 5, 4.0)]
    schema = "k int, ts timestamp, cloud_cover int, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streaming.regularize_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "16 days", "1 day", ["k"])
    q = s.writeStream.outputMode("append").format("memory").queryName("reg").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.value for r in spark.table("reg").collect()) == [2.0, 3.0]
    rows = [(1, datetime(2020, 1, k + 1), p) for k, p in enumerate([0.1, 0.8, 0.9, 0.9])] + [(2, datetime(2020, 1, 1), 0.2)]
    spark.createDataFrame(rows, "sample_id long, ts timestamp, p double").coalesce(1).write.parquet(str(tmp_path / "in2"))
    c = streaming.detect_changes_stream(spark.readStream.schema("sample_id long, ts timestamp, p double").parquet(str(tmp_path / "in2")))
    q = c.writeStream.outputMode("append").format("memory").queryName("chg").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.sample_id for r in spark.table("chg").collect()] == [1]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["reduce_samples", "merge_zipper", "kernel_w_mean", "area_accuracy", "get_data", "regularize_calendar"])
def test_queries_equal_their_sql(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = c.execute(entry.oracle_sql()[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(n) for n in columns]
    want = sorted(str([r[i] if not isinstance(r[i], float) else round(r[i], 6) for i in at]) for r in want.fetchall())
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == columns
    got = sorted(str([x if not isinstance(x, float) else round(x, 6) for x in r]) for r in got.select(*columns).collect())
    assert got == want


def test_pictures(spark, tmp_path):
    from datetime import date
    from xml.etree import ElementTree

    rows = [(label, date(2020, m, 1), float(m * k)) for label in ("a<b", "c") for m in range(1, 7) for k in range(5)]
    d = spark.createDataFrame(rows, "label string, index date, v double")
    sinks.plot_series(d, str(tmp_path / "x.svg"), ["v"])
    tree = ElementTree.parse(tmp_path / "x.svg").getroot()
    lines = [e for e in tree.iter() if e.tag.endswith("polyline")]
    assert len(lines) == 6 and all(len(e.attrib["points"].split()) == 6 for e in lines)
    with pytest.raises(ValueError):
        sinks.plot_series(d, str(tmp_path / "y.svg"), ["v"], max_points=3)
    tiles = spark.createDataFrame([("t&1", 0.0, 0.0, 1.0, 2.0)], "tile string, xmin double, ymin double, xmax double, ymax double")
    points = spark.createDataFrame([(0.5, 1.0, "wood"), (0.2, 1.5, None)], "longitude double, latitude double, label string")
    sinks.view(str(tmp_path / "map.html"), tiles, points)
    page = (tmp_path / "map.html").read_text()
    assert page.count("<circle") == 2 and page.count("<rect") == 1 and "t&amp;1" in page and "wood" in page


def test_flags(monkeypatch):
    from chronotile import config

    monkeypatch.delenv("CHRONOTILE_RUN_TESTS", raising=False)
    assert not config.run_tests()
    monkeypatch.setenv("CHRONOTILE_RUN_TESTS", "YES")
    monkeypatch.setenv("CHRONOTILE_RUN_EXAMPLES", "0")
    assert config.run_tests() and not config.run_examples()
