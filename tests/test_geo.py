"""Projections, polygons, settings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotile import config
from chronotile.functions import geo
from chronotile.operators import cube, learn
from chronotile.sources import vector


def test_projections_round_trip(spark):
    d = spark.createDataFrame([(-55.2, -15.3), (7.4, 46.9), (0.1, 0.2)], "lon double, lat double")
    south, zone = F.col("lat") < 0, geo.utm_zone(F.col("lon"))
    d = d.withColumns({"zone": zone, "south": south})
    for to, back in (
        (geo.to_mercator(F.col("lon"), F.col("lat")), geo.from_mercator),
        (geo.to_sinusoidal(F.col("lon"), F.col("lat")), geo.from_sinusoidal),
        (geo.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south")), lambda x, y: geo.from_utm(x, y, F.col("zone"), F.col("south"))),
    ):
        p = d.withColumns({"x": to[0], "y": to[1]})
        a, b = back(F.col("x"), F.col("y"))
        for r in p.select("lon", "lat", a.alias("a"), b.alias("b")).collect():
            assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-8), pytest.approx(r.lat, abs=1e-8))
    x, y = geo.to_utm(F.lit(9.0), F.lit(0.0), F.lit(32), F.lit(False))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(500000) and r.y == pytest.approx(0, abs=1e-6)


def test_polygons(spark):
    hole = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    x = np.array([1.0, 5.0, 11.0])
    assert vector.inside(x, np.array([1.0, 5.0, 5.0]), vector.rings(hole)).tolist() == [True, False, False]
    d = spark.createDataFrame([(1, "f", hole), (2, "g", "POINT(3 4)"), (3, "h", None)], "polygon_id long, label string, geometry string")
    p = vector.sample_points(d, 20).toPandas()
    assert (p.label == "f").sum() == 20 and p[p.label == "g"][["longitude", "latitude"]].to_numpy().tolist() == [[3, 4]]
    inner = (p.longitude.between(4, 6) & p.latitude.between(4, 6))[p.label == "f"]
    assert not inner.any()
    b = vector.boxes(d).where("polygon_id = 1").first()
    assert (b.xmin, b.ymin, b.xmax, b.ymax) == (0, 0, 10, 10)


def test_points_meet_tiles(spark):
    t = spark.createDataFrame([("A", 0.0, 0.0, 10.0, 5.0, 1.0, 1.0), ("B", 10.0, 0.0, 14.0, 5.0, 1.0, 1.0)], "tile string, xmin double, ymin double, xmax double, ymax double, xres double, yres double")
    p = spark.createDataFrame([(1, 0.5, 4.5), (2, 10.0, 1.0), (3, 13.9, 0.1), (4, 20.0, 1.0)], "k int, longitude double, latitude double")
    assert sorted((r.k, r.tile, r.row, r.col) for r in cube.locate(p, t).collect()) == [(1, "A", 0, 0), (3, "B", 4, 3)]
    assert sorted((r.k, r.tile) for r in cube.locate(p, t, strict=False).collect()) == [(1, "A"), (2, "A"), (2, "B"), (3, "B")]


def test_regular_cubes_merge(spark):
    a = spark.createDataFrame([("T", "B1", f"2020-01-{d:02d}", "f") for d in (1, 17)], "tile string, band string, date string, fid string").withColumn("date", F.to_date("date"))
    b = a.withColumn("band", F.lit("B2"))
    assert cube.is_regular(a) and cube.merge(a, b).count() == 4
    assert {r.band for r in cube.merge(a, b.withColumn("date", F.date_add("date", 3))).where("date = '2020-01-01'").collect()} == {"B1", "B2"}
    assert not cube.is_regular(a.unionByName(b.limit(1)))


def test_near_points_match_all_pairs(spark):
    g = np.random.default_rng(5)
    xy = np.round(g.uniform([-50, -30], [-20, 30], (80, 2)), 3)
    d = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "sample_id long, longitude double, latitude double")
    got = {r.sample_id: r.distance for r in learn.geo_distances(d, d, 0.5).collect()}
    lon, lat = np.radians(xy[:, 0]), np.radians(xy[:, 1])
    a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat)[:, None] * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    full = 2 * 6371.0088 * np.arcsin(np.sqrt(a))
    np.fill_diagonal(full, np.inf)
    assert np.allclose([got[k] for k in range(80)], full.min(1))


def test_settings(tmp_path, monkeypatch):
    p = tmp_path / "c.json"
    config.user_file(str(p))
    with pytest.raises(FileExistsError):
        config.user_file(str(p))
    p.write_text('{"chunk": 64, "classes": {"missing": 0}}')
    config.load(str(p))
    assert config.get("chunk") == 64 and config.get("classes", "missing") == 0 and config.get("classes", "most") == 254
    config.colors_set({"Forest": "#00ff00"})
    assert config.get("colors") == {"Forest": "#00ff00"}
    config.colors_reset()
    config.load()
    assert config.get("chunk") == 256


def test_shape_files(spark, tmp_path):
    import struct

    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    point = struct.pack("<i2d", 1, 3.5, -4.25)
    records = b"".join(struct.pack(">2i", k, len(b) // 2) + b for k, b in enumerate((body, point), 1))
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + records)
    field = b"CLASS".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    (tmp_path / "a.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 2, 32 + 32 + 1, 9) + b"\0" * 20 + field + b"\x0d" + b" Forest  " + b" Pasture ")
    for path in (str(tmp_path), str(tmp_path / "a.shp")):
        r = vector.read_shapes(spark, path, "CLASS").orderBy("polygon_id").collect()
        assert [(x.label, x.geometry) for x in r] == [("Forest", "POLYGON((0.0 0.0, 0.0 2.0, 2.0 2.0, 0.0 0.0))"), ("Pasture", "POINT(3.5 -4.25)")]


def test_workbook(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    from chronotile.sources import sinks

    t = spark.createDataFrame([("a<b", 1.5), (None, 2.0)], "label string, f1 double")
    sinks.accuracy_to_workbook({"by class": t, "again": t}, str(tmp_path / "x.xlsx"))
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        assert "a&lt;b" in z.read("xl/worksheets/sheet2.xml").decode()
    with pytest.raises(ValueError):
        sinks.accuracy_to_workbook({"t": t}, str(tmp_path / "y.xlsx"), max_rows=1)


def test_online_map(spark):
    d = spark.createDataFrame([(k, float(k % 2 * 10 + k / 100)) for k in range(60)], "sample_id long, v double")
    m = learn.Som.online(d, ["v"], 2, 2, 20).map(d, ["v"])
    assert m.groupBy(F.col("sample_id") % 2).agg(F.collect_set("neuron").alias("n")).select(F.size("n")).count() == 2
    assert m.agg(F.max("distance")).first()[0] < 2


def test_conic_and_azimuthal_projections(spark):
    """Worked examples of the literature, and the way back."""
    clarke = {"radius": 6378206.4, "flattening": 1 - (1 - 0.00676866) ** 0.5}
    cases = [
        (geo.Albers(23, -96, 29.5, 45.5, **clarke), -75.0, 35.0, 1885472.7, 1535925.0),
        (geo.Conformal(23, -96, 33, 45, **clarke), -75.0, 35.0, 1894410.9, 1564649.5),
        (geo.Azimuthal(52, 10, 4321000, 3210000, 6378137.0, 1 / 298.257222101), 5.0, 50.0, 3962799.45, 2999718.85),
        (geo.Azimuthal(52, 10, 4321000, 3210000), 10.0, 52.0, 4321000, 3210000),
        (geo.Albers(-12, -54, -2, -22, 5e6, 1e7), -60.0, -5.0, None, None),
    ]
    d = spark.range(1)
    for p, lon, lat, x, y in cases:
        got = d.select(*(c.alias(n) for c, n in zip(p.to(F.lit(lon), F.lit(lat)), "xy", strict=True)))
        back = got.select("*", *(c.alias(n) for c, n in zip(p.back(F.col("x"), F.col("y")), ("lon", "lat"), strict=True))).first()
        if x is not None:
            assert (back.x, back.y) == pytest.approx((x, y), abs=0.1)
        assert (back.lon, back.lat) == pytest.approx((lon, lat), abs=1e-6)
