"""Polygons as well-known text: boxes, membership, and sample points inside."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import MIX, PRIME

RING = re.compile(r"\(([^()]+)\)")


def rings(text: str) -> list[np.ndarray]:
    """The rings of a POLYGON or MULTIPOLYGON; of a POINT one ring of one point."""
    return [np.array([[float(v) for v in p.split()[:2]] for p in r.split(",")]) for r in RING.findall(text or "")]


def inside(x: np.ndarray, y: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings, so that holes are outside."""
    out = np.zeros(len(x), bool)
    for r in parts:
        a, b = r, np.roll(r, -1, 0)
        for (x0, y0), (x1, y1) in zip(a, b, strict=True):
            cross = (y0 > y) != (y1 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                out ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return out


def boxes(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds xmin, ymin, xmax, ymax."""
    pair = F.transform(F.regexp_extract_all(geometry, F.lit(r"(-?[0-9.eE+-]+) (-?[0-9.eE+-]+)"), F.lit(0)), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    d = df.withColumn("_p", pair)
    return d.withColumns({"xmin": F.array_min("_p.x"), "ymin": F.array_min("_p.y"), "xmax": F.array_max("_p.x"), "ymax": F.array_max("_p.y")}).drop("_p")


#: Powers of the inverse of the plastic number, whose multiples fill the unit square evenly.
STEPS = (0.7548776662466927, 0.5698402909980532)


def sample_points(polygons: DataFrame, n: int = 30, key: str = "polygon_id", geometry: str = "geometry", seed: int = 1) -> DataFrame:
    """polygon_id, longitude, latitude and the other columns: n points inside each polygon, a point's own place for points.

    Candidates fill a polygon's box evenly, by a sequence that begins at a place of the polygon's own; the first n inside it
    are taken.
    """
    fields = [f for f in polygons.schema if f.name != geometry]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                r = row._asdict()
                parts = rings(r.pop(geometry))
                if not parts:
                    continue
                if len(parts[0]) == 1:
                    out.append(pd.DataFrame([{**r, "longitude": parts[0][0, 0], "latitude": parts[0][0, 1]}]))
                    continue
                begin = [(int(r[key]) * 2 + axis + seed) * MIX % PRIME / PRIME for axis in (0, 1)]
                low, high = np.min([p.min(0) for p in parts], 0), np.max([p.max(0) for p in parts], 0)
                got = np.zeros((0, 2))
                for t in range(200):
                    k = np.arange(1 + t * 4 * n, 1 + (t + 1) * 4 * n)[:, None]
                    c = low + (np.array(begin) + k * STEPS) % 1 * (high - low)
                    got = np.concatenate([got, c[inside(c[:, 0], c[:, 1], parts)]])[:n]
                    if len(got) == n:
                        break
                out.append(pd.DataFrame({**{k: [v] * len(got) for k, v in r.items()}, "longitude": got[:, 0], "latitude": got[:, 1]}))
            if out:
                yield pd.concat(out)

    return polygons.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", longitude double, latitude double")


def points_within(points: DataFrame, polygons: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Points with the columns of each polygon that holds them: boxes meet on one-degree cells, then rings decide."""
    b = boxes(polygons, geometry)
    cells = b.withColumn("_cx", F.explode(F.sequence(F.floor("xmin"), F.floor("xmax")))).withColumn("_cy", F.explode(F.sequence(F.floor("ymin"), F.floor("ymax"))))
    p = points.withColumns({"_cx": F.floor("longitude"), "_cy": F.floor("latitude")})
    j = p.join(cells, ["_cx", "_cy"]).where(F.col("longitude").between(F.col("xmin"), F.col("xmax")) & F.col("latitude").between(F.col("ymin"), F.col("ymax"))).drop("_cx", "_cy", "xmin", "ymin", "xmax", "ymax")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, list[np.ndarray]] = {}
        for part in batches:
            x, y, keep = part["longitude"].to_numpy(float), part["latitude"].to_numpy(float), np.zeros(len(part), bool)
            for g, at in part.groupby(geometry, sort=False).indices.items():
                if len(cache) > 1000:
                    cache.clear()
                if g not in cache:
                    cache[g] = rings(g)
                keep[at] = inside(x[at], y[at], cache[g])
            yield part[keep]

    return j.mapInPandas(run, fields)


def _shapes(raw: bytes) -> list[str | None]:
    """Well-known text of each record of a shape file: points and polygons (parts as rings), else null."""
    out, at = [], 100
    while at + 12 <= len(raw):
        words = struct.unpack(">i", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + 2 * words]
        kind = struct.unpack("<i", body[:4])[0]
        text = None
        if kind in (1, 11, 21):
            x, y = struct.unpack("<2d", body[4:20])
            text = f"POINT({x!r} {y!r})"
        elif kind in (5, 15, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            text = "POLYGON(" + ", ".join("(" + ", ".join(f"{float(x)!r} {float(y)!r}" for x, y in xy[a:b]) + ")" for a, b in zip(starts, starts[1:], strict=False)) + ")"
        out.append(text)
        at += 8 + 2 * words
    return out


def _attributes(raw: bytes) -> list[dict[str, str]]:
    """Records of the table beside a shape file, as text."""
    if len(raw) < 32:
        return []
    n, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while at + 32 <= head and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        row, p = {}, head + k * size + 1
        for name, width in fields:
            row[name] = raw[p : p + width].decode("utf-8", "replace").strip()
            p += width
        rows.append(row)
    return rows


def read_shapes(spark, path: str, label: str | None = None) -> DataFrame:
    """polygon_id, label and geometry of shape files (a file, or a folder of them); label: the attribute that holds it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path if not path.endswith(".shp") else path.rsplit("/", 1)[0])
    stem = F.regexp_replace("path", r"\.(shp|dbf)$", "")
    if path.endswith(".shp"):
        files = files.where(F.endswith(stem, F.lit("/" + path.rsplit("/", 1)[-1][:-4])))
    pairs = files.groupBy(stem.alias("stem")).agg(F.max(F.when(F.endswith("path", F.lit(".shp")), F.col("content"))).alias("shp"), F.max(F.when(F.endswith("path", F.lit(".dbf")), F.col("content"))).alias("dbf")).where("shp is not null")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for stem, shp, dbf in zip(part["stem"], part["shp"], part["dbf"], strict=True):
                shapes = _shapes(bytes(shp))
                rows = _attributes(bytes(dbf)) if dbf is not None else []
                rows += [{}] * (len(shapes) - len(rows))
                yield pd.DataFrame({"file": stem, "polygon_id": range(1, len(shapes) + 1), "label": [r.get(label) if label else None for r in rows[: len(shapes)]], "geometry": shapes})

    return pairs.mapInPandas(parse, "file string, polygon_id long, label string, geometry string")
