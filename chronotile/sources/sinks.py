"""Writers: tables by tile and band, sample files, geometry as text, arrays, models and styles."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_cube(pixels: DataFrame, path: str, partition: tuple[str, ...] = ("tile", "band"), mode: str = "errorifexists") -> None:
    """Pixels as Parquet by tile and band, so that a filter on either reads those folders alone."""
    pixels.repartition(*partition, F.floor(F.col("row") / 512)).write.mode(mode).partitionBy(*partition).parquet(path)


def samples_to_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    numbered(df).write.mode(mode).option("header", "true").csv(path)


def numbered(df: DataFrame) -> DataFrame:
    """Sample metadata with an id from 1 in the order of place and time."""
    c = ["longitude", "latitude", "start_date", "end_date", "label"]
    # Rows are dealt by ranges of longitude, numbered within each, and moved by the counts of those before.
    edges = sorted(set(df.approxQuantile("longitude", [k / 256 for k in range(1, 256)], 0.001)))
    part = F.coalesce(F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= F.col("longitude"))), F.lit(0)) if edges else F.lit(0)
    d = df.select(*c, F.when(F.col("longitude").isNull(), F.lit(-1)).otherwise(part).alias("_part"))
    n = d.groupBy("_part").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c"))  # 256 rows
    d = d.join(F.broadcast(n.drop("_c")), "_part")
    return d.select((F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*c))).alias("id"), *c)


def series_to_csv(df: DataFrame, path: str, bands: list[str], dates: int, mode: str = "errorifexists") -> None:
    from ..operators.series import predictors

    predictors(df, bands, dates).write.mode(mode).option("header", "true").csv(path)


def accuracy_to_csv(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table in a folder of its name."""
    for name, t in tables.items():
        t.write.mode(mode).option("header", "true").csv(f"{path}/{name}")


def accuracy_to_workbook(tables: dict[str, DataFrame], path: str, max_rows: int = 100_000) -> None:
    """A sheet for each table, of which more than max_rows rows are an error: accuracy tables are small."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, t in enumerate(tables.values(), 1):
            rows = t.limit(max_rows + 1).collect()
            if len(rows) > max_rows:
                raise ValueError(f"a sheet takes at most {max_rows} rows")
            lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [tuple(t.columns), *map(tuple, rows)])
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
        sheets = "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1))
        package = "http://schemas.openxmlformats.org/package/2006"
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{main}.worksheet+xml"/>' for k in range(1, len(tables) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>{parts}</Types>')


def point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def box_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    corner = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)), F.lit("))"))


def as_points(df: DataFrame) -> DataFrame:
    return df.withColumn("geometry", point_text(F.col("longitude"), F.col("latitude")))


def as_boxes(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("geometry", box_text(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))))


def as_array(pixels: DataFrame, tile: str, bands: list[str] | None = None, max_cells: int = 50_000_000):
    """One tile as a numpy array (band, date, row, col) with its band and date names; larger ones are refused."""
    import numpy as np

    d = pixels.where(F.col("tile") == tile)
    d = d.where(F.col("band").isin(*bands)) if bands else d
    shape = d.agg(F.max("row"), F.max("col")).first()
    names = sorted(r[0] for r in d.select("band").distinct().collect())
    dates = sorted(r[0] for r in d.select("date").distinct().collect())
    nr, nc = (shape[0] or 0) + 1, (shape[1] or 0) + 1
    if len(names) * len(dates) * nr * nc > max_cells:
        raise ValueError("the tile is too large for the driver")
    out = np.full((len(names), len(dates), nr, nc), np.nan)
    p = d.select("band", "date", "row", "col", "value").toPandas()
    out[p["band"].map(names.index), p["date"].map(dates.index), p["row"], p["col"]] = p["value"]
    return out, names, dates


def export_model(model, path: str) -> None:
    model.write().overwrite().save(path)


PALETTE = ("#1b9e77", "#d95f02", "#7570b3", "#e7298a", "#66a61e", "#e6ab02", "#a6761d", "#666666")


def colors(labels: list[str], chosen: dict[str, str] | None = None) -> dict[str, str]:
    """A colour for each label: the chosen one, else the palette's next."""
    return {n: (chosen or {}).get(n, PALETTE[k % len(PALETTE)]) for k, n in enumerate(labels)}


def style(labels: dict[int, str], chosen: dict[str, str] | None = None) -> str:
    """A raster style in XML, an entry for each class."""
    c = colors(list(labels.values()), chosen)
    entries = "\n".join(f"      <paletteEntry value={quoteattr(str(k))} color={quoteattr(c[n])} label={quoteattr(n)} alpha=\"255\"/>" for k, n in labels.items())
    return f'<!DOCTYPE qgis>\n<qgis>\n  <pipe>\n    <rasterrenderer type="paletted" band="1">\n    <colorPalette>\n{entries}\n    </colorPalette>\n    </rasterrenderer>\n  </pipe>\n</qgis>\n'


def write_style(path: str, labels: dict[int, str], chosen: dict[str, str] | None = None) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(style(labels, chosen))


def plot_series(df: DataFrame, path: str, bands: list[str], label: str = "label", index: str = "index", max_points: int = 20_000) -> None:
    """A picture (SVG) with a panel for each label and band: the median of the series by date, and its quartiles.

    Dates times labels are drawn, whatever the number of samples; more than max_points are an error.
    """
    from ..operators.quantiles import quantiles

    panels = []
    for b in bands:
        rows = quantiles(df, b, [0.25, 0.5, 0.75], [label, index]).limit(max_points + 1).collect()
        if len(rows) > max_points:
            raise ValueError(f"a picture takes at most {max_points} points")
        by: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: (str(r[label]), r[index])):
            by.setdefault(str(r[label]), []).append((r[index].toordinal(), r["q"]))
        panels += [(f"{name}: {b}", points) for name, points in by.items()]
    out = []
    for k, (title, points) in enumerate(panels):
        x0, y0 = k % 3 * 260 + 10, k // 3 * 170 + 24
        days, values = [p[0] for p in points], [v for p in points for v in p[1]]
        dx, low, dy = max(days[-1] - days[0], 1), min(values), max(max(values) - min(values), 1e-12)
        line = lambda i: " ".join(f"{x0 + 240 * (d - days[0]) / dx:.1f},{y0 + 130 - 130 * (q[i] - low) / dy:.1f}" for d, q in points)  # noqa: E731,B023
        out.append(f'<text x="{x0}" y="{y0 - 6}">{escape(title)}</text><rect x="{x0}" y="{y0}" width="240" height="130" class="frame"/>')
        out += [f'<polyline points="{line(i)}" class="{c}"/>' for i, c in ((0, "quartile"), (2, "quartile"), (1, "median"))]
    look = "text{font:11px sans-serif}.frame{fill:none;stroke:#999}.quartile{fill:none;stroke:#1b9e77;stroke-dasharray:4 3}.median{fill:none;stroke:#d95f02}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="790" height="{(len(panels) + 2) // 3 * 170 + 20}"><style>{look}</style>{"".join(out)}</svg>\n')


def view(path: str, tiles: DataFrame | None = None, points: DataFrame | None = None, chosen: dict[str, str] | None = None, max_shapes: int = 50_000) -> None:
    """A page with a map of tiles (tile, xmin ..) and of points (longitude, latitude, label), and a legend.

    What is shown is bounded; more than max_shapes are an error.
    """
    boxes = tiles.select("tile", "xmin", "ymin", "xmax", "ymax").limit(max_shapes + 1).collect() if tiles is not None else []
    places = points.select("longitude", "latitude", "label").limit(max_shapes + 1).collect() if points is not None else []
    if len(boxes) + len(places) > max_shapes:
        raise ValueError(f"a map takes at most {max_shapes} shapes")
    xs = [v for b in boxes for v in (b["xmin"], b["xmax"])] + [p["longitude"] for p in places] or [0.0]
    ys = [v for b in boxes for v in (b["ymin"], b["ymax"])] + [p["latitude"] for p in places] or [0.0]
    scale = 760 / max(max(xs) - min(xs), max(ys) - min(ys), 1e-9)
    at = lambda x, y: (20 + (x - min(xs)) * scale, 20 + (max(ys) - y) * scale)
    c = colors(sorted({str(p["label"]) for p in places}), chosen)
    out = []
    for b in boxes:
        (x, y), (x1, y1) = at(b["xmin"], b["ymax"]), at(b["xmax"], b["ymin"])
        out.append(f'<rect x="{x:.2f}" y="{y:.2f}" width="{x1 - x:.2f}" height="{y1 - y:.2f}" class="tile"><title>{escape(str(b["tile"]))}</title></rect>')
    for p in places:
        x, y = at(p["longitude"], p["latitude"])
        out.append(f'<circle cx="{x:.2f}" cy="{y:.2f}" r="3" fill={quoteattr(c[str(p["label"])])}><title>{escape(str(p["label"]))}</title></circle>')
    legend = "".join(f"<li><span style={quoteattr(f'color:{v}')}>&#9679;</span> {escape(n)}</li>" for n, v in c.items())
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><meta charset="utf-8"><style>.tile{{fill:none;stroke:#333}}li{{list-style:none;font:13px sans-serif}}</style><svg width="800" height="{(max(ys) - min(ys)) * scale + 40:.0f}">{"".join(out)}</svg><ul>{legend}</ul>\n')
