"""A set of curves from files in one call, and its drawing."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespan.operators import curve
from rarespan.operators.iterate import durable
from rarespan.sources import curves as source


def default_colour(label: str) -> str:
    """A dark colour that depends on the label only: each part is below 200."""
    return "#" + "".join(f"{b % 200:02x}" for b in hashlib.md5(label.encode()).digest()[:3])


def rgb(colour: str) -> tuple[float, float, float]:
    """Parts of '#rrggbb' from 0 to 1."""
    return tuple(int(colour[i : i + 2], 16) / 255 for i in (1, 3, 5))


def with_alpha(colour: str, alpha: float = 1.0) -> str:
    return f"{colour[:7]}{round(255 * alpha):02x}"


@dataclass(frozen=True)
class CurveSet:
    """Metadata (label, file, col, ...), points, models and checks of a set of curves."""

    meta: DataFrame
    points: DataFrame
    params: DataFrame
    star: float

    def summary(self) -> DataFrame:
        return curve.summary(self.points, self.meta, self.params)

    def json(self) -> DataFrame:
        return curve.to_json(self.points, self.meta, self.params, self.star)

    def warnings(self) -> DataFrame:
        """(label, warning)."""
        return curve.checks(self.points).select("label", F.explode("warnings").alias("warning"))

    def add(self, other: CurveSet) -> CurveSet:
        return CurveSet(*(curve.add(a, b) for a, b in ((self.meta, other.meta), (self.points, other.points), (self.params, other.params))), self.star)


def read_set(spark: SparkSession, files: list[str], labels: list[str] | None = None, cols: list[str] | None = None, enforce: bool = True, star: float = 95.0, corrected: bool = True, weights: tuple[float, ...] | None = None, skip_model: bool = False, compat: bool = False) -> CurveSet:
    """Curves of files. Labels (by default the files' names) and colours are used again from the start if there are fewer of them than files."""
    own = [f.rstrip("/").rsplit("/", 1)[-1].removesuffix(".npo") for f in files]
    label = [labels[i % len(labels)] for i in range(len(files))] if labels else own
    col = [cols[i % len(cols)] for i in range(len(files))] if cols else [default_colour(x) for x in label]
    if len(set(own)) < len(own) or len(set(label)) < len(label):
        raise ValueError("two curves of a set have the same name")
    table = spark.createDataFrame(list(zip(own, files, label, col)), "own string, file string, name string, col string")
    named = lambda df, extra: df.join(F.broadcast(table), df["label"] == table["own"]).drop("label", "own", *([] if extra else ["file", "col"])).withColumnRenamed("name", "label")
    found, rows = source.read_files(spark, files, compat)
    meta, raw = named(found, True), named(rows, False)
    points = durable(curve.points(raw, meta, corrected))
    params = curve.fit(points.where(F.lit(not skip_model)), meta, star, weights, enforce)
    return CurveSet(meta, points, durable(params), star)


def read_sheet(spark: SparkSession, path: str, **options) -> CurveSet:
    """The set of a sample sheet (File, Name, Col)."""
    rows = source.read_sheet(spark, path).collect()  # one row per file
    cols = [r["Col"] for r in rows]
    return read_set(spark, [r["File"] for r in rows], [r["Name"] for r in rows], [c or default_colour(r["Name"]) for c, r in zip(cols, rows)], **options)


def draw(curves: CurveSet, path: str, size: float = 7.0, xlim: tuple[float, float] = (1e3, 10e12), dispersion: str | None = None, observed: bool = True, model: bool = True, diversity: bool = True, legend: bool = True) -> None:
    """A PDF of one page: coverage by effort on a logarithmic axis, guides, dispersion, models, diversities and a legend."""
    colour = {r["label"]: r["col"] for r in curves.meta.select("label", "col").collect()}
    series: dict = {}
    for r in curve.plot_series(curves.points, curves.params).collect():  # a thousand points a curve
        series.setdefault((r["label"], r["series"]), []).append((r["x"], r["y"]))
    bands: dict = {}
    if dispersion:
        for r in curve.bands(curves.points, dispersion).collect():
            bands.setdefault(r["label"], []).append((r["x_adj"], r["lower"], r["upper"]))
    guides = curve.plot_guides(curves.params, curves.star).collect()
    side, margin = 72 * size, 50.0
    low, high = math.log(xlim[0]), math.log(xlim[1])
    at_x = lambda x: margin + (side - 2 * margin) * (math.log(max(x, 1e-300)) - low) / (high - low)
    at_y = lambda y: margin + (side - 2 * margin) * y
    out = []

    def line(points, rgb_parts, width=1.0, dashed=False):
        inside = [(at_x(x), at_y(y)) for x, y in sorted(points) if xlim[0] <= x <= xlim[1]]
        if len(inside) > 1:
            out.append(f"{' '.join(f'{c:.3f}' for c in rgb_parts)} RG {width} w {'[3 3]' if dashed else '[]'} 0 d " + " ".join(f"{x:.2f} {y:.2f} {'l' if i else 'm'}" for i, (x, y) in enumerate(inside)) + " S")

    def text(x, y, words, rgb_parts=(0, 0, 0)):
        safe = words.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
        out.append(f"{' '.join(f'{c:.3f}' for c in rgb_parts)} rg BT /F1 8 Tf {x:.2f} {y:.2f} Td ({safe}) Tj ET")

    line([(xlim[0], 0), (xlim[1], 0)], (0, 0, 0))
    for g in guides:
        if g["guide"] in ("coverage", "target"):
            line([(xlim[0], g["value"]), (xlim[1], g["value"])], (0.6, 0.3, 0.3), 0.5, True)
        elif g["guide"] == "effort" and xlim[0] <= g["value"] <= xlim[1]:
            x = at_x(g["value"])
            out.append(f"0.8 0.8 0.8 RG 0.5 w [3 3] 0 d {x:.2f} {at_y(0):.2f} m {x:.2f} {at_y(1):.2f} l S")
            text(x - 8, margin - 14, f"1e{round(math.log10(g['value']))}")
        elif diversity and g["guide"] == "diversity" and xlim[0] <= g["value"] <= xlim[1]:
            x, c = at_x(g["value"]), rgb(colour[g["label"]])
            out.append(f"{' '.join(f'{v:.3f}' for v in c)} RG 1 w [] 0 d {x:.2f} {at_y(0) - 8:.2f} m {x:.2f} {at_y(0):.2f} l S")
    for label, rows in bands.items():
        for k in (1, 2):
            line([(r[0], r[k]) for r in rows if r[0] > 0], rgb(colour[label]), 0.4)
    for (label, kind), rows in sorted(series.items()):
        if (observed if kind == "observed" else model):
            line([p for p in rows if p[0] > 0], rgb(colour[label]), 1.6 if kind == "observed" else 0.8, kind == "model")
    if legend:
        for i, label in enumerate(sorted(colour)):
            text(margin + 6, side - margin - 12 - 10 * i, label, rgb(colour[label]))
    text(side / 2 - 50, 16, "bases sequenced")
    text(8, side - 30, "share of the population seen")
    write_pdf("\n".join(out), side, path)


def write_pdf(content: str, side: float, path: str) -> None:
    """One page with one content stream."""
    stream = content.encode("latin-1")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {side:.0f} {side:.0f}] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>".encode(),
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    body, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(body))
        body += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    body += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(body))
    with open(path, "wb") as f:
        f.write(body)
