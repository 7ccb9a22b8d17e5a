"""Polygons from shapefiles (the published format: .shp geometry, .dbf attributes)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import inside, signed_area

#: Shape types with polygon parts: plain, with Z, with M (fixed values of the format).
POLYGONS = (5, 15, 25)
RING = "array<struct<x:double,y:double>>"


def read_shp(data: bytes) -> list[tuple[int, list[list[tuple[float, float]]]]]:
    """(record position, rings) of every polygon record; other shapes and NULL shapes have no rings."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    out, at = [], 100
    while at + 12 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        body, rings = at + 8, []
        if struct.unpack("<i", data[body : body + 4])[0] in POLYGONS:
            parts, points = struct.unpack("<2i", data[body + 36 : body + 44])
            first = [*struct.unpack(f"<{parts}i", data[body + 44 : body + 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", data[body + 44 + 4 * parts : body + 44 + 4 * parts + 16 * points])
            corners = list(zip(flat[::2], flat[1::2]))
            for a, b in zip(first, first[1:]):
                ring = corners[a:b]
                rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
        out.append((len(out), rings))
        at = body + 2 * words
    return out


def with_holes(rings: list[list[tuple[float, float]]]) -> list[tuple[list, list]]:
    """(outer ring, its holes) of a record's rings: an anticlockwise ring inside a clockwise one is a hole of the smallest such."""
    outer = [(r, []) for r in rings if signed_area(r) <= 0]
    for r in (r for r in rings if signed_area(r) > 0):
        around = [o for o in outer if o[0] is not r and signed_area(o[0]) < 0 and all(inside(o[0], p) or p in o[0] for p in r)]
        if around:
            min(around, key=lambda o: -signed_area(o[0]))[1].append(r)
        else:
            outer.append((r, []))
    return outer


def read_dbf(data: bytes, column: str) -> list[str]:
    """The text of one column, record by record."""
    count, header, width = struct.unpack("<iHH", data[4:12])
    at, offset, found = 32, 1, None
    while data[at] != 0x0D:
        name, size = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), data[at + 16]
        if name == column:
            found = (offset, size)
        offset += size
        at += 32
    if found is None:
        raise ValueError(f"no column {column!r}")
    rows = (data[header + i * width : header + (i + 1) * width] for i in range(count))
    return [r[found[0] : found[0] + found[1]].decode("utf-8", "replace").strip() for r in rows]


def write_shp(spark: SparkSession, path: str, shapes: list[tuple[str, list[list[tuple[float, float]]]]], column: str = "ZIP") -> None:
    """Write (zip, rings) as ``path``.shp and ``path``.dbf, on any file system Spark reaches; for tables of driver size."""
    body = b""
    for i, (_, rings) in enumerate(shapes):
        rings = [[*r, r[0]] for r in rings]
        points = [p for r in rings for p in r]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        part = struct.pack("<i", 0)
        if rings:
            part = struct.pack("<i4d2i", POLYGONS[0], min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", i + 1, len(part) // 2) + part
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, POLYGONS[0], *[0.0] * 8)
    names = [z.encode() for z, _ in shapes]
    width = max([1, *map(len, names)])
    field = column.encode()[:10].ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14
    dbf = struct.pack("<4BiHH20x", 3, 24, 1, 1, len(shapes), 65, 1 + width) + field + b"\r" + b"".join(b" " + n.ljust(width) for n in names)
    for ending, data in ((".shp", head + body), (".dbf", dbf)):
        target = spark._jvm.org.apache.hadoop.fs.Path(path + ending)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(data))
        out.close()


def polygons_shp(spark: SparkSession, path: str, zip_column: str | None = None) -> DataFrame:
    """(zip, ring, holes) with one row per outer ring, from a .shp file or a folder or pattern of them.

    ``zip`` is the text of ``zip_column`` in the .dbf file beside each .shp, or
    the record's position. One task per file: the format itself bounds a file to
    2 GB. Both files of a pair meet in a join on their common path.
    """

    def corners(ring: list[tuple[float, float]]) -> list[dict]:
        return [{"x": x, "y": y} for x, y in ring]

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(stem, i, corners(ring), [corners(h) for h in holes]) for stem, data in zip(batch["stem"], batch["content"]) for i, rs in read_shp(data) for ring, holes in with_holes(rs)]
            yield pd.DataFrame(rows, columns=["stem", "i", "ring", "holes"])

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(stem, i, name) for stem, data in zip(batch["stem"], batch["content"]) for i, name in enumerate(read_dbf(data, zip_column))]
            yield pd.DataFrame(rows, columns=["stem", "i", "zip"])

    def files(ending: str, where: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*" + ending).load(where)
        return found.select(F.regexp_replace("path", "\\.[^.]*$", "").alias("stem"), "content")

    shapes = files(".shp", path).mapInPandas(rings, f"stem string, i int, ring {RING}, holes array<{RING}>")
    if zip_column is None:
        return shapes.select(F.col("i").cast("string").alias("zip"), "ring", "holes")
    beside = path[:-4] + ".dbf" if path.endswith(".shp") else path
    ids = files(".dbf", beside).mapInPandas(names, "stem string, i int, zip string")
    return shapes.join(ids, ["stem", "i"]).select("zip", "ring", "holes")
