import math
import random
import struct

import pytest

from spatialpanel.functions.geometry import bridge, ear_clip, inside, signed_area
from spatialpanel.operators.graph import contiguity_graph
from spatialpanel.operators.spatial import points_in_regions
from spatialpanel.sources import shapefile


def write(folder, name, shapes):
    """A minimal .shp and .dbf pair; shapes: (zip, rings)."""
    body = b""
    for i, (_, rings) in enumerate(shapes):
        points = [p for r in rings for p in r]
        starts = [sum(len(r) for r in rings[:k]) for k in range(len(rings))]
        part = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        part = part if rings else struct.pack("<i", 0)
        body += struct.pack(">2i", i + 1, len(part) // 2) + part
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (folder / f"{name}.shp").write_bytes(head + body)
    field = b"NAME\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([3, 0]) + b"\0" * 14
    field2 = b"ZIP\0\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    dbf = struct.pack("<4BiHH20x", 3, 24, 1, 1, len(shapes), 97, 9) + field + field2 + b"\r"
    (folder / f"{name}.dbf").write_bytes(dbf + b"".join(b" " + b"abc" + z.ljust(5).encode() for z, _ in shapes))


def square(x, y):
    return [(x, y), (x, y + 1.0), (x + 1.0, y + 1.0), (x + 1.0, y), (x, y)]


def test_shapefile_to_contiguity(spark, tmp_path):
    write(tmp_path, "one", [("02139", [square(0.0, 0.0)]), ("B", [square(1.0, 0.0), square(9.0, 9.0)]), ("none", [])])
    rows = shapefile.polygons_shp(spark, str(tmp_path / "one.shp"), "ZIP")
    assert sorted((r.zip, len(r.ring)) for r in rows.collect()) == [("02139", 4), ("B", 4), ("B", 4)]
    g = contiguity_graph(rows, "rook")
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [("02139", "B"), ("B", "02139")]
    write(tmp_path, "two", [("C", [square(10.0, 9.0)])])
    both = shapefile.polygons_shp(spark, str(tmp_path), "ZIP")
    assert ("B", "C") in [tuple(r)[:2] for r in contiguity_graph(both).edges.collect()]
    assert {r.zip for r in shapefile.polygons_shp(spark, str(tmp_path / "one.shp")).collect()} == {"0", "1"}


def test_holes(spark, tmp_path):
    big = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    hole, second = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)], [(6.0, 6.0), (8.0, 6.0), (7.0, 8.0)]
    island = [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)]
    shapefile.write_shp(spark, str(tmp_path / "h"), [("big", [big, hole, second]), ("in", [island]), ("far", [[(20.0, 0.0), (21.0, 0.0), (21.0, 1.0)]]), ("none", [])])
    rows = shapefile.polygons_shp(spark, str(tmp_path / "h.shp"), "ZIP")
    assert {r.zip: (len(r.ring), len(r.holes)) for r in rows.collect()} == {"big": (4, 2), "in": (4, 0), "far": (3, 0)}
    assert sorted((r.src, r.dst) for r in contiguity_graph(rows).edges.collect()) == [("big", "in"), ("in", "big")]
    r = random.Random(2)
    pts = [(str(i), r.uniform(-1, 11), r.uniform(-1, 11)) for i in range(2000)] + [("rim", 3.0, 2.0), ("corner", 7.0, 8.0)]
    got = {x.id: x.zip for x in points_in_regions(spark.createDataFrame(pts, "id string, x double, y double"), rows, "id", "zip", "x", "y").collect()}

    def region(x, y):
        if inside(hole, (x, y)):
            return "in"
        return "big" if inside(big, (x, y)) and not inside(second, (x, y)) else None

    assert {i: got.get(i) for i, _, _ in pts[:-2]} == {i: region(x, y) for i, x, y in pts[:-2]}
    assert got["rim"] == got["corner"] == "big"


@pytest.mark.parametrize("seed", range(30))
def test_bridged_rings_have_the_right_area(seed):
    r = random.Random(seed)
    outer = [(math.cos(k * math.pi / 12) * r.uniform(8, 10), math.sin(k * math.pi / 12) * r.uniform(8, 10)) for k in range(24)]
    holes = [[(x + r.uniform(0.3, 1) * math.cos(k), y + r.uniform(0.3, 1) * math.sin(k)) for k in range(6)] for x, y in r.sample([(x, y) for x in (-4, -1.5, 1.5, 4) for y in (-4, -1.5, 1.5, 4)], r.randrange(1, 8))]
    ring = bridge(outer, holes)
    cut = sum(abs(signed_area([ring[i] for i in t])) for t in ear_clip(ring))
    assert cut == pytest.approx(abs(signed_area(outer)) - sum(abs(signed_area(h)) for h in holes))


def test_bad_files(tmp_path):
    with pytest.raises(ValueError):
        shapefile.read_shp(b"x" * 200)
    write(tmp_path, "one", [("A", [square(0.0, 0.0)])])
    with pytest.raises(ValueError):
        shapefile.read_dbf((tmp_path / "one.dbf").read_bytes(), "OTHER")
