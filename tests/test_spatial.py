import math
import random

import pytest

from spatialpanel.functions.geometry import ear_clip
from spatialpanel.operators import skew, spatial


def area(ring):
    return abs(sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring)))) / 2


@pytest.mark.parametrize(
    "ring",
    [
        [(0, 0), (4, 0), (4, 4), (0, 4)],
        [(0, 4), (4, 4), (4, 0), (0, 0)],
        [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)],
        [(0, 0), (2, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)],
        [(math.cos(k) * (1 + k % 2), math.sin(k) * (1 + k % 2)) for k in range(6)],
    ],
)
def test_ear_clipping_covers_the_polygon(ring):
    triangles = ear_clip(ring)
    assert sum(area([ring[i] for i in t]) for t in triangles) == pytest.approx(area(ring))


def test_ear_clipping_of_nothing():
    assert ear_clip([]) == [] and ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, 0), (1, 1), (2, 2)]) == []
    ear_clip([(0, 0), (2, 2), (2, 0), (0, 2)])  # crosses itself: ends


GEO = "geo_id string, latitude double, longitude double, face int, x double"


def km(a, b):
    (p, q), (r, s) = [(math.radians(v) for v in z) for z in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def test_near_pairs_anywhere_on_the_globe(spark):
    r = random.Random(5)
    centres = [(0.01, 0), (90, 0), (-90, 10), (89.999, 120), (0, 180), (0, -180), (35.2643897, 45), (0, 45), (45, 90), (-45.0, 135), (51, 7), (-12, -77)]
    pts = []
    for i, (la, lo) in enumerate(centres):
        for j in range(12):
            y = max(-90.0, min(90.0, la + r.uniform(-0.02, 0.02)))
            x = lo + r.uniform(-0.02, 0.02) / max(0.05, math.cos(math.radians(y)))
            pts.append((f"g{i:02d}_{j:02d}", y, (x + 180) % 360 - 180))
    dirty = [(None, 1.0, 1.0), ("a", None, 1.0), ("b", math.nan, 1.0), ("c", 91.0, 0.0), ("d", 0.0, 0.0), ("e", 0.0, 0.0), ("f", 10.0, 181.0), ("g05_00", 500.0, 0.0), pts[0], ("two", 51.0, 7.0), ("two", -12.0, -77.0)]
    df = spark.createDataFrame([(*p, 1, 2.0) for p in pts + dirty], GEO)
    good = [p for p in pts] + [("two", 51.0, 7.0), ("two", -12.0, -77.0)]
    for dist in (1.0, 25.0):
        want = {(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[0] != b[0] and km(a[1:], b[1:]) <= dist}
        got = [tuple(x) for x in spatial.near_pairs(df, dist).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_near_pairs_of_a_crowded_town_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "salted", lambda many, few, on, total: skew.salted(many, few, on, total, least=7))
    r = random.Random(4)
    pts = [(f"t{i:03d}", 51 + r.uniform(0, 0.02), 7 + r.uniform(0, 0.03)) for i in range(150)] + [("copy", 51.0, 7.0)] * 40
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in pts for b in pts if a[0] != b[0] and km(a[1:], b[1:]) <= 1}
    got = [tuple(x) for x in spatial.near_pairs(spark.createDataFrame([(*p, 1, 2.0) for p in pts], GEO), 1.0).collect()]
    assert len(got) == len(want) and set(got) == want


def test_points_on_an_inner_edge_are_never_lost(spark):
    r = random.Random(6)
    corners = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(4)]
    corners = sorted(corners, key=lambda p: math.atan2(p[1] - sum(q[1] for q in corners) / 4, p[0] - sum(q[0] for q in corners) / 4))
    ear = ear_clip(corners)
    ends = [corners[i] for i in set(ear[0]) & set(ear[1])]
    df = spark.range(200_000).selectExpr("cast(id AS string) AS id", "(id + 1) / 200002 AS t").selectExpr("id", *[f"{ends[0][k]!r}D * (1 - t) + {ends[1][k]!r}D * t AS {c}" for k, c in enumerate("xy")])
    regions = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in corners])], "region_id int, ring array<struct<x:double,y:double>>")
    assert len(ends) == 2 and spatial.points_in_regions(df, regions, "id", "region_id", "x", "y").count() == 200_000


def test_near_pairs_empty_and_bad_distance(spark):
    assert spatial.near_pairs(spark.createDataFrame([], GEO), 1.0).count() == 0
    with pytest.raises(ValueError):
        spatial.near_pairs(spark.createDataFrame([], GEO), 0)


def test_regions_shared_boundary_overlap_and_dirt(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    regions = spark.createDataFrame(
        [(1, ring((0, 0), (2, 0), (2, 2), (0, 2))), (2, ring((2, 0), (4, 0), (4, 2), (2, 2))), (3, ring((10, 10), (30, 10), (30, 12), (12, 12), (12, 30), (10, 30))), (4, None), (None, ring((0, 0), (1, 0), (0, 1))), (5, ring((0, 0), (1, 1)))],
        "region_id int, ring array<struct<x:double,y:double>>",
    )
    pts = [("in1", 1, 1), ("edge", 2, 1), ("corner", 2, 2), ("in2", 3, 1), ("notch", 20, 20), ("arm", 11, 29), ("out", -1, 0), ("nan", math.nan, 1), (None, 1, 1), ("in1", 1, 1)]
    df = spark.createDataFrame([(p, float(x), float(y), 7) for p, x, y in pts], "id string, x double, y double, level int")
    got = {r.id: r.region_id for r in spatial.points_in_regions(df, regions, "id", "region_id", "x", "y").collect()}
    assert got == {"in1": 1, "edge": 1, "corner": 1, "in2": 2, "arm": 3}
    assert spatial.points_in_regions(df, regions.limit(0), "id", "region_id", "x", "y").count() == 0


def test_regions_match_even_odd_rule(spark):
    r = random.Random(8)
    star = [(math.cos(k * math.pi / 9) * (3 if k % 2 else 1), math.sin(k * math.pi / 9) * (3 if k % 2 else 1)) for k in range(18)]
    pts = [(str(i), r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(600)]

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    regions = spark.createDataFrame([("s", [{"x": x, "y": y} for x, y in star])], "region_id string, ring array<struct<x:double,y:double>>")
    got = {x.id for x in spatial.points_in_regions(spark.createDataFrame(pts, "id string, x double, y double"), regions, "id", "region_id", "x", "y").collect()}
    assert got == {i for i, x, y in pts if inside(x, y)}
