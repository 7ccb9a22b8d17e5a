"""Points in regions and points near points.

Regions are cut into triangles by ear clipping. Triangles hang in a linear
bounding-volume hierarchy: a node is a square cell of side 2^level, named by
(space, level, ix, iy), and its ancestors follow by halving the indices. A
triangle hangs at the level whose cells are about as large as its bounding box
(so in at most nine of them), a point walks its chain of ancestors over the
levels in use. Both meet in an equi-join on the node - distributed, with no tree
on the driver; nodes with very many points are dealt over several tasks - and
are then tested exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bridge, ear_clip
from ..session import materialise
from .skew import salted

#: Mean radius of the Earth in km (fixed value).
EARTH_KM = 6371.0088


def triangulate(regions: DataFrame, key: str = "region_id", ring: str = "ring") -> DataFrame:
    """(key, ax, ay, bx, by, cx, cy): the triangles of each region.

    A ring is ARRAY<STRUCT<x, y>>; a column ``holes``, if there is one, is an
    array of such rings cut out of it. NULL keys or rings, rings with NULL or
    non-finite corners and rings without area give no triangles; such holes are
    not cut out.
    """
    kind = regions.schema[key].dataType.simpleString()

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, flat = [], []
            for i, (r, holes) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                corners = [(p["x"], p["y"]) for p in r]
                if holes:
                    corners = bridge(corners, [[(p["x"], p["y"]) for p in h] for h in holes])
                for a, b, c in ear_clip(corners):
                    of.append(i)
                    flat.append((*corners[a], *corners[b], *corners[c]))
            cols = list(zip(*flat)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, pa.float64()) for c in cols]], names=[key, *names])

    names = [f"{n}{d}" for n in "abc" for d in "xy"]
    good = lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < math.inf) & (F.abs(p["y"]) < math.inf))
    as_double = lambda r: F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    holes = F.coalesce(F.filter(F.transform("holes", as_double), lambda r: r.isNotNull() & good(r)), none) if "holes" in regions.columns else none
    clean = regions.filter(F.col(key).isNotNull() & F.col(ring).isNotNull()).select(F.col(key).alias("k"), as_double(F.col(ring)).alias("r"), holes.alias("h")).filter(good(F.col("r")))
    return clean.mapInArrow(clip, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))


def _level(box: Column) -> Column:
    """Level of the cells about as large as half of a bounding box's longer side."""
    return F.ceil(F.log2(F.greatest(box, F.lit(2.0**-60))) - 1).cast("int")


def hang(triangles: DataFrame) -> DataFrame:
    """Adds (level, ix, iy): one row per hierarchy node that a triangle's box touches."""
    low_x, high_x = F.least("ax", "bx", "cx"), F.greatest("ax", "bx", "cx")
    low_y, high_y = F.least("ay", "by", "cy"), F.greatest("ay", "by", "cy")
    side = F.pow(F.lit(2.0), F.col("level"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))
    return triangles.withColumn("level", _level(F.greatest(high_x - low_x, high_y - low_y))).withColumn("ix", cells(low_x, high_x)).withColumn("iy", cells(low_y, high_y))


def climb(points: DataFrame, levels: list[int]) -> DataFrame:
    """Adds (level, ix, iy): one row per ancestor of a point at the levels in use."""
    side = F.pow(F.lit(2.0), F.col("level"))
    up = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return up.withColumn("ix", F.floor(F.col("x") / side)).withColumn("iy", F.floor(F.col("y") / side))


def _inside(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Exact closed test of (x, y) against the triangle, of either orientation.

    An edge is always evaluated from the smaller of its ends, so two triangles
    see a shared edge alike and a point on it or near it is in one of them.
    """

    def cross(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        turned = (b[0] < a[0]) | ((b[0] == a[0]) & (b[1] < a[1]))
        side = lambda p, q: (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])
        return F.when(turned, -side(b, a)).otherwise(side(a, b))

    a, b, c = corners
    s, t, u = cross(a, b), cross(b, c), cross(c, a)
    return ((s >= 0) & (t >= 0) & (u >= 0)) | ((s <= 0) & (t <= 0) & (u <= 0))


def meet(points: DataFrame, triangles: DataFrame, levels: list[int], total: int) -> DataFrame:
    """Points joined with the triangles that cover them (edges count as inside).

    A pair comes once per node both share: once per triangle, since a triangle
    names each of its nodes once and a point has one ancestor per level.
    ``total`` is about the number of points; the nodes that hold very many of
    them, as the coarse ones of large triangles do, are salted.
    """
    on = ["level", "ix", "iy"]
    many, few = salted(climb(points, levels), hang(triangles), on, total * len(levels))
    corners = [(F.col(f"{n}x"), F.col(f"{n}y")) for n in "abc"]
    return many.join(few, [*on, "_salt"]).filter(_inside(F.col("x"), F.col("y"), corners))


def points_in_regions(points: DataFrame, regions: DataFrame, point_key: str, region_key: str, x: str, y: str) -> DataFrame:
    """(point_key, x, y, region_key): each distinct point with the region containing it.

    Plane geometry, boundaries belong to the region. A point on the boundary of
    several regions (or inside overlapping ones) is assigned to the smallest
    region key only. Points outside all regions do not come out. NULL keys, NULL,
    NaN or infinite coordinates are left out; repeated rows count once.
    """
    good = F.col(point_key).isNotNull() & (F.abs(F.col(x)) < math.inf) & (F.abs(F.col(y)) < math.inf)
    pts = points.filter(good).select(F.col(point_key).alias("_p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()
    tri = materialise(triangulate(regions, region_key), "triangles")
    spans = tri.select(_level(F.greatest(F.greatest("ax", "bx", "cx") - F.least("ax", "bx", "cx"), F.greatest("ay", "by", "cy") - F.least("ay", "by", "cy"))).alias("level"))
    levels = sorted(r.level for r in spans.distinct().collect())  # at most one per binary exponent
    met = meet(pts, tri, levels or [0], points.count())
    best = met.groupBy("_p", "x", "y").agg(F.min(region_key).alias(region_key))
    return best.select(F.col("_p").alias(point_key), F.col("x").alias(x), F.col("y").alias(y), region_key)


def valid_locations(geo: DataFrame) -> DataFrame:
    """Distinct (geo_id, latitude, longitude) with a key and real coordinates; (0, 0) is a placeholder."""
    lat, lon = F.col("latitude"), F.col("longitude")
    good = F.col("geo_id").isNotNull() & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon)
    return geo.filter(good).select("geo_id", "latitude", "longitude").distinct()


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the sphere of radius EARTH_KM."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def near_pairs(geo: DataFrame, km: float) -> DataFrame:
    """(geo_id_a, geo_id_b), a < b: different geos with some rows at most ``km`` apart.

    The neighbourhood of a point is a region too: the square that circumscribes
    its distance disc in its tangent plane, ear-clipped into triangles. The globe
    is unfolded onto the six faces of a cube by gnomonic projection, under which
    great circles are straight, so the squares stay polygons and poles and the
    date line are no special places; a square reaching over an edge hangs in
    each face it may touch. All squares are of about one size, so one level of
    the hierarchy is in use. Being near is mutual, so of two cells only the
    square of one visits the other, and only locations travel: a candidate is
    tested in the tangent plane, where the square's triangles are the same for
    every point, and then by great circle. Cells with very many points are
    salted. ``km`` may be at most 1000. An empty table gives no rows.
    """
    if not 0 < km <= 1000:
        raise ValueError("km must lie in (0, 1000]")
    theta = km / EARTH_KM
    half = math.tan(theta) * (1 + 1e-6)
    square = [(-half, -half), (half, -half), (half, half), (-half, half)]
    side = 2.0 ** math.ceil(math.log2(4 * half))
    phi, lam = F.radians("latitude"), F.radians("longitude")
    base = valid_locations(geo).select("geo_id", "latitude", "longitude", (F.cos(phi) * F.cos(lam)).alias("p0"), (F.cos(phi) * F.sin(lam)).alias("p1"), F.sin(phi).alias("p2"))
    size = [F.abs(f"p{i}") for i in range(3)]
    p = [F.col(f"p{i}") for i in range(3)]
    pick = lambda kind, i: F.when(F.col("axis") == 0, kind[i % 3]).when(F.col("axis") == 1, kind[(i + 1) % 3]).otherwise(kind[(i + 2) % 3])
    face = F.col("axis") * 2 + F.when(F.col("sign") < 0, 1).otherwise(0)
    cell = lambda x, y: F.xxhash64(face, x, y)
    own = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    placed = base.withColumn("axis", own).withColumn("sign", F.when(pick(p, 0) < 0, -1).otherwise(1))
    placed = placed.withColumn("home", cell(F.floor(pick(p, 1) / pick(p, 0) / side), F.floor(pick(p, 2) / pick(p, 0) / side))).drop("axis", "sign")
    points = placed.select(F.col("geo_id").alias("geo_id_b"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b"), F.col("home").alias("cell"))
    # tangent frame: u is level (or any, at the poles), v = p x u
    u = [-F.sin(lam), F.cos(lam), F.lit(0.0)]
    framed = placed.withColumns({f"u{i}": u[i] for i in range(3)})
    cu = [F.col(f"u{i}") for i in range(3)]
    framed = framed.withColumns({f"v{i}": p[(i + 1) % 3] * cu[(i + 2) % 3] - p[(i + 2) % 3] * cu[(i + 1) % 3] for i in range(3)})
    cv = [F.col(f"v{i}") for i in range(3)]
    # all faces whose part of the sphere the square can reach
    reach = 3 * 2 * math.sqrt(2) * half
    faces = F.filter(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign"), (p[a] * s - F.greatest(size[(a + 1) % 3], size[(a + 2) % 3])).alias("lead")) for a in range(3) for s in (1, -1)]), lambda f: f["lead"] >= -reach)
    faced = framed.withColumn("_f", F.explode(faces)).withColumns({"axis": F.col("_f.axis"), "sign": F.col("_f.sign")})
    corners = {}
    for i, (su, sv) in enumerate(square):
        q = [p[k] + cu[k] * su + cv[k] * sv for k in range(3)]
        corners[f"x{i}"], corners[f"y{i}"] = pick(q, 1) / pick(q, 0), pick(q, 2) / pick(q, 0)
    span = lambda d: F.explode(F.sequence(F.floor(F.least(*[f"{d}{i}" for i in range(4)]) / side), F.floor(F.greatest(*[f"{d}{i}" for i in range(4)]) / side)))
    hung = faced.withColumns(corners).withColumn("ix", span("x")).withColumn("iy", span("y")).withColumn("cell", cell(F.col("ix"), F.col("iy")))
    squares = hung.filter("cell >= home").select(F.col("geo_id").alias("geo_id_a"), F.col("latitude").alias("lat_a"), F.col("longitude").alias("lon_a"), "cell", (F.col("cell") == F.col("home")).alias("at_home"))
    many, few = salted(points, squares, ["cell"], geo.count())
    once = (F.col("geo_id_a") < F.col("geo_id_b")) | (~F.col("at_home") & (F.col("geo_id_a") != F.col("geo_id_b")))
    met = many.join(few, ["cell", "_salt"]).filter(once & (F.abs(F.col("lat_a") - F.col("lat_b")) <= math.degrees(theta) * (1 + 1e-6)))
    # b in the tangent plane of a; the explode of one keeps the optimizer from repeating the sines wherever they are used
    fa, fb, turn = F.radians("lat_a"), F.radians("lat_b"), F.radians(F.col("lon_b") - F.col("lon_a"))
    sines = F.struct(*[f(x).alias(f"{k}{n}") for n, x in (("a", fa), ("b", fb), ("t", turn)) for k, f in (("s", F.sin), ("c", F.cos))])
    q = {n: F.col(f"_q.{n}") for n in ("sa", "ca", "sb", "cb", "st", "ct")}
    met = met.withColumn("_q", F.explode(F.array(sines)))
    ahead = q["sa"] * q["sb"] + q["ca"] * q["cb"] * q["ct"]
    x, y = q["cb"] * q["st"] / ahead, (q["ca"] * q["sb"] - q["sa"] * q["cb"] * q["ct"]) / ahead
    triangles = [[tuple(F.lit(c) for c in square[i]) for i in t] for t in ear_clip(square)]
    met = met.filter((ahead > 0) & reduce(Column.__or__, [_inside(x, y, t) for t in triangles]))
    exact = met.filter(haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= km)
    return exact.select(F.least("geo_id_a", "geo_id_b").alias("geo_id_a"), F.greatest("geo_id_a", "geo_id_b").alias("geo_id_b")).distinct()
