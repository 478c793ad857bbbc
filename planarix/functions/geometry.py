"""Planar geometry as Catalyst expressions.

A geometry is ``struct<kind: string, rings: array<array<struct<x: double, y: double>>>>``. Ring 0
of a polygon is its shell, others are holes; rings are closed. A line has one ring of vertices,
a point one ring of one vertex. Multi-part geometries are exploded into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _geometry(kind: str, *rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*rings).alias("rings"))


def flat(geom: Column) -> Column:
    """Ring sizes and coordinates as plain arrays, for pandas: its frames can't hold rings of different lengths."""
    every = F.flatten(geom["rings"])
    made = F.struct(geom["kind"].alias("kind"), F.transform(geom["rings"], lambda r: F.size(r)).alias("n"), every["x"].alias("x"), every["y"].alias("y"))
    return F.when(geom.isNotNull(), made)


def point(x: Column, y: Column) -> Column:
    return _geometry("point", F.array(xy(x, y)))


def line(points: Column) -> Column:
    return _geometry("line", points)


def polygon(*rings: Column) -> Column:
    return _geometry("polygon", *rings)


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    ring = F.array(xy(minx, miny), xy(maxx, miny), xy(maxx, maxy), xy(minx, maxy), xy(minx, miny))
    return polygon(ring)


def translate(geom: Column, dx: Column | float, dy: Column | float) -> Column:
    dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in (dx, dy))
    move = lambda p: xy(p["x"] + dx, p["y"] + dy)
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["rings"], lambda r: F.transform(r, move)).alias("rings"))


def set_precision(geom: Column, digits: int = 6) -> Column:
    """Coordinates rounded to `digits` decimals."""
    cut = lambda p: xy(F.round(p["x"], digits), F.round(p["y"], digits))
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["rings"], lambda r: F.transform(r, cut)).alias("rings"))


def _edges(ring: Column, step) -> Column:
    """Sum of step(p, q) over consecutive vertices."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + step(e["p"], e["q"]))


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area."""
    return F.abs(_edges(ring, _cross)) / 2


def ring_length(ring: Column) -> Column:
    return _edges(ring, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))


def area(geom: Column) -> Column:
    """Shell minus holes; 0 for points and lines."""
    rings = geom["rings"]
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return F.when(geom["kind"] == "polygon", ring_area(rings[0]) - holes).otherwise(0.0)


def length(geom: Column) -> Column:
    """Length of all rings: the perimeter of a polygon."""
    return F.aggregate(geom["rings"], F.lit(0.0), lambda acc, r: acc + ring_length(r))


def centroid(geom: Column) -> Column:
    """Area-weighted centroid of a polygon, length-weighted of a line, the point itself."""
    first = geom["rings"][0]

    def weighted(axis: str) -> Column:
        one = lambda r: F.when(F.lit(True), _edges(r, lambda p, q: (p[axis] + q[axis]) * _cross(p, q)) / 6)
        sign = lambda r: F.signum(_edges(r, _cross))
        total = F.aggregate(
            F.transform(geom["rings"], lambda r, i: F.when(i == 0, 1.0).otherwise(-1.0) * sign(r) * one(r)), F.lit(0.0), lambda a, v: a + v
        )
        size = area(geom)
        along = _edges(first, lambda p, q: (p[axis] + q[axis]) / 2 * F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
        return (
            F.when((geom["kind"] == "polygon") & (size > 0), total / size)
            .when((geom["kind"] != "point") & (ring_length(first) > 0), along / ring_length(first))
            .otherwise(first[0][axis])
        )

    return xy(weighted("x"), weighted("y"))


def bounds(geom: Column) -> Column:
    """struct(minx, miny, maxx, maxy)"""
    points = F.flatten(geom["rings"])
    get = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    return F.struct(
        get(F.array_min, "x").alias("minx"), get(F.array_min, "y").alias("miny"), get(F.array_max, "x").alias("maxx"), get(F.array_max, "y").alias("maxy")
    )


def with_bounds(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Append minx, miny, maxx, maxy as plain doubles, so row-group statistics can prune; kept if all are there."""
    names = ("minx", "miny", "maxx", "maxy")
    if set(names) <= set(df.columns):
        return df
    return df.withColumn("__b", bounds(F.col(geom))).select("*", *[F.col(f"__b.{n}").alias(n) for n in names]).drop("__b")


def is_box(geom: Column) -> Column:
    """Whether a polygon is an axis-parallel rectangle with four corners."""
    ring = geom["rings"][0]
    p = [F.get(ring, F.lit(i)) for i in range(5)]
    level = lambda i, axis: p[i][axis] == p[i + 1][axis]
    turns = lambda a, b: level(0, a) & level(1, b) & level(2, a) & level(3, b)
    closed = (p[0]["x"] == p[4]["x"]) & (p[0]["y"] == p[4]["y"])
    return F.coalesce((geom["kind"] == "polygon") & (F.size(geom["rings"]) == 1) & (F.size(ring) == 5) & closed & (turns("y", "x") | turns("x", "y")), F.lit(False))


def holes(geom: Column) -> Column:
    """Interior rings as an array of polygons."""
    rings = geom["rings"]
    inner = F.when(F.size(rings) > 1, F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1)))).otherwise(F.slice(rings, 1, 0))
    return F.transform(inner, lambda r: F.struct(F.lit("polygon").alias("kind"), F.array(r).alias("rings")))


def is_valid(geom: Column) -> Column:
    """Closed rings with an area for polygons, two vertices for lines, no missing or non-finite coordinate.

    Self-intersection needs the kernel `planarix.kernels.planar.simple`.
    """
    fine = F.forall(F.flatten(geom["rings"]), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    closed = F.forall(geom["rings"], lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)) & (ring_area(r) > 0))
    return fine & F.when(geom["kind"] == "polygon", closed).when(geom["kind"] == "line", F.size(geom["rings"][0]) >= 2).otherwise(F.size(geom["rings"]) > 0)


def contains_point(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over all rings; points on an upper or right edge count as outside."""

    def crossing(p: Column, q: Column) -> Column:
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"]
        return F.when(spans & (x < at), 1.0).otherwise(0.0)

    hits = F.aggregate(geom["rings"], F.lit(0.0), lambda acc, r: acc + _edges(r, crossing))
    return (hits % 2) == 1


def point_distance(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a geometry; 0 inside a polygon."""

    def segment(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / size))).otherwise(0.0)
        return F.sqrt(F.pow(p["x"] + t * dx - x, 2) + F.pow(p["y"] + t * dy - y, 2))

    def ring(r: Column) -> Column:
        pairs = F.arrays_zip(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(1))).alias("p"), F.when(F.size(r) > 1, F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1)))).otherwise(r).alias("q"))
        return F.array_min(F.transform(pairs, lambda e: segment(e["p"], e["q"])))

    away = F.array_min(F.transform(geom["rings"], ring))
    return F.when((geom["kind"] == "polygon") & contains_point(geom, x, y), 0.0).otherwise(away)


def to_wkt(geom: Column) -> Column:
    """Well-known text."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    body = F.array_join(F.transform(geom["rings"], ring), ", ")
    return F.when(geom["kind"] == "polygon", F.concat(F.lit("POLYGON ("), body, F.lit(")"))).when(geom["kind"] == "line", F.concat(F.lit("LINESTRING "), body)).otherwise(F.concat(F.lit("POINT "), body))
