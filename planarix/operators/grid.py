"""Grids over objects: rectangular, quad (Web Mercator) and hexagonal cells, and aggregation by cell."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarix import storage
from planarix.functions import geometry as G
from planarix.functions import projection as P
from planarix.operators import spatial_join as J

#: Extra extent around a grid's objects, on each side.
PAD = 20


def _extent(df: DataFrame) -> tuple[float, float, float, float] | None:
    b = G.with_bounds(df).agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    return None if b[0] is None else tuple(float(v) for v in b)


def rect_grid(df: DataFrame, resolution: tuple[int, int] = (256, 256), overlap: int = 0, predicate: str = "intersects", *, id_col: str = "uid", full: bool = False) -> DataFrame:
    """(cell_id, row, col, geometry, bounds) of the grid cells c with object.predicate(c) for some object.

    resolution is (height, width); overlap a percentage. Cells come from arithmetic on the padded
    extent; without overlap and for axis-parallel rectangles nothing else is evaluated.
    """
    if not (len(resolution) == 2 and all(int(r) > 0 for r in resolution)):
        raise ValueError(f"resolution must be two positive numbers, got {resolution}")
    if not 0 <= overlap < 100:
        raise ValueError(f"overlap must be in [0, 100), got {overlap}")
    if predicate not in ("intersects", "within", "contains", "contains_properly", "covers", "covered_by", "overlaps", "touches", "crosses"):
        raise ValueError(f"unknown predicate {predicate!r}")
    spark, ext = df.sparkSession, _extent(df)
    (h, w), stride = (int(r) for r in resolution), [max(1, int(r * (1 - overlap / 100))) for r in resolution]
    if ext is None:
        empty = spark.range(0)
        return _cells(empty.select(F.col("id").cast("int").alias("row"), F.col("id").cast("int").alias("col")), 0, 0, 1, 1, w, h, 1)
    x0, y0 = math.floor(ext[0]) - PAD, math.floor(ext[1]) - PAD
    wide, high = math.ceil(ext[2]) + PAD - x0, math.ceil(ext[3]) + PAD - y0
    rows, cols = 1 + max(1, math.ceil((high - h) / stride[0])), 1 + max(1, math.ceil((wide - w) / stride[1]))
    if full or predicate != "intersects":
        line = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    else:  # only cells that some bounding box reaches
        span = lambda lo, hi, start, step, size, n: F.sequence(
            F.greatest(F.lit(0), F.ceil((F.col(lo) - start - size) / F.lit(step)).cast("int")), F.least(F.lit(n - 1), F.floor((F.col(hi) - start) / F.lit(step)).cast("int"))
        )
        b = G.with_bounds(df).select("minx", "miny", "maxx", "maxy")
        line = b.select(F.explode(span("miny", "maxy", y0, stride[0], h, rows)).alias("row"), "minx", "maxx").select("row", F.explode(span("minx", "maxx", x0, stride[1], w, cols)).alias("col")).distinct()
    cells = _cells(line, x0, y0, stride[1], stride[0], w, h, cols)
    boxes = G.with_bounds(df).agg(F.bool_and(G.is_box(F.col("geometry")))).first()[0]
    if full or (predicate == "intersects" and boxes):  # a rectangle meets every cell that its bounds reach
        return cells
    hits = J.predicate_pairs(df.select(F.col(id_col).alias("__o"), "geometry"), cells, predicate, left_id="__o", right_id="cell_id")
    return cells.join(hits.select("cell_id").distinct(), "cell_id", "left_semi")


def _cells(line: DataFrame, x0: float, y0: float, sx: float, sy: float, w: float, h: float, cols: int) -> DataFrame:
    minx, miny = F.col("col") * F.lit(float(sx)) + F.lit(float(x0)), F.col("row") * F.lit(float(sy)) + F.lit(float(y0))
    made = line.select((F.col("row").cast("long") * cols + F.col("col")).alias("cell_id"), "row", "col", minx.alias("minx"), miny.alias("miny"), (minx + w).alias("maxx"), (miny + h).alias("maxy"))
    return made.withColumn("geometry", G.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))


def quadbin_grid(df: DataFrame, resolution: int = 17, to_lonlat: bool = True) -> DataFrame:
    """(cell_id, geometry) of the quad cells that intersect some object, 64-bit ids, outlines in input coordinates."""
    b = G.with_bounds(df)
    corner = lambda x, y: P.xy_to_lonlat(F.col(x), F.col(y)) if to_lonlat else F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    # the projected outline of a box isn't a box: take the extremes of its four corners
    corners = [corner(x, y) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    axis = lambda f, name: f(F.transform("__c", lambda c: c[name]))
    ext = b.select("*", F.array(*corners).alias("__c")).select("*", axis(F.array_min, "lon").alias("__w"), axis(F.array_max, "lon").alias("__e"), axis(F.array_min, "lat").alias("__s"), axis(F.array_max, "lat").alias("__n"))
    tile = lambda lon, lat: P.lonlat_to_tile(F.col(lon), F.col(lat), resolution)
    span = ext.select(tile("__w", "__n").alias("a"), tile("__e", "__s").alias("z"))
    tiles = span.select(F.explode(F.sequence("a.x", "z.x")).alias("tx"), "a", "z").select("tx", F.explode(F.sequence("a.y", "z.y")).alias("ty")).distinct()
    ring = F.array(*[_tile_corner(F.col("tx") + dx, F.col("ty") + dy, resolution, to_lonlat) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    cells = tiles.select(P.quadbin(F.col("tx"), F.col("ty"), resolution).alias("cell_id"), "tx", "ty", G.polygon(ring).alias("geometry"))
    hits = J.predicate_pairs(cells, df.select(F.monotonically_increasing_id().alias("__o"), "geometry"), "intersects", left_id="cell_id", right_id="__o")
    return cells.join(hits.select("cell_id").distinct(), "cell_id", "left_semi")


def _tile_corner(tx: Column, ty: Column, z: int, to_lonlat: bool) -> Column:
    at = P.tile_to_lonlat(tx, ty, z)
    if not to_lonlat:
        return G.xy(at["lon"], at["lat"])
    back = P.lonlat_to_xy(at["lon"], at["lat"])
    return G.xy(back["x"], back["y"])


def hex_grid(df: DataFrame, edge: float) -> DataFrame:
    """(cell_id, q, r, geometry) of planar pointy-topped hexagons whose centre lies in some object.

    Planar axial coordinates, not an icosahedral index: same containment rule and adjacency, other ids.
    """
    step, e = math.sqrt(3) * edge, F.lit(float(edge))
    b = G.with_bounds(df)
    rows = b.select("geometry", "minx", "maxx", F.explode(F.sequence(F.ceil(F.col("miny") / (1.5 * e)).cast("long"), F.floor(F.col("maxy") / (1.5 * e)).cast("long"))).alias("r"))
    shift = F.col("r") / 2
    made = rows.select("geometry", "r", F.explode(F.sequence(F.ceil(F.col("minx") / step - shift).cast("long"), F.floor(F.col("maxx") / step - shift).cast("long"))).alias("q"))
    cx, cy = (F.col("q") + F.col("r") / 2) * step, F.col("r") * 1.5 * e
    inside = made.where(F.when(F.col("geometry.kind") == "polygon", G.contains_point(F.col("geometry"), cx, cy)).otherwise(False)).select("q", "r").distinct()
    ring = F.array(*[G.xy(cx + edge * math.cos(math.pi / 6 + k * math.pi / 3), cy + edge * math.sin(math.pi / 6 + k * math.pi / 3)) for k in (0, 1, 2, 3, 4, 5, 0)])
    return inside.select(F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string")).alias("cell_id"), "q", "r", G.polygon(ring).alias("geometry"))


def h3_grid(*_: object, **__: object) -> DataFrame:
    raise NotImplementedError("icosahedral hexagon ids need tables that aren't part of this repository; use hex_grid")


def grid_aggregate(grid: DataFrame, objs: DataFrame, metrics: dict[str, Column] | Callable, predicate: str = "intersects", *, id_col: str = "uid", empty: dict[str, object] | None = None, schema: str | None = None) -> DataFrame:
    """Append aggregates over the objects o with cell.predicate(o) to every cell, empty ones included.

    `metrics` is {name: aggregate Column}, or a function of a pandas frame returning a tuple of
    values, with `schema` naming them (a UDAF on Arrow batches; also called for empty cells).
    """
    if predicate not in ("intersects", "within", "contains", "contains_properly"):
        raise ValueError(f"predicate must be one of intersects, within, contains, contains_properly; got {predicate!r}")
    if not hasattr(grid, "_shared_path"):  # it is read several times
        grid = storage.materialise(grid, "grid")
    pairs = J.predicate_pairs(grid, objs, predicate, left_id="cell_id", right_id=id_col)
    if callable(metrics):
        if not schema:
            raise ValueError("an opaque metric needs a schema")
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        columns = [c for c in objs.columns if c != "geometry"]
        rows = grid.select("cell_id").join(pairs.join(objs.select(*columns), id_col), "cell_id", "left")

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            got = metrics(pdf[pdf[id_col].notna()].drop(columns="cell_id"))
            got = got if isinstance(got, tuple) else (got,)
            return pd.DataFrame([[key[0], *got]], columns=["cell_id", *names])

        kind = dict(grid.dtypes)["cell_id"]
        made = rows.groupBy("cell_id").applyInPandas(run, f"cell_id {kind}, {schema}")
    else:
        made = pairs.join(objs, id_col).groupBy("cell_id").agg(*[c.alias(n) for n, c in metrics.items()])
        names = list(metrics)
    out = grid.drop(*names).join(made, "cell_id", "left")
    for n, v in (empty or {}).items():
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(v)))
    return out


def class_count(name: str, class_col: str = "class_name") -> Column:
    return F.count_if(F.col(class_col) == name)


def class_fraction(name: str, class_col: str = "class_name") -> Column:
    return F.try_divide(F.count_if(F.col(class_col) == name).cast("double"), F.count("*").cast("double"))


def class_ratio(top: str, bottom: str, class_col: str = "class_name") -> Column:
    """Ratio of two class fractions; 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(F.count_if(F.col(class_col) == top).cast("double"), F.count_if(F.col(class_col) == bottom).cast("double")), F.lit(0.0))


def get_sub_grids(grid: DataFrame, min_size: int = 1) -> DataFrame:
    """Cells of components under corner or edge contact that have more than `min_size` cells, with `component`."""
    from planarix.operators.components import components

    touch = J.predicate_pairs(grid.select(F.col("cell_id").alias("a"), "geometry"), grid.select(F.col("cell_id").alias("b"), "geometry"), "intersects", left_id="a", right_id="b")
    found = components(touch.where("a < b"))
    all_ = grid.join(found, grid["cell_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "cell_id")).drop("node")
    sizes = all_.groupBy("component").agg(F.count("*").alias("component_size")).where(F.col("component_size") > min_size)
    return all_.join(sizes, "component")


def to_xywh(geom: Column) -> Column:
    """Bounding box as truncated integers (x, y, w, h)."""
    b = G.bounds(geom)
    n = lambda v: v.cast("int")
    return F.struct(n(b["minx"]).alias("x"), n(b["miny"]).alias("y"), n(b["maxx"] - b["minx"]).alias("w"), n(b["maxy"] - b["miny"]).alias("h"))


def from_xywh(xywh: Column) -> Column:
    return G.box(xywh["x"], xywh["y"], xywh["x"] + xywh["w"], xywh["y"] + xywh["h"])
