"""The cell-keyed spatial join under all neighbour and predicate operators.

Space is cut into square cells. One side (distance joins) or both (predicate joins) are
replicated to the cells they reach; an equi-join on the cell brings candidates together and
the exact condition decides. Pairs are reported by one cell only, so nothing is deduplicated.
Cell keys are computed, never gathered; crowded cells are left to AQE's skew-join splitting,
as neither side of the join aggregates afterwards on the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planarix import storage
from planarix.functions import geometry as G
from planarix.kernels import planar


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def distance_pairs(left: DataFrame, right: DataFrame, r: float, *, strict: bool = False) -> DataFrame:
    """(a, b, d2) for points (id, x, y) of both sides within r (below r if strict); pairs of equal ids included."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1)).cast("array<bigint>")
    spread = right.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")).select(
        "*", F.explode(F.transform(near, lambda v: v + cell(F.col("bx"), r))).alias("cx")
    ).select("*", F.explode(F.transform(near, lambda v: v + cell(F.col("by"), r))).alias("cy"))
    keyed = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("x"), r).alias("cx"), cell(F.col("y"), r).alias("cy"))
    d2 = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    bound = F.lit(float(r) ** 2)
    # dealt by cell: a broadcast would leave the work with the few tasks that read a small input
    return keyed.join(spread.hint("merge"), ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < bound if strict else F.col("d2") <= bound).select("a", "b", "d2")


def nearest(left: DataFrame, right: DataFrame, k: int, *, r: float | None = None, exclude_self: bool = True, most: int = 40) -> DataFrame:
    """(a, b, d2, n) with the k nearest points of `right` (id, x, y) for each of `left`; ties by id.

    Rings of cells: the radius starts at what holds about 2k points on average and doubles for the
    points that have fewer than k within it, until all have k or the radius spans everything.
    Only points still open take part in a round.
    """
    n, span = right.agg(F.count("*"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    if not n:
        return left.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d2"), F.lit(0).alias("n")).limit(0)
    span = max(float(span or 0.0), 1e-9)
    have = min(k, n - 1) if exclude_self else min(k, n)
    r = r or span * (k / (3.2 * n)) ** 0.5 / 2  # low on purpose: crowded places end early, empty ones go on
    line = Window.partitionBy("a").orderBy("d2", "b")
    open_, done = left.select("id", "x", "y"), None
    for _ in range(most):
        pairs = distance_pairs(open_, right, r)
        if exclude_self:
            pairs = pairs.where("a <> b")
        top = pairs.withColumn("n", F.row_number().over(line)).where(F.col("n") <= k).withColumn("m", F.max("n").over(Window.partitionBy("a")))
        last = r >= 3 * span
        ranked = storage.materialise(top if last else top.where(F.col("m") >= have), "nearest").drop("m")
        done = ranked if done is None else done.unionByName(ranked)
        if last:
            break
        open_ = storage.materialise(open_.join(ranked.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "open")
        if open_.isEmpty():
            break
        r *= 2
    else:
        raise RuntimeError(f"points are still open after {most} radii: start with a larger r")
    return done


def _refine(pairs: DataFrame, predicate: str, distance: float) -> DataFrame:
    """Keep pairs that `plain` accepts or, where it is null, whose geometries satisfy ga.predicate(gb), in numpy over Arrow batches."""
    columns = ["ida", "idb"]
    schema = T.StructType([pairs.schema[c] for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023,E731
            plain = get("plain")
            open_ = plain.is_null()
            keep = plain.fill_null(False).to_numpy(zero_copy_only=False).copy()
            rest = open_.to_numpy(zero_copy_only=False)
            if rest.any():
                a, b = (geometries(get(c).filter(open_)) for c in ("ga", "gb"))
                keep[rest] = [planar.satisfies(predicate, *x, *y, distance) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([get(c) for c in columns], names=columns).filter(pa.array(keep))

    return pairs.mapInArrow(run, schema)


def geometries(col: pa.Array) -> Iterator[tuple[str, list]]:
    """(kind, rings as arrays) of a geometry column, cut out of its flat coordinate buffers."""
    import numpy as np

    kinds, rings = col.field("kind").to_pylist(), col.field("rings")
    outer = rings.offsets.to_numpy()
    inner_list = rings.values
    inner = inner_list.offsets.to_numpy()
    points = inner_list.values
    xy = np.column_stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)])
    for n, kind in enumerate(kinds):
        yield kind, [xy[inner[i] : inner[i + 1]] for i in range(outer[n], outer[n + 1])]


#: Predicates that boxes alone decide, as conditions on two axis-parallel rectangles (prefixes a and b).
def _box_test(predicate: str, distance: float) -> Column:
    c = F.col
    inside = (c("aminx") <= c("bminx")) & (c("aminy") <= c("bminy")) & (c("amaxx") >= c("bmaxx")) & (c("amaxy") >= c("bmaxy"))
    within = (c("bminx") <= c("aminx")) & (c("bminy") <= c("aminy")) & (c("bmaxx") >= c("amaxx")) & (c("bmaxy") >= c("amaxy"))
    proper = (c("aminx") < c("bminx")) & (c("aminy") < c("bminy")) & (c("amaxx") > c("bmaxx")) & (c("amaxy") > c("bmaxy"))
    meet = (c("aminx") <= c("bmaxx")) & (c("bminx") <= c("amaxx")) & (c("aminy") <= c("bmaxy")) & (c("bminy") <= c("amaxy"))
    deep = (c("aminx") < c("bmaxx")) & (c("bminx") < c("amaxx")) & (c("aminy") < c("bmaxy")) & (c("bminy") < c("amaxy"))
    gap = lambda lo, hi: F.greatest(F.lit(0.0), c(f"a{lo}") - c(f"b{hi}"), c(f"b{lo}") - c(f"a{hi}"))
    return {
        "contains": inside, "covers": inside, "within": within, "covered_by": within, "contains_properly": proper, "intersects": meet,
        "touches": meet & ~deep, "overlaps": deep & ~inside & ~within, "crosses": F.lit(False),
        "dwithin": F.pow(gap("minx", "maxx"), 2) + F.pow(gap("miny", "maxy"), 2) <= F.lit(float(distance) ** 2),
    }[predicate]


def predicate_pairs(left: DataFrame, right: DataFrame, predicate: str = "intersects", *, left_id: str, right_id: str, distance: float = 0.0, size: float | None = None) -> DataFrame:
    """(left_id, right_id) for geometries with left.predicate(right).

    Both sides are replicated to the cells of their bounding boxes; a pair counts in the cell of
    the lower left corner of the boxes' intersection. Pairs of axis-parallel rectangles are decided
    by comparisons; the others go through the numpy kernel.
    """
    if predicate not in planar.PREDICATES:
        raise ValueError(f"predicate must be one of {planar.PREDICATES}, got {predicate!r}")
    pad = float(distance) if predicate == "dwithin" else 0.0
    corners = ("minx", "miny", "maxx", "maxy")
    sides, boxes = [], []
    for df in (left, right):  # one small aggregate a side: usual size, and whether all are rectangles
        side = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
        row = G.with_bounds(df).agg(F.percentile_approx(side, 0.5, 1000), F.bool_and(G.is_box(F.col("geometry")))).first()
        sides.append(row[0])
        boxes.append(row[1] is not False)
    if size is None:  # about four times the usual side of the smaller objects
        big = max([s for s in sides if s], default=1.0)
        size = max(4 * min([s for s in sides if s], default=1.0), big / 8, 2 * pad, 1e-9)
    plain_only = all(boxes)

    def cover(df: DataFrame, ident: str, p: str, pad: float) -> DataFrame:
        b = G.with_bounds(df)
        shapes = [] if plain_only else [G.is_box(F.col("geometry")).alias(f"{p}box"), F.col("geometry").alias(f"g{p}")]
        b = b.select(F.col(ident).alias(f"id{p}"), *[F.col(c).alias(f"{p}{c}") for c in corners], *shapes)
        span = lambda axis: F.sequence(cell(F.col(f"{p}min{axis}") - pad, size), cell(F.col(f"{p}max{axis}") + pad, size))
        return b.select("*", F.explode(span("x")).alias("cx")).select("*", F.explode(span("y")).alias("cy"))

    corner = (F.col("cx") == cell(F.greatest(F.col("aminx") - pad, F.col("bminx")), size)) & (F.col("cy") == cell(F.greatest(F.col("aminy") - pad, F.col("bminy")), size))
    meet = (F.col("aminx") - pad <= F.col("bmaxx")) & (F.col("bminx") <= F.col("amaxx") + pad) & (F.col("aminy") - pad <= F.col("bmaxy")) & (F.col("bminy") <= F.col("amaxy") + pad)
    pairs = cover(left, left_id, "a", pad).join(cover(right, right_id, "b", 0.0), ["cx", "cy"]).where(corner & meet)
    if plain_only:
        out = pairs.where(_box_test(predicate, distance)).select("ida", "idb")
    else:
        both = F.col("abox") & F.col("bbox")
        test = F.when(both, _box_test(predicate, distance)).alias("plain")
        out = _refine(pairs.select("ida", "idb", test, *[F.when(~both, F.col(g)).alias(g) for g in ("ga", "gb")]).where("plain is null or plain"), predicate, distance)
    return out.withColumnsRenamed({"ida": left_id, "idb": right_id})
