"""Identity, classes and the core spatial query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planarix import storage
from planarix.functions import geometry as G
from planarix.operators import spatial_join as J


def _before(rows: DataFrame, part: str, n: Column, start: int = 0) -> tuple[DataFrame, int]:
    """(part, __o): the sum of `n` before each partition, one row a partition; and the sum over all."""
    total, before = start, []
    for p, c in sorted((r[part], r["c"]) for r in rows.groupBy(part).agg(F.sum(n).alias("c")).collect()):
        before.append((p, total))
        total += c
    return rows.sparkSession.createDataFrame(before or [(0, start)], f"{part} long, __o long"), total


def set_uid(df: DataFrame, order_by: list[str], start: int = 0, id_col: str = "uid") -> DataFrame:
    """Dense identifiers from `start` in a stated order, without a single-partition window; ties are numbered in any order.

    Rows are range-partitioned, sorted and written once; a partition's offset is the count before it
    (one number a partition comes to the driver).
    """
    rows, place = storage.ranged(df.drop(id_col), order_by)
    rows = rows.withColumn("__p", F.shiftright(place, 33)).withColumn("__n", F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    offsets, _ = _before(rows, "__p", F.lit(1), start)
    return rows.join(F.broadcast(offsets), "__p").withColumn(id_col, F.col("__o") + F.col("__n")).drop("__p", "__n", "__o", place)


def is_categorical(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType | T.BooleanType | T.StructType | T.ArrayType | T.MapType)


def centroids(df: DataFrame, id_col: str = "uid", geom: str = "geometry") -> DataFrame:
    """(id, x, y) of centroids; x and y columns without a geometry are taken as they are."""
    if geom not in df.columns:
        return df.select(F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return df.select(F.col(id_col).alias("id"), G.centroid(F.col(geom)).alias("c")).select("id", "c.x", "c.y")


def drop_duplicate_geometries(df: DataFrame, id_col: str = "uid") -> DataFrame:
    """Of equal geometries the one with the smallest id."""
    kept = df.groupBy("geometry").agg(F.min_by(F.struct(*[c for c in df.columns if c != "geometry"]), F.col(id_col)).alias("__first"))
    return kept.select(*["geometry" if c == "geometry" else F.col("__first")[c].alias(c) for c in df.columns])


def get_objs(area: DataFrame, objects: DataFrame, predicate: str = "intersects", *, id_col: str = "uid", distance: float = 0.0, unique: bool = True) -> DataFrame:
    """Objects o with area.predicate(o) for at least one area; geometric duplicates dropped, unless not `unique`."""
    areas = area.select("geometry").withColumn("__area", F.monotonically_increasing_id())
    hits = J.predicate_pairs(areas, objects, predicate, left_id="__area", right_id=id_col, distance=distance)
    found = objects.join(hits.select(id_col).distinct(), id_col, "left_semi")
    return drop_duplicate_geometries(found, id_col) if unique else found


def interface_members(area1: DataFrame, area2: DataFrame, objects: DataFrame, buffer_dist: float = 200.0, *, id_col: str = "uid", unique: bool = True) -> DataFrame:
    """Objects in area2 no further than `buffer_dist` from area1: the interface query without cutting polygons."""
    inside = get_objs(area2, objects, "contains", id_col=id_col, unique=unique)
    return get_objs(area1, inside, "dwithin", id_col=id_col, distance=buffer_dist, unique=unique)


def col_norm(df: DataFrame, col: str, method: str = "quantile", out: str | None = None, parts: int | None = None) -> DataFrame:
    """Normalise a column to [0, 1] by average rank or by min-max (all equal gives 0; one row gives null ranks).

    Ranks need no global window: equal values are counted, values are range-partitioned and written
    once, and a partition's offset is the sum before it.
    """
    out = out or col
    if method == "minmax":
        lo, hi = F.min(col), F.max(col)
        one = df.agg(lo.alias("__lo"), hi.alias("__hi"))
        v = F.when(F.col("__hi") == F.col("__lo"), 0.0).otherwise((F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
        return df.crossJoin(F.broadcast(one)).withColumn(out, v).drop("__lo", "__hi")  # one row
    if method != "quantile":
        raise ValueError(f"method must be 'quantile' or 'minmax', got {method!r}")
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__c"))
    part, place = storage.ranged(counts, ["__v"], parts)
    part = part.withColumn("__p", F.shiftright(place, 33))
    offsets, total = _before(part, "__p", F.col("__c"))
    part = part.withColumn("__r", F.sum("__c").over(Window.partitionBy("__p").orderBy("__v")))
    rank = F.col("__o") + F.col("__r") - (F.col("__c") - 1) / F.lit(2).cast("double")
    value = F.when(F.lit(total) > 1, (rank - 1) / F.lit(max(1, total - 1)))
    ranks = part.join(F.broadcast(offsets), "__p").select("__v", value.alias("__q"))
    joined = df.join(ranks, df[col] == ranks["__v"], "left")
    return joined.withColumn(out, F.col("__q")).drop("__v", "__q")


def gdf_apply(df: DataFrame, expr, columns: list[str], out: str = "value", return_type: str = "double", batched: bool = False) -> DataFrame:
    """Append expr(*columns): a Column builder or, if `batched`, a function of pandas Series run as an Arrow-batched UDF."""
    cols = [F.col(c) for c in columns]
    if batched:
        return df.withColumn(out, F.pandas_udf(expr, return_type)(*cols))
    made = expr(*cols)
    if not isinstance(made, Column):
        raise TypeError("expr must return a Column; pass batched=True for a function of pandas Series")
    return df.withColumn(out, made)
