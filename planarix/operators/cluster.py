"""Density clustering, cluster features and centrography."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planarix import storage
from planarix.functions import geometry as G
from planarix.kernels import density, planar
from planarix.operators import band
from planarix.operators import spatial_join as J
from planarix.operators.objects import centroids

METHODS = ("dbscan", "adbscan", "optics", "hdbscan")


def dbscan(df: DataFrame, eps: float = 350.0, min_samples: int = 30, *, id_col: str = "uid") -> DataFrame:
    """(id, label): DBSCAN tile by tile, without a table of pairs. Cores have at least `min_samples` points within eps, themselves included;
    clusters are components of cores; a border point takes the smallest adjacent label; noise is -1.
    Labels count clusters by their smallest core id.
    """
    c = centroids(df, id_col)
    points = storage.materialise(band.reduce(c, eps, "core boolean", lambda near: [near.near.sum(1) >= min_samples], keep=["id", "x", "y"]), "points")
    found = storage.materialise(band.components(points.where("core"), eps).withColumnRenamed("node", "id"), "found")
    # clusters in order of their smallest core
    first = found.select("component").distinct()
    from planarix.operators.objects import set_uid

    labels = set_uid(first, ["component"], id_col="label") if not first.isEmpty() else first.withColumn("label", F.lit(0).cast("long"))
    placed = storage.materialise(points.join(found.join(labels, "component").select("id", "label"), "id", "left"), "placed")

    def least(near: band.Near) -> list:
        got = np.where(near.near, np.nan_to_num(near.columns["label"][near.of].astype(float), nan=np.inf), np.inf).min(1)
        none = np.isinf(got)
        return [pa.array(np.where(none, 0, got).astype(np.int64), mask=none)]

    border = band.reduce(placed.select("*"), eps, "border bigint", least, keep=["id"], ask=~F.col("core"))
    out = placed.where("core").select("id", "label").unionAll(border)
    return out.select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).cast("int").alias("labels"))


def density_clustering(df: DataFrame, eps: float = 350.0, min_samples: int = 30, method: str = "dbscan", *, id_col: str = "uid", by: list[str] | None = None, **options) -> DataFrame:
    """(id, labels), noise -1. dbscan runs as joins at any size; the others are global in one slide's points and run one task a slide (`by`)."""
    if method not in METHODS:
        raise ValueError(f"Illegal clustering method {method!r}. Choose from {METHODS}")
    if method == "dbscan":
        return dbscan(df, eps, min_samples, id_col=id_col)
    keyed = df.select(F.col(id_col).alias("id"), F.struct(F.lit(0), *(by or [])).alias("slide")).join(centroids(df, id_col), "id")
    kernel = {"adbscan": density.adbscan, "optics": density.optics, "hdbscan": density.hdbscan}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        got = kernel(pdf[["x", "y"]].to_numpy(float), eps=eps, min_samples=min_samples, **options)
        return pd.DataFrame({id_col: pdf["id"].to_numpy(), "labels": got.astype("int32")})

    return keyed.groupBy(F.to_json("slide")).applyInPandas(run, f"{id_col} long, labels int")


HULLS = ("alpha_shape", "convex_hull", "ellipse", "bbox")


def hulls(df: DataFrame, by: str, hull_type: str = "convex_hull", *, id_col: str = "uid") -> DataFrame:
    """(by, geometry): a polygon around the centroids of each group. bbox is an aggregate; others see one group a task."""
    if hull_type not in HULLS:
        raise ValueError(f"hull_type must be one of {HULLS}, got {hull_type!r}")
    rows = df.select(F.col(id_col).alias("id"), by).join(centroids(df, id_col), "id")
    if hull_type == "bbox":
        return rows.groupBy(by).agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).select(by, G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geometry"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = density.hull(pdf[["x", "y"]].to_numpy(float), hull_type)
        rings = [[{"x": float(x), "y": float(y)} for x, y in ring]]
        return pd.DataFrame({by: [key[0]], "geometry": [{"kind": "polygon", "rings": rings}]})

    return rows.groupBy(by).applyInPandas(run, f"{by} {dict(df.dtypes)[by]}, geometry {G.GEOMETRY}")


def cluster_feats(df: DataFrame, label_col: str = "labels", hull_type: str = "alpha_shape", normalize_orientation: bool = True, *, id_col: str = "uid") -> DataFrame:
    """(label, area, dispersion, size, orientation) of each cluster; size and dispersion are aggregates, area and orientation come from hulls."""
    if hull_type == "bbox" or hull_type not in HULLS:
        raise ValueError(f"hull_type must be one of {HULLS[:3]}, got {hull_type!r}")
    rows = df.select(F.col(id_col).alias("id"), label_col).join(centroids(df, id_col), "id")
    stats = rows.groupBy(label_col).agg(F.count("*").alias("size"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("dispersion"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ring = density.hull(pdf[["x", "y"]].to_numpy(float), hull_type)
        corners = planar.min_rotated_rectangle(ring)
        return pd.DataFrame({label_col: [key[0]], "area": [abs(planar.shoelace(ring))], "orientation": [planar_angle(corners, normalize_orientation)]})

    kind = dict(df.dtypes)[label_col]
    made = rows.groupBy(label_col).applyInPandas(run, f"{label_col} {kind}, area double, orientation double")
    return stats.join(made, label_col).select(label_col, "area", "dispersion", "size", "orientation")


def planar_angle(corners: np.ndarray, normalize: bool) -> float:
    """Angle in degrees of the longer side of a rotated rectangle."""
    a, b = corners[1] - corners[0], corners[2] - corners[1]
    v = a if np.hypot(*a) >= np.hypot(*b) else b
    t = np.degrees(np.arctan2(v[1], v[0]) % np.pi)
    return float(min(t, 180 - t) if normalize else t)


def cluster_tendency(df: DataFrame, centroid_method: str = "mean", weight_col: str | None = None, *, by: list[str] | None = None, id_col: str = "uid") -> DataFrame:
    """Centre (x, y) of all objects or of each group: mean, median or weighted_mean."""
    cols = [*(by or []), *([weight_col] if weight_col else [])]
    rows = df.select(F.col(id_col).alias("id"), *cols).join(centroids(df, id_col), "id")
    if centroid_method == "weighted_mean" and not weight_col:
        raise ValueError("weighted_mean needs weight_col")
    make = {
        "mean": F.avg, "median": F.median, "weighted_mean": lambda v: F.sum(F.col(v) * F.col(weight_col)) / F.sum(weight_col),
    }
    if centroid_method not in make:
        raise ValueError(f"centroid_method must be one of {tuple(make)}, got {centroid_method!r}")
    f = make[centroid_method]
    return rows.groupBy(*(by or [])).agg(f("x").alias("x"), f("y").alias("y"))


def std_distance(df: DataFrame, by: list[str] | None = None, id_col: str = "uid") -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), *(by or [])).join(centroids(df, id_col), "id")
    return rows.groupBy(*(by or [])).agg(F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("std_distance"))


#: Tissues, and their vertices together, that are broadcast.
FEW, MOST_POINTS = 64, 20_000


def dists_to_tissue(objs: DataFrame, tissues: DataFrame, tissue_class: str, *, id_col: str = "uid", out: str | None = None) -> DataFrame:
    """Append dist_to_{class}: distance of each centroid to the nearest tissue of a class, 0 inside; null if there is none.

    Few and small tissues (at most FEW of MOST_POINTS vertices together) are broadcast, and each object meets
    all of them; else radii grow until every object has a tissue within its own.
    """
    name = out or f"dist_to_{tissue_class}"
    few = tissues.where(F.col("class_name") == tissue_class).select(F.col("geometry").alias("g"))
    c = centroids(objs, id_col)
    size = few.agg(F.count("*").alias("n"), F.sum(F.aggregate("g.rings", F.lit(0), lambda a, r: a + F.size(r))).alias("points")).first()
    if size["n"] <= FEW and (size["points"] or 0) <= MOST_POINTS:
        pairs = c.join(F.broadcast(few))
        made = pairs.groupBy("id").agg(F.min(G.point_distance(F.col("g"), F.col("x"), F.col("y"))).alias(name))
        return objs.drop(name).join(made, objs[id_col] == made["id"], "left").drop("id")
    return _nearest_by_rings(objs, few, c, name, id_col)


def _nearest_by_rings(objs: DataFrame, few: DataFrame, c: DataFrame, name: str, id_col: str) -> DataFrame:
    """Many tissues: radii double until every object has a tissue within its radius."""
    t = few.withColumn("t", F.monotonically_increasing_id()).withColumnRenamed("g", "geometry")
    t = storage.materialise(t, "tissues")
    r, done, open_ = 64.0, None, c
    for _ in range(40):
        points = open_.select("id", G.point(F.col("x"), F.col("y")).alias("geometry"))
        pairs = J.predicate_pairs(points, t, "dwithin", left_id="id", right_id="t", distance=r)
        near = pairs.join(open_, "id").join(t, "t").groupBy("id").agg(F.min(G.point_distance(F.col("geometry"), F.col("x"), F.col("y"))).alias(name))
        near = storage.materialise(near, "near")
        done = near if done is None else done.unionAll(near)
        open_ = open_.join(near, "id", "left_anti")
        if open_.isEmpty():
            break
        r *= 4
    return objs.drop(name).join(done, objs[id_col] == done["id"], "left").drop("id")
