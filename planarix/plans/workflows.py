"""End-to-end workflows over the fixture views, registered beside the operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planarix import storage
from planarix.functions import binning
from planarix.functions import geometry as G
from planarix.operators import cluster, graph, grid, nhood, objects, overlay, pixel, rasterise, shape
from planarix.plans import fixtures as X
from planarix.plans.catalogue import _BOXES, _CELLS, _EDGES, _MEMBERS, _SHAPES, _TISSUES, R, _r, query
from planarix.sources import tiles, vector


@query(f"""with {_CELLS}, {_EDGES}, {_MEMBERS}, c as (select focal, count(*) filter (where class_name = 'inflammatory')::double as i, count(*) filter (where class_name = 'connective')::double as s, count(*) as n from m join cells on uid = member group by focal)
select focal as uid, round(case when i + s = 0 then 0 else i/(i+s) end, 6) as accessibility, n as packing from c join cells on uid = focal where class_name = 'neoplastic'""")
def tumor_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immune share around tumour cells, and how densely they are packed."""
    df = X.cell_points(spark, sf_dir)
    out = nhood.local_type_counts(df, graph.fit_distband(df, R), ["inflammatory", "connective"])
    m = nhood.members(df, graph.fit_distband(df, R)).groupBy(F.col("focal").alias("uid")).agg(F.count("*").alias("packing"))
    share = F.coalesce(F.try_divide(F.col("inflammatory_cnt").cast("double"), F.col("inflammatory_cnt") + F.col("connective_cnt")), F.lit(0.0))
    return out.where("class_name = 'neoplastic'").join(m, "uid").select("uid", F.round(share, 6).alias("accessibility"), "packing")


@query(f"""with {_CELLS}, {_TISSUES}, {_EDGES}, i as (select * from cells where class_name = 'inflammatory'),
d as (select uid, min(sqrt(power(greatest(0, minx - x, x - maxx), 2) + power(greatest(0, miny - y, y - maxy), 2))) as d from i, tissues t where t.class_name = 'cin' group by uid),
n as (select i.uid, count(j.uid) as k from i left join e on focal = i.uid left join i j on j.uid = neighbor group by i.uid)
select k as density, count(*) as n, round(avg(d), 4) as mean_distance from d join n using (uid) group by k""")
def til_density_and_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of lymphocytes to the lesion by the number of lymphocytes around them."""
    df = X.cell_points(spark, sf_dir).where("class_name = 'inflammatory'")
    dist = cluster.dists_to_tissue(df, X.tissues(spark, sf_dir), "cin")
    deg = graph.degree(df, graph.fit_distband(df, R)).withColumnRenamed("degree", "density")
    return dist.join(deg, "uid").groupBy("density").agg(F.count("*").alias("n"), F.round(F.avg("dist_to_cin"), 4).alias("mean_distance"))


@query(f"""with {_BOXES}, {_TISSUES}, {_EDGES}, i as (select distinct b.uid, b.class_name from boxes b join tissues t on t.class_name = 'cin' and t.minx <= b.minx and t.miny <= b.miny and t.maxx >= b.maxx and t.maxy >= b.maxy)
select least(a.class_name, b.class_name) || '-' || greatest(a.class_name, b.class_name) as link, count(*) as n from e join i a on a.uid = focal join i b on b.uid = neighbor where focal < neighbor group by 1""")
def lesion_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class pairs linked inside the lesion: the graph's sub-graph of contained objects."""
    cells = X.cells(spark, sf_dir)
    inside = objects.get_objs(X.tissues(spark, sf_dir).where("class_name = 'cin'"), cells, "contains", unique=False)
    pts = X.cell_points(spark, sf_dir)
    w = graph.w_subset(graph.fit_distband(pts, R), inside.select(F.col("uid").alias("id")))
    return graph.weights2gdf(pts, w).groupBy(F.col("class_name").alias("link")).agg(F.count("*").alias("n"))


@query(f"""with {_SHAPES}, u as (select uid, 'area' as metric, a as value from s union all select uid, 'perimeter', p from s union all select uid, 'compactness', 4*pi()*a/(p*p) from s)
select class_name, metric, count(*) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from u join cells using (uid) group by class_name, metric""")
def morphology_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape metrics unpivoted to one row a metric and summarised by class."""
    s = shape.shape_metric(X.shapes(spark, sf_dir), ("area", "perimeter", "compactness"))
    tidy = s.unpivot(["uid", "class_name"], ["area", "perimeter", "compactness"], "metric", "value")
    return tidy.groupBy("class_name", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


@query(f"""with {_CELLS} select round(corr(w, h), 6) as r, round(corr(x, y), 6) as rxy from cells""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cell_points(spark, sf_dir).agg(F.round(F.corr("w", "h"), 6).alias("r"), F.round(F.corr("x", "y"), 6).alias("rxy"))


@query()
def lymphoid_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters, their centres, spread and hulls, typed by rules, with the nearest tissue."""
    df = X.clusters(spark, sf_dir)
    found = df.join(cluster.density_clustering(df, 20.0, 8), "uid").where("labels >= 0")
    feats = cluster.cluster_feats(found, "labels", "convex_hull")
    centre = cluster.cluster_tendency(found, "mean", by=["labels"]).withColumnRenamed("labels", "uid")
    t = X.tissues(spark, sf_dir)
    for name in ("stroma", "cin", "blood"):
        centre = cluster.dists_to_tissue(centre, t, name)
    near = F.least("dist_to_stroma", "dist_to_cin", "dist_to_blood")
    kind = F.when(F.col("size") >= 12, "follicle").when(F.col("dispersion") < 8, "dense").otherwise("loose")
    tissue = F.when(F.col("dist_to_stroma") == near, "stroma").when(F.col("dist_to_cin") == near, "cin").otherwise("blood")
    return feats.join(centre, feats["labels"] == centre["uid"]).select("labels", "size", *_r("area", "dispersion", "orientation", "x", "y"), kind.alias("kind"), tissue.alias("nearest"), F.round(near, 4).alias("distance"))


def _slide(spark: SparkSession, side: int = 10_240, tile: int = 512) -> DataFrame:
    """Tiles of a synthetic slide that spans all objects and tissues."""
    tiles.register(spark)
    return spark.read.format("tiles").option("width", side).option("height", side).option("tile", tile).load()


def _stroma(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The slide's tiles that stroma annotations meet, and the tissue masks of those tiles."""
    t = X.tissues(spark, sf_dir).select(F.col("tissue_id").alias("uid"), "class_name", "geometry")
    images = rasterise.tiles_in_annotations(_slide(spark), t.where("class_name = 'stroma'"))
    return images, rasterise.gdf2sem(t, images.select("tile_id", "x", "y", "w", "h"), {"stroma": 1, "cin": 2, "blood": 3, "squamous_epithelium": 4, "glandular_epithelium": 5})


@query()
def nuclear_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity, texture and chromatin of all objects, rasterised tile by tile."""
    images = _slide(spark)
    masks = rasterise.gdf2inst(X.cells(spark, sf_dir), images.select("tile_id", "x", "y", "w", "h"))

    def feats(img: np.ndarray, label: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
        a, b, c = pixel.grayscale_feats(img, label, ("mean", "std", "median")), pixel.textural_feats(img, label, ("contrast",)), pixel.chromatin_feats(img, label, ("chrom_nuc_prop", "n_chrom_clumps"))
        if not len(a):
            return pd.DataFrame(columns=["label", "mean", "std", "median", "contrast", "chrom_nuc_prop", "n_chrom_clumps"])
        return a.merge(b, on="label").merge(c, on="label").rename(columns={"contrast_d-1_a-0.00": "contrast"})

    out = rasterise.tile_features(images, masks, feats, "label long, mean double, std double, median double, contrast double, chrom_nuc_prop double, n_chrom_clumps double")
    return out.select("tile_id", "label", *_r("mean", "std", "median", "contrast", "chrom_nuc_prop"), "n_chrom_clumps")


@query()
def stroma_tile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of stroma tiles outside nuclei, min-max scaled and clustered by k-means with the best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    images, tissue = _stroma(spark, sf_dir)
    masks = rasterise.gdf2inst(X.cells(spark, sf_dir), images.select("tile_id", "x", "y", "w", "h"))

    def feats(img: np.ndarray, label: np.ndarray, mask: np.ndarray) -> pd.Series:
        s = pixel.stromal_intensity_feats(img, label, ("mean",), mask=mask == 1)
        return pd.Series({"h_area": s["hematoxylin_area"], "e_area": s["eosin_area"], "e_red": s["eosin_R_mean"], "nuclei": float(((label > 0) & (mask == 1)).sum()), "stroma": float((mask == 1).mean())})

    rows = storage.materialise(rasterise.tile_features(images, masks, feats, "h_area double, e_area double, e_red double, nuclei double, stroma double", tissue), "tile-features")
    data = VectorAssembler(inputCols=["h_area", "e_area", "e_red", "nuclei", "stroma"], outputCol="raw").transform(rows)
    data = storage.materialise(MinMaxScaler(inputCol="raw", outputCol="features").fit(data).transform(data).select("tile_id", "features"), "scaled")
    best = None
    for k in range(3, 12):
        made = KMeans(k=k, seed=42).fit(data).transform(data)
        score = ClusteringEvaluator().evaluate(made) if made.select("prediction").distinct().count() > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, made)
    return best[1].select("tile_id", F.col("prediction").alias("cluster"))


@query()
def fibre_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of fibre angles in each stroma tile, and its quartile."""
    images, tissue = _stroma(spark, sf_dir)

    def feats(img: np.ndarray, label: np.ndarray, mask: np.ndarray) -> pd.DataFrame:
        return pixel.fiber_feats(img, ("major_axis_angle", "length"), sigma=1.0, min_size=8, mask=mask == 1).reindex(columns=["label", "major_axis_angle", "length"])

    masks = images.select("tile_id", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("dtype"))
    rows = rasterise.tile_features(images, masks, feats, "label long, major_axis_angle double, length double", tissue)
    bins = rows.groupBy("tile_id", F.floor(F.col("major_axis_angle") / 10).alias("b")).agg(F.count("*").cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("tile_id"))
    ent = bins.withColumn("p", p).groupBy("tile_id").agg(F.round(F.abs(F.sum(-F.col("p") * F.log("p"))), 6).alias("entropy"), F.sum("n").cast("long").alias("fibres"))
    ent = storage.materialise(ent, "entropy")
    bounds = binning.classify(ent, "entropy", "quantiles", 4)
    return ent.withColumn("quartile", binning.bin_index(F.col("entropy"), bounds or [0.0]))


@query()
def raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects burnt into tiles, traced again and stitched across tile borders."""
    t = _slide(spark, tile=500).select("tile_id", "x", "y", "w", "h")
    inst = rasterise.gdf2inst(X.cells(spark, sf_dir), t)
    back = rasterise.inst2gdf(inst, min_size=0)
    named = back.join(t.withColumnsRenamed({"x": "tx", "y": "ty", "w": "tw", "h": "th"}), "tile_id").withColumn("uid", F.xxhash64("tile_id", "uid", "geometry"))
    return overlay.merge_instances(storage.materialise(named, "traced"), edge_tolerance=1.0).select("class_name", "n_parts", F.round(G.area(F.col("geometry")), 2).alias("area"))


@query()
def tissue_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons where the surroundings of one tissue reach into others."""
    t = X.tissues(spark, sf_dir).withColumnRenamed("tissue_id", "uid")
    got = overlay.get_interfaces(t.where("class_name = 'stroma'"), t.where("class_name = 'cin'"), 400.0)
    return got.select(F.round(G.area(F.col("geometry")), 1).alias("area"), "n")


@query(f"with {_TISSUES}, a as (select * from tissues where class_name = 'cin'), b as (select minx + 500 as minx, miny + 300 as miny, maxx + 500 as maxx, maxy + 300 as maxy from tissues where class_name = 'cin') select round(sum((least(a.maxx,b.maxx)-greatest(a.minx,b.minx))*(least(a.maxy,b.maxy)-greatest(a.miny,b.miny))), 4) as area, count(*) as n from a join b on a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy")
def tissue_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon intersection of tissues with the same tissues moved."""
    t = X.tissues(spark, sf_dir).withColumnRenamed("tissue_id", "uid").where("class_name = 'cin'").select("uid", "geometry")
    moved = t.withColumn("geometry", G.translate(F.col("geometry"), 500.0, 300.0))
    return overlay.overlay(t, moved).agg(F.round(F.sum(G.area(F.col("geometry"))), 4).alias("area"), F.count("*").alias("n"))


@query()
def medial_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medial lines of tissues and the perpendiculars along them."""
    t = X.tissues(spark, sf_dir).withColumnRenamed("tissue_id", "uid").select("uid", "class_name", "geometry")
    lines = overlay.medial_lines(t, num_points=120)
    perp = overlay.sliding_perpendicular_lines(lines, t, 200.0, trim=None)
    a = lines.groupBy("uid").agg(F.count("*").alias("lines"), F.round(F.sum(G.length(F.col("geometry"))), 2).alias("length"))
    b = perp.groupBy("uid").agg(F.count("*").alias("perpendiculars"), F.round(F.avg("length"), 2).alias("mean_width"))
    return a.join(b, "uid", "left")


@query(f"""with {_SHAPES} select class_name, count(*) as n, round(sum(a), 4) as area, round(sum(p), 4) as length from s join cells using (uid) group by class_name""")
def wkb_and_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry through WKB and GeoJSON files and back, summarised."""
    c = X.shapes(spark, sf_dir).select("uid", "class_name", "geometry")
    path = f"{storage.shared_dir(spark)}/geojson-{uuid.uuid4().hex}"
    vector.write_vector(vector.decode_wkb(vector.encode_wkb(c)).drop("part"), path, "geojson")
    back = vector.read_geojson(spark, path, "uid long, class_name string")
    return back.groupBy("class_name").agg(F.count("*").alias("n"), F.round(F.sum(G.area(F.col("geometry"))), 4).alias("area"), F.round(F.sum(G.length(F.col("geometry"))), 4).alias("length"))


@query("select date_trunc('hour', ts) as start, cast(floor(value/10) as bigint) as cx, cast(floor(event_id % 97 / 10) as bigint) as cy, count(*) as n from events group by all")
def event_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate, on a table."""
    from planarix.streaming.grid_counts import grid_counts

    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return grid_counts(ev, 10.0)


@query(f"with {_CELLS}, g as (select cast(floor(x/1000) as bigint) as gx, class_name, count(*) as n from cells group by all) select gx, class_name, n from (select *, row_number() over (partition by gx order by n desc, class_name) as k from g) where k <= 2")
def top_classes_by_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest classes in each strip."""
    g = X.cell_points(spark, sf_dir).groupBy(F.floor(F.col("x") / 1000).alias("gx"), "class_name").agg(F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("gx").orderBy(F.desc("n"), "class_name"))).where("k <= 2").select("gx", "class_name", "n")


@query()
def connected_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tissues of a class merged where their gaps are small."""
    t = X.tissues(spark, sf_dir).withColumnRenamed("tissue_id", "uid").select("uid", "class_name", "geometry")
    got = overlay.merge_tissues(t, gap=201.0)
    return got.select("class_name", "n", F.round(G.area(F.col("geometry")), 0).alias("area"))


@query()
def smoothed_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.shapes(spark, sf_dir)
    out = None
    for how in ("uniform", "gaussian", "median"):
        one = shape.smooth(s, how, 2 if how != "gaussian" else None).select(F.lit(how).alias("how"), "uid", F.round(G.area(F.col("geometry")), 4).alias("area"))
        out = one if out is None else out.unionAll(one)
    return out


@query()
def quad_cell_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class fractions of objects by quad cell."""
    c = X.cells(spark, sf_dir)
    g = grid.quadbin_grid(X.tissues(spark, sf_dir).where("class_name = 'cin'"), 15)
    out = grid.grid_aggregate(g, c, {"n": F.count("*"), "frac": grid.class_fraction("inflammatory")}, "contains", empty={"n": 0, "frac": 0.0})
    return out.select("cell_id", "n", *_r("frac"))
