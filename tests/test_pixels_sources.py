import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planarix.functions import geometry as G
from planarix.kernels import raster
from planarix.operators import pixel, rasterise, segmetrics
from planarix.sources import tiles, vector
from planarix.streaming.grid_counts import grid_counts


@pytest.fixture
def image():
    return tiles.synthetic(0, 0, 128, 128)


def test_raster_kernels():
    m = np.zeros((20, 20), bool)
    m[2:8, 2:8] = m[10:12, 10:18] = True
    m[4, 4] = False
    lab = raster.label(m)
    assert lab.max() == 2 and raster.bounding_box(m) == (2, 12, 2, 18)
    assert raster.fill_holes(m)[4, 4] and raster.euler_number(m) == 1
    assert raster.remove_small(m, 20).sum() == 35 and raster.remove_closed_edges(m).sum() == 16
    assert raster.label(np.eye(5, dtype=bool), 4).max() == 5 and raster.label(np.eye(5, dtype=bool), 8).max() == 1
    polys = raster.trace(m)
    assert sum(sum(abs(0.5 * np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1])) * (1 if n == 0 else -1) for n, r in enumerate(p)) for p in polys) == m.sum()
    assert (raster.burn([(1, p) for p in polys], 20, 20) > 0).sum() == m.sum()
    assert raster.otsu(np.array([0.0] * 50 + [10.0] * 50)) < 10 and len(raster.multi_otsu(np.arange(100.0), 3)) == 2
    assert raster.kmeans_img(np.zeros((4, 4, 3), np.uint8)).sum() == 0
    assert raster.dilate(m).sum() > m.sum() > raster.erode(m).sum()


def test_tissue_mask_and_spots():
    image = np.full((80, 80, 3), 240, np.uint8)
    image[10:30, 10:30] = image[50:70, 45:75] = 60
    t, m = raster.tissue_mask(image)
    assert 60 < t < 240 and abs(m.sum() - 1000) < 150
    assert [s[:2] for s in raster.spots(m)] == sorted(s[:2] for s in raster.spots(m)) and len(raster.spots(m)) == 2


def test_glcm_by_hand():
    g = np.array([[0, 0, 1], [1, 2, 2]])
    c = raster.glcm(g, 1, 0.0, 3)
    assert c.tolist() == [[1, 1, 0], [0, 0, 1], [0, 0, 1]]
    assert raster.glcm_metrics(c)["contrast"] == pytest.approx(0.5)


def test_stains(image):
    h, e, d = raster.hed_decompose(image)
    assert h.shape == image.shape and raster.eosin_mask(np.full((9, 9, 3), 7, np.uint8)).sum() == 0
    bg, dark = raster.tissue_components(image)
    assert bg.shape == dark.shape == image.shape[:2]


def test_tile_features(image):
    lab = np.zeros((128, 128), np.int32)
    lab[10:30, 10:30], lab[60:62, 60:62] = 1, 2
    g = pixel.grayscale_feats(image, lab, pixel.INTENSITY_METRICS)
    assert g["label"].tolist() == [1, 2] and ((g["histenergy"] > 0) & (g["histenergy"] <= 1)).all()
    t = pixel.textural_feats(image, lab, ("contrast", "energy"), (1, 2), (0.0, np.pi / 2))
    assert t.shape == (2, 9) and (t.iloc[1, 1:] == 0).all()
    c = pixel.chromatin_feats(image, lab, pixel.CHROMATIN_METRICS)
    assert ((c["chrom_nuc_prop"] >= 0) & (c["chrom_nuc_prop"] <= 1)).all()
    f = pixel.fiber_feats(image, pixel.FIBER_METRICS, sigma=1.0, min_size=8)
    assert len(f) and (f["length"] >= 8).all()
    s = pixel.stromal_intensity_feats(image, None, ("mean", "quantiles"))
    assert len(s) == 2 * (1 + 3 * 4)
    for bad in (lambda: pixel.grayscale_feats(image, lab[:5]), lambda: pixel.textural_feats(image, lab, ("x",)), lambda: pixel.chromatin_feats(image, lab, ("x",)), lambda: pixel.fiber_feats(image, ("x",))):
        with pytest.raises(ValueError):
            bad()
    assert len(pixel.grayscale_feats(np.zeros((64, 64, 3), np.uint8), np.zeros((64, 64), np.int32))) == 0


def test_pixel_tables(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 7), (1, 1, 0, 9), (0, 5, 5, 100)], "label long, prow long, pcol long, v int")
    r = pixel.intensity_feats(df, "v", ("mean", "mad", "skewness", "kurtosis", "histenergy")).first()
    assert r["mean"] == 7 and r["mad"] == 2 and abs(r["skewness"]) < 1e-12 and r["kurtosis"] is None and r["histenergy"] == pytest.approx(1 / 3)
    assert pixel.cooccurrence(df, dy=1, dx=0).collect()[0].n == 1
    rgb = df.withColumns({"r": F.col("v"), "g": F.col("v"), "b": F.col("v")})
    assert pixel.rgb_intensity_feats(rgb, ("mean",)).columns == ["label", "R_mean", "G_mean", "B_mean"]
    with pytest.raises(ValueError):
        pixel.intensity_feats(df, "v", ("x",))


def test_panoptic_of_equal_masks(spark):
    df = spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "gt int, pred int")
    r = segmetrics.panoptic_quality(df).first()
    assert (r.tp, r.fp, r.fn, r.pq, r.aji, r.ap) == (3, 0, 0, 1.0, 1.0, 1.0)


def test_rasters_and_vectors(spark):
    t = spark.createDataFrame([(0, 0, 0, 40, 40), (1, 40, 0, 40, 40), (2, 80, 0, 40, 40)], "tile_id long, x int, y int, w int, h int")
    objs = spark.createDataFrame([(3, 5.0, 5.0, "a"), (4, 30.0, 10.0, "b")], "uid long, x double, y double, class_name string").withColumn("geometry", G.box(F.col("x"), F.col("y"), F.col("x") + 20, F.col("y") + 10))
    inst = rasterise.gdf2inst(objs, t)
    sums = {r["tile_id"]: (rasterise.tile_array(r) > 0).sum() for r in inst.collect()}
    assert sums == {0: 300, 1: 100, 2: 0}
    back = rasterise.inst2gdf(inst, rasterise.gdf2sem(objs, t), {1: "a", 2: "b"}, min_size=0).withColumn("a", G.area(F.col("geometry"))).collect()
    assert sorted((r.uid, r.class_name, r.a) for r in back) == [(3, "a", 200.0), (4, "b", 100.0), (4, "b", 100.0)]
    assert rasterise.sem2gdf(rasterise.gdf2sem(objs, t), {1: "a", 2: "b"}).count() == 3


def test_tile_source_and_pipeline(spark, tmp_path, image):
    tiles.register(spark)
    df = spark.read.format("tiles").option("width", 300).option("height", 200).option("tile", 100).load()
    assert df.count() == 6
    np.savez(tmp_path / "slide.npz", img=image)
    one = spark.read.format("tiles").option("path", str(tmp_path / "slide.npz")).option("tile", 64).load()
    assert one.count() == 4 and (rasterise.tile_array(one.where("tile_id = 3").first()) == image[64:, 64:]).all()
    masks = one.select("tile_id", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("dtype"))
    got = rasterise.tile_features(one, masks, lambda img, label, mask: pd.Series({"mean": float(img.mean())}), "mean double")
    assert got.count() == 4 and [len(b) for b in rasterise.iterate(one, 3)] == [3, 1]
    for bad in (lambda img: None, lambda img, label, mask: 1):
        with pytest.raises(ValueError):
            rasterise.tile_features(one, masks, bad, "mean double")
    assert rasterise.level_from_max_dimension([(4000, 3000), (1000, 700), (500, 350)], 1000) == 1 and rasterise.level_from_dimensions([(4000, 3000), (1000, 700)], (900, 600)) == 1
    assert len(rasterise.tile_coordinates(250, 100, (100, 100))) == 2 and len(rasterise.tile_coordinates(250, 100, (100, 100), out_of_bounds=True)) == 3


def test_vector_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0)], "uid long, x double").withColumn("geometry", G.box(F.col("x"), F.lit(0), F.col("x") + 2, F.lit(1)))
    total = lambda d: d.select(F.sum(G.area(F.col("geometry")))).first()[0]
    vector.write_vector(df, f"{tmp_path}/a")
    vector.write_vector(df, f"{tmp_path}/b", wkb=True)
    vector.write_vector(df, f"{tmp_path}/c", "geojson")
    vector.write_vector(df, f"{tmp_path}/d", "feather")
    assert total(vector.read_vector(spark, f"{tmp_path}/a")) == total(vector.read_vector(spark, f"{tmp_path}/b")) == 4.0
    assert total(vector.read_geojson(spark, f"{tmp_path}/c", "uid long, x double")) == 4.0
    assert total(vector.read_feather(spark, f"{tmp_path}/d", df.schema)) == 4.0
    with pytest.raises(ValueError):
        vector.write_vector(df, f"{tmp_path}/e", "shp")
    import struct

    ring = np.array([[0, 0], [1, 0], [1, 1], [0, 0]], float)
    multi = struct.pack("<BII", 1, 6, 2) + vector.to_wkb("polygon", [ring]) * 2
    parts = vector.decode_wkb(spark.createDataFrame([(1, multi)], "uid long, geometry binary"))
    assert [r.part for r in parts.collect()] == [0, 1]


def test_streaming_counts(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0, 1.0), ("2024-01-01 00:50:00", 2.0, 1.0), ("2024-01-01 01:10:00", 1.0, 1.0), ("2024-01-01 09:00:00", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ts string, x double, y double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = grid_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 10.0)
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r["start"])[11:16], r["n"]) for r in spark.table("counts").collect())
    assert got == [("00:00", 2), ("01:00", 1)]
    assert grid_counts(df, 10.0).count() == 3
