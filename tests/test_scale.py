"""Operators at sizes and in cases where a sample, a cap or a single run isn't enough."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planarix import storage
from planarix.functions import binning
from planarix.functions import geometry as G
from planarix.operators import cluster, objects, overlay, pixel, rasterise, stats
from planarix.operators import spatial_join as J

N = 500_000


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(N).select(F.col("id").alias("uid"), F.xxhash64("id").alias("k"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400_009)) / 7.0).alias("v"))


def test_set_uid_is_dense(many):
    got = objects.set_uid(many, ["k"], 10, "n").select("uid", "k", "n").toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(10, N + 10)) and got["k"].is_monotonic_increasing and got["uid"].nunique() == N


def test_ranks_are_averages(many):
    got = objects.col_norm(many, "v", out="r").select("v", "r").toPandas()
    assert len(got) == N
    np.testing.assert_allclose(got["r"], (got["v"].rank(method="average") - 1) / (N - 1), atol=1e-12)


def test_set_uid_of_few_rows(spark):
    assert objects.set_uid(spark.range(0), ["id"]).count() == 0
    tied = objects.set_uid(spark.createDataFrame([(1,), (1,), (None,)], "a int"), ["a"], id_col="n").orderBy("n").collect()
    assert [(r["a"], r["n"]) for r in tied] == [(None, 0), (1, 1), (1, 2)]


def test_dbscan_labels_are_dense(spark):
    rnd = np.random.default_rng(2)
    centres = np.stack(np.meshgrid(np.arange(40), np.arange(40)), -1).reshape(-1, 2) * 100.0
    xy = (centres[:, None] + rnd.uniform(-3, 3, (1600, 8, 2))).reshape(-1, 2)
    df = spark.createDataFrame(pd.DataFrame({"uid": rnd.permutation(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "c": np.repeat(np.arange(1600), 8)}))
    got = df.join(cluster.dbscan(df, 10.0, 4), "uid").toPandas()
    assert set(got["labels"]) == set(range(1600)) and (got.groupby("c")["labels"].nunique() == 1).all()
    first = got.groupby("labels")["uid"].min()
    assert first.is_monotonic_increasing  # numbered by the smallest core


def test_optimal_bins_beyond_a_thousand_values(spark):
    rnd = np.random.default_rng(5)
    v = np.concatenate([rnd.normal(0, 1, 4000), rnd.normal(50, 2, 900), np.full(5000, 7.0)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    values, counts = np.unique(v, return_counts=True)
    got = binning.classify(df, "v", "fisherjenks", 3)
    assert got == binning.fisher_jenks(values, counts.astype(float), 3)

    def loss(bounds):
        at = np.searchsorted(bounds, v)
        return sum(((v[at == k] - v[at == k].mean()) ** 2).sum() for k in np.unique(at))

    for _ in range(200):
        other = np.sort(rnd.choice(values[:-1], 2, replace=False))
        assert loss([*other, v.max()]) >= loss(got) - 1e-6
    assert len(binning.classify(df, "v", "fisherjenkssampled", 3)) <= 3
    with pytest.raises(ValueError, match="sampled"):
        binning.classify(df, "v", "fisherjenks", 3, most=100)


def test_maximum_breaks_are_exact(spark):
    df = spark.range(100_000).select((F.col("id") / 2.0).alias("v")).unionAll(spark.createDataFrame([(1e6,), (1e7,)], "v double"))
    assert binning.classify(df, "v", "maximumbreaks", 3) == [(49_999.5 + 1e6) / 2, (1e6 + 1e7) / 2, 1e7]


@pytest.mark.parametrize("forced", [False, True])
def test_jenks_caspall(forced):
    """Values lie nearest to their own class's median; forcing only lowers the absolute deviation."""
    rnd = np.random.default_rng(9)
    for _ in range(60):
        v = np.unique(rnd.integers(0, 90, rnd.integers(1, 30))).astype(float)
        c = rnd.integers(1, 9, len(v)).astype(float)
        full, k = np.repeat(v, c.astype(int)), int(rnd.integers(1, 6))

        def deviation(bounds, full=full):
            at = np.searchsorted(bounds, full)
            return sum(np.abs(full[at == n] - np.median(full[at == n])).sum() for n in np.unique(at))

        plain, got = binning.jenks_caspall(v, c, k), binning.jenks_caspall(v, c, k, forced)
        assert got[-1] == v[-1] and got == sorted(set(got)) and deviation(got) <= deviation(plain) + 1e-9
        at = np.searchsorted(plain, full)
        middle = np.array([np.median(full[at == n]) for n in range(len(plain))])
        assert (np.abs(full - middle[at]) <= np.abs(full[:, None] - middle).min(1) + 1e-9).all()


def test_permutations_of_neighbours_leave_out_the_node(spark):
    """With two nodes a neighbour can only be the other one, so every replicate equals the observed value."""
    df = spark.createDataFrame([(0, 1.0), (1, 5.0)], "uid long, f double")
    w = spark.createDataFrame([(0, 1), (1, 0)], "focal long, neighbor long")
    got = stats.local_autocorr(df, w, "f", permutations=19).collect()
    assert all(r["p_sim"] == pytest.approx(1 / 20) for r in got)
    star = spark.createDataFrame([(i, float(i * i)) for i in range(6)], "uid long, f double")
    all_others = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if i != j], "focal long, neighbor long")
    assert {r["p_sim"] for r in stats.local_autocorr(star, all_others, "f", permutations=9).collect()} == {0.1}  # all the others, each once


def test_global_permutations(spark):
    rnd = np.random.default_rng(0)
    line = [(i, float(i) + rnd.normal()) for i in range(60)]
    w = spark.createDataFrame([(i, j) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "focal long, neighbor long")
    strong = stats.global_autocorr(spark.createDataFrame(line, "uid long, f double"), w, "f", permutations=99).first()
    none = stats.global_autocorr(spark.createDataFrame([(i, float(rnd.normal())) for i in range(60)], "uid long, f double"), w, "f", permutations=99).first()
    assert strong["I"] > 0.8 and strong["p_sim"] == pytest.approx(0.01) and none["p_sim"] > 0.02


def test_points_in_thin_polygons(spark):
    ring = [(0, 0), (100, 99), (100, 100), (0, 1), (0, 0)]
    hull = G.polygon(F.array(*[G.xy(F.lit(float(x)), F.lit(float(y))) for x, y in ring]))
    got = stats.poisson(spark, (0, 0, 100, 100), 50, 7, hull=hull).toPandas()
    assert (got.groupby("rep").size() == 50).all() and got["rep"].nunique() == 7 and (np.abs(got["y"] - got["x"]) <= 1.01).all()
    with pytest.raises(ValueError, match="area"):
        stats.poisson(spark, (0, 0, 1, 1), 5, 2, hull=G.polygon(F.array(*[G.xy(F.lit(9.0), F.lit(float(y))) for y in (9, 9, 9, 9)])))


@pytest.mark.parametrize("hull", stats.HULLS)
def test_ripley_in_hulls(spark, hull):
    rnd = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rnd.uniform(0, 50, (60, 2)))], "id long, x double, y double")
    got = stats.ripley_test(pts, [0.0, 5.0, 10.0], "k", n_sim=9, hull_type=hull).collect()
    assert len(got) == 3 and all(0 <= r["p"] <= 1 for r in got)


def test_nearest_raises_instead_of_dropping(spark):
    pts = spark.createDataFrame([(i, float(i * 1000), 0.0) for i in range(5)], "id long, x double, y double")
    with pytest.raises(RuntimeError, match="open"):
        J.nearest(pts, pts, 1, r=1e-3, most=3)


def test_merged_pieces_all_stay(spark):
    """Two parts that only come near each other grow into one object; three with a gap the tolerance spans nearly, into pieces that all stay."""
    box = lambda x, y, w, h: G.box(F.lit(float(x)), F.lit(float(y)), F.lit(float(x + w)), F.lit(float(y + h)))
    rows = [(1, 90, 0, 10, 10, 0), (2, 100, 0, 10, 10, 100), (3, 95, 40, 5, 0.5, 0), (4, 100, 40, 5, 0.5, 100)]
    df = None
    for uid, x, y, w, h, tx in rows:
        one = spark.range(1).select(F.lit(uid).cast("long").alias("uid"), F.lit("a").alias("class_name"), box(x, y, w, h).alias("geometry"), F.lit(tx).alias("tx"), F.lit(0).alias("ty"), F.lit(100).alias("tw"), F.lit(100).alias("th"))
        df = one if df is None else df.unionAll(one)
    got = overlay.merge_instances(df, edge_tolerance=2.0).select("uid", "n_parts", G.area(F.col("geometry")).alias("area")).collect()
    assert sum(r["area"] for r in got if r["uid"] == 1) == pytest.approx(200, abs=2) and {r["n_parts"] for r in got} == {2}
    assert sum(r["area"] for r in got if r["uid"] == 3) > 0


def test_more_classes_than_a_mask_holds(spark, monkeypatch):
    monkeypatch.setattr(rasterise, "MOST_CLASSES", 3)
    tiles = spark.createDataFrame([(0, 0, 0, 10, 10)], "tile_id long, x int, y int, w int, h int")
    df = spark.range(5).select(F.col("id").alias("uid"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("class_name"), G.box(F.col("id") * 2.0, F.lit(0.0), F.col("id") * 2.0 + 1, F.lit(5.0)).alias("geometry"))
    with pytest.raises(ValueError, match="classes"):
        rasterise.gdf2sem(df, tiles)
    assert rasterise.gdf2sem(df.where("uid < 3"), tiles).count() == 1


def test_tissue_masks_and_annotations_reach_tiles(spark):
    tiles = spark.createDataFrame([(n, n * 16, 0, 16, 16) for n in range(4)], "tile_id long, x int, y int, w int, h int")
    area = spark.range(1).select(F.lit(1).cast("long").alias("uid"), F.lit("stroma").alias("class_name"), G.box(F.lit(4.0), F.lit(4.0), F.lit(24.0), F.lit(12.0)).alias("geometry"))
    assert sorted(r["tile_id"] for r in rasterise.tiles_in_annotations(tiles, area).collect()) == [0, 1]
    images = spark.createDataFrame([rasterise.tile_row(n, n * 16, 0, np.full((16, 16, 3), 100 + n, np.uint8)) for n in range(4)], rasterise.TILE)
    tissue = rasterise.gdf2sem(area, tiles, {"stroma": 2})
    nuclei = rasterise.gdf2inst(area, tiles)
    feats = lambda img, label, mask: pd.Series({"stroma": float((mask == 2).sum()), "nuclei": float((label > 0).sum()), "level": float(img.mean())})
    got = {r["tile_id"]: (r["stroma"], r["nuclei"], r["level"]) for r in rasterise.tile_features(images, nuclei, feats, tissue_masks=tissue).collect()}
    assert got == {0: (96.0, 96.0, 100.0), 1: (64.0, 64.0, 101.0), 2: (0.0, 0.0, 102.0), 3: (0.0, 0.0, 103.0)}


def test_masks_restrict_features():
    rnd = np.random.default_rng(3)
    img = rnd.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    lab = np.zeros((40, 60), np.int32)
    lab[2:12, 2:14], lab[20:35, 30:50] = 7, 9
    mask = np.zeros((40, 60), np.uint8)
    mask[:, 30:] = 1
    for f in (pixel.grayscale_feats, pixel.textural_feats, pixel.chromatin_feats):
        assert f(img, lab)["label"].tolist() == [7, 9] and f(img, lab, mask=mask)["label"].tolist() == [9]
    assert (pixel.chromatin_clumps(img, lab, mean=0.3, std=0.2) == pixel.chromatin_clumps(img, lab)).mean() > 0.99  # a linear change of scale
    every = pixel.stromal_intensity_feats(img, lab, pixel.INTENSITY_METRICS, mask=mask)
    assert len(every) == 2 * (1 + 3 * (len(pixel.INTENSITY_METRICS) - 1 + 3))
    edges = pixel.fiber_feats(img, ("length", "tortuosity"), sigma=1.0, min_size=6, normalize=True, return_edges=True)
    assert len(edges) and edges["length"].between(0, 1).all() and all(r[0].shape[1] == 2 for r in edges["rings"])


def test_shared_folder_must_be_named_on_clusters(spark):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session)


def test_rings_of_different_lengths_reach_pandas(spark):
    """Polygons with a hole of other length than the shell: burnt, dissolved, cut, buffered and stitched."""
    ring = lambda p: F.array(*[G.xy(F.lit(float(x)), F.lit(float(y))) for x, y in (*p, p[0])])
    holed = lambda x: G.polygon(ring([(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)]), ring([(x + 3, 3), (x + 7, 3), (x + 5, 7)]))
    df = spark.range(1).select(F.lit(1).cast("long").alias("uid"), F.lit("a").alias("class_name"), holed(0).alias("geometry"))
    df = df.unionAll(spark.range(1).select(F.lit(2).cast("long"), F.lit("a"), holed(10)))
    size = lambda d: sum(r[0] for r in d.select(G.area(F.col("geometry"))).collect())
    tiles = spark.createDataFrame([(0, 0, 0, 20, 10)], "tile_id long, x int, y int, w int, h int")
    burnt = rasterise.tile_array(rasterise.gdf2inst(df, tiles).first())
    assert set(np.unique(burnt)) == {0, 1, 2} and (burnt[:, :10] == 1).sum() < 100
    assert size(overlay.dissolve(df)) == pytest.approx(184)
    assert size(overlay.overlay(df, df.where("uid = 2").withColumn("uid", F.lit(9).cast("long")), "difference")) == pytest.approx(92)
    assert size(overlay.buffer(df, 1.0)) > 200
    cut = df.withColumns({"tx": (F.col("uid") - 1).cast("int") * 10, "ty": F.lit(0), "tw": F.lit(10), "th": F.lit(10)})
    assert size(overlay.merge_instances(cut, edge_tolerance=1.0)) == pytest.approx(184, abs=2)
