import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarix.functions import binning, diversity
from planarix.functions import geometry as G
from planarix.kernels import density
from planarix.operators import cluster, components, graph, grid, nhood, objects, overlay, shape, stats
from planarix.operators import spatial_join as J
from planarix.plans import fixtures as X


@pytest.fixture(scope="module")
def points(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, float(x), float(y), "ab"[i % 2] if i % 5 else "c-d", float(i % 7)) for i, (x, y) in enumerate(rnd.uniform(0, 100, (200, 2)))]
    return spark.createDataFrame([*rows, (900, 5000.0, 5000.0, "a", 1.0)], "uid long, x double, y double, class_name string, v double")


def local(df):
    return np.array([(r["uid"], r["x"], r["y"]) for r in df.orderBy("uid").collect()])


def test_diversity_values(spark):
    row = spark.range(1).select(
        diversity.gini_index(F.array(*[F.lit(v) for v in (1, 2, 3)])).alias("g"), diversity.simpson_index(F.array(F.lit(1), F.lit(1))).alias("s"), diversity.shannon_index(F.array(F.lit(5), F.lit(0))).alias("h"),
        diversity.theil_index(F.array(F.lit(2.0), F.lit(2.0))).alias("t"), diversity.theil_between_group(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit("a"), F.lit("b"))).alias("b"),
    ).first()
    assert row.g == pytest.approx(2 / 9) and row.s == 0.5 and row.h == 0.0 and abs(row.t) < 1e-12
    assert row.b == pytest.approx(0.25 * math.log(0.5) + 0.75 * math.log(1.5))
    with pytest.raises(Exception, match="non-negative"):
        spark.range(1).select(diversity.gini_index(F.array(F.lit(-1), F.lit(2)))).collect()


def test_binning(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 2, 10, 11, 30, 31, 32]], "v double")
    assert binning.classify(df, "v", "fisherjenks", 3) == [2.0, 11.0, 32.0]
    for scheme in binning.SCHEMES:
        b = binning.classify(df, "v", scheme, 3, bounds=[5.0, 20.0])
        assert b == sorted(b) and b[-1] >= 32.0 - 1e-9, scheme
    got = df.select(binning.bin_index(F.col("v"), [2.0, 11.0, 32.0]).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 0, 0, 1, 1, 2, 2, 2]
    with pytest.raises(ValueError):
        binning.classify(df, "v", "nope")


def test_distance_and_nearest_joins(spark, points):
    p = local(points)
    d = np.hypot(p[:, None, 1] - p[None, :, 1], p[:, None, 2] - p[None, :, 2])
    w = graph.fit_distband(points, 12.0)
    assert {(r.focal, r.neighbor) for r in w.collect()} == {(int(p[i, 0]), int(p[j, 0])) for i, j in zip(*np.nonzero(d <= 12), strict=True) if i != j}
    knn = {}
    for r in graph.fit_knn(points, 4).collect():
        knn.setdefault(r.focal, set()).add(r.neighbor)
    for i in range(len(p)):
        order = [int(p[j, 0]) for j in np.lexsort((p[:, 0], d[i])) if j != i][:4]
        assert knn[int(p[i, 0])] == set(order)


@pytest.mark.parametrize("method", graph.METHODS)
def test_fit_graph(points, method):
    w, links = graph.fit_graph(points, method, threshold=20.0)
    rows = links.collect()
    assert rows and all(r.dist <= 20 and r.focal < r.neighbor for r in rows)
    assert {r.class_name for r in rows} <= {"a-a", "a-b", "b-b", "a-c-d", "b-c-d", "c-d-c-d"}
    both = {(r.focal, r.neighbor) for r in w.collect()}
    assert method == "knn" or both == {(b, a) for a, b in both}


def test_graph_arguments(points):
    with pytest.raises(ValueError, match="Type must be one of"):
        graph.fit_graph(points, "nope")
    with pytest.raises(ValueError, match="string column"):
        graph.weights2gdf(points, graph.fit_distband(points, 9.0), class_col="v")


def test_neighbourhoods_keep_islands(points):
    w = graph.fit_distband(points, 12.0)
    out = nhood.local_character(points, w, "v", ("sum", "mean"), normalize=True)
    assert out.count() == 201 and set(out.columns) >= {"v_nhood_sum", "v_nhood_mean"}
    lim = out.agg(F.min("v_nhood_sum"), F.max("v_nhood_sum"), F.max("v_nhood_mean")).first()
    assert 0 <= lim[0] and lim[1] <= 1 and lim[2] <= 1
    alone = nhood.nhood(points, w).where("uid = 900").first()
    assert alone.nhood == [900] and alone.n_neighbors == 0
    div = nhood.local_diversity(points, w, ["class_name", "v"], ("simpson_index", "shannon_index"), k=3)
    assert div.where("uid = 900").first().class_name_simpson_index == 0
    assert div.where("class_name_shannon_index > ln(3) * 1.0001 or v_simpson_index > 1").count() == 0
    for bad in (lambda: nhood.local_diversity(points, w, "v", ("x",)), lambda: nhood.local_distances(points, w, ("var",)), lambda: nhood.local_character(points, w, "v", ("x",))):
        with pytest.raises(ValueError):
            bad()


def test_components_and_subgraph(spark, points):
    w = graph.fit_distband(points, 12.0)
    found = graph.get_connected_components(w, points.select(F.col("uid").alias("id")))
    assert found.count() == 201 and found.where("node = 900").first().component == 900
    sub = graph.w_subset(w, points.where("uid < 50").select(F.col("uid").alias("id")))
    assert sub.where("focal >= 50 or neighbor >= 50").count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in components.components(chain).collect()} == {0}


def test_predicate_joins_agree_with_all_pairs(spark):
    rnd = np.random.default_rng(4)
    box = lambda i, x, y, s: (i, float(x), float(y), float(x + s), float(y + s))
    a = [box(i, *rnd.integers(0, 60, 2), int(rnd.integers(5, 30))) for i in range(30)]
    b = [box(i, *rnd.integers(0, 60, 2), int(rnd.integers(1, 12))) for i in range(60)]
    make = lambda rows, n: spark.createDataFrame(rows, f"{n} long, minx double, miny double, maxx double, maxy double").withColumn("geometry", G.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))).drop("minx", "miny", "maxx", "maxy")
    tri = lambda df: df.withColumn("geometry", F.struct(F.lit("polygon").alias("kind"), F.transform("geometry.rings", lambda r: F.concat(F.slice(r, 1, 3), F.slice(r, 1, 1))).alias("rings")))
    from planarix.kernels import planar

    ring = lambda r: np.array([[r[1], r[2]], [r[3], r[2]], [r[3], r[4]], [r[1], r[4]], [r[1], r[2]]])
    for pred in planar.PREDICATES:
        for cut in (False, True):
            left, right = make(a, "p"), make(b, "q")
            rs = [ring(r) for r in b]
            if cut:
                right, rs = tri(right), [np.vstack([r[:3], r[:1]]) for r in rs]
            got = {(r.p, r.q) for r in J.predicate_pairs(left, right, pred, left_id="p", right_id="q", distance=2.5).collect()}
            want = {(x[0], y[0]) for x in a for y, r in zip(b, rs, strict=True) if planar.satisfies(pred, "polygon", [ring(x)], "polygon", [r], 2.5)}
            assert got == want, (pred, cut)
    with pytest.raises(ValueError):
        J.predicate_pairs(make(a, "p"), make(b, "q"), "near", left_id="p", right_id="q")


def test_get_objs_drops_equal_geometries(spark):
    one = G.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    objs = spark.range(4).select(F.col("id").alias("uid"), one.alias("geometry"))
    area = spark.range(2).select(G.box(F.lit(-5), F.lit(-5), F.lit(5), F.lit(5)).alias("geometry"))
    assert [r.uid for r in objects.get_objs(area, objs, "contains").collect()] == [0]


def test_grids(spark):
    objs = spark.createDataFrame([(0, 3.0, 3.0), (1, 700.0, 900.0)], "uid long, x double, y double").withColumn("geometry", G.box(F.col("x"), F.col("y"), F.col("x") + 5, F.col("y") + 5))
    g = grid.rect_grid(objs, (256, 128))
    assert {(r.maxx - r.minx, r.maxy - r.miny) for r in g.collect()} == {(128.0, 256.0)} and g.count() >= 2
    assert grid.rect_grid(objs, (256, 128), overlap=50).count() >= g.count()
    full = grid.grid_aggregate(grid.rect_grid(objs, (256, 256), full=True), objs, {"n": F.count("*")}, "contains", empty={"n": 0})
    assert full.agg(F.sum("n")).first()[0] <= 2 and full.where("n = 0").count() > 0
    for bad in (lambda: grid.rect_grid(objs, (0, 1)), lambda: grid.rect_grid(objs, overlap=100), lambda: grid.rect_grid(objs, predicate="x"), lambda: grid.grid_aggregate(g, objs, {}, "touches")):
        with pytest.raises(ValueError):
            bad()
    assert grid.rect_grid(objs.limit(0)).count() == 0
    h = grid.hex_grid(objs.withColumn("geometry", G.box(F.col("x"), F.col("y"), F.col("x") + 100, F.col("y") + 100)), 10.0)
    assert abs(h.count() / (2 * 100 * 100 / (1.5 * math.sqrt(3) * 100)) - 1) < 0.15
    q = grid.quadbin_grid(objs.withColumn("geometry", G.box(F.col("x") * 100, F.col("y") * 100, F.col("x") * 100 + 900, F.col("y") * 100 + 900)), 16)
    finer = grid.quadbin_grid(objs.withColumn("geometry", G.box(F.col("x") * 100, F.col("y") * 100, F.col("x") * 100 + 900, F.col("y") * 100 + 900)), 17)
    assert 0 < q.count() <= finer.count() and q.where("cell_id > 0").count() == q.count()
    with pytest.raises(NotImplementedError):
        grid.h3_grid(objs)


def test_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0), (5, None)], "uid long, v double")
    got = {r.uid: r.q for r in objects.col_norm(df, "v", out="q").collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: None}
    assert [r.q for r in objects.col_norm(df.limit(1), "v", out="q").collect()] == [None]
    assert {r.q for r in objects.col_norm(df, "v", "minmax", out="q").collect()} == {0.0, 0.25, 1.0, None}
    assert sorted(r.uid for r in objects.set_uid(df.drop("uid"), ["v"], 5).collect()) == [5, 6, 7, 8, 9]


def test_dbscan_equals_kernel(points):
    for eps, n in ((8.0, 4), (12.0, 6), (3.0, 3)):
        want = density.dbscan(local(points)[:, 1:], eps, n)
        got = {r.uid: r.labels for r in cluster.density_clustering(points, eps, n).collect()}
        assert [got[int(u)] for u in local(points)[:, 0]] == want.tolist()
    with pytest.raises(ValueError, match="Illegal clustering method"):
        cluster.density_clustering(points, method="kmeans")


@pytest.mark.parametrize("method", ["optics", "hdbscan", "adbscan"])
def test_density_kernels_find_blobs(spark, method):
    rnd = np.random.default_rng(9)
    xy = np.vstack([rnd.normal((cx, 0), 1, (60, 2)) for cx in (0, 60, 120)] + [rnd.uniform(-200, 300, (12, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "uid long, x double, y double")
    got = [r.labels for r in cluster.density_clustering(df, 6.0, 6, method).orderBy("uid").collect()]
    main = [max(set(got[i : i + 60]), key=got[i : i + 60].count) for i in (0, 60, 120)]
    assert len(set(main)) == 3 and -1 not in main and got[180:].count(-1) >= 8


def test_cluster_features(points):
    out = cluster.cluster_feats(points.withColumn("labels", F.col("uid") % 3), hull_type="convex_hull").collect()
    assert len(out) == 3 and all(r.area > 0 and r["size"] > 60 and 0 <= r.orientation <= 90 for r in out)
    for bad in (lambda: cluster.cluster_feats(points, "v", "bbox"), lambda: cluster.cluster_tendency(points, "mode"), lambda: cluster.cluster_tendency(points, "weighted_mean")):
        with pytest.raises(ValueError):
            bad()
    assert {r.v for r in cluster.hulls(points.where("uid < 100"), "v", "ellipse").collect()} == set(map(float, range(7)))


def test_nearest_tissue_both_ways(spark, points):
    t = spark.createDataFrame([(0, 20.0, 20.0, "t"), (1, 80.0, 70.0, "t"), (2, 0.0, 0.0, "u")], "id long, x double, y double, class_name string").withColumn("geometry", G.box(F.col("x"), F.col("y"), F.col("x") + 9, F.col("y") + 9))
    near = cluster.dists_to_tissue(points, t, "t").select("uid", "dist_to_t")
    rings = cluster._nearest_by_rings(points, t.where("class_name = 't'").select(F.col("geometry").alias("g")), objects.centroids(points), "d", "uid")
    assert near.join(rings, "uid").where("abs(dist_to_t - d) > 1e-9 or d is null").count() == 0
    assert cluster.dists_to_tissue(points, t, "none").where("dist_to_none is null").count() == 201


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 17, 100, 1000):
        got = spark.range(n).select(stats._permuted(F.col("id"), n, F.lit(7), F.lit(1)).alias("p"), stats._permuted(F.col("id"), n, F.lit(7), F.lit(2)).alias("q")).collect()
        assert sorted(r.p for r in got) == sorted(r.q for r in got) == list(range(n))
    assert [r.p for r in got] != [r.q for r in got]
    assert abs(np.corrcoef([r.p for r in got], range(1000))[0, 1]) < 0.12


def test_statistics(points):
    w = graph.fit_distband(points, 15.0)
    m = points.where("uid < 900").withColumn("f", F.col("x"))
    row = stats.global_autocorr(m, w, "f", permutations=49).first()
    assert row.I > 0.5 and row.p_sim == pytest.approx(0.02)
    again = stats.global_autocorr(m, w, "f", permutations=49).first()
    assert again.I == pytest.approx(row.I) and again.p_sim == row.p_sim
    lisa = stats.lisa_clustering(m, w, "f", permutations=49)
    assert {r.lisa for r in lisa.select("lisa").distinct().collect()} <= {"ns", "HH", "LH", "LL", "HL", None} and lisa.count() == 200
    p = points.where("uid < 900").withColumnRenamed("uid", "id")
    s = [0.0, 2.0, 5.0, 10.0, 30.0]
    g = [r.stat for r in stats.ripley_g(p, s).orderBy("support").collect()]
    assert g == sorted(g) and g[0] == 0 and g[-1] == 1
    test = stats.ripley_test(p, s, "k", n_sim=10).orderBy("support").collect()
    assert len(test) == 5 and all(0 <= r.p <= 0.5 for r in test)
    hull = G.box(F.lit(0), F.lit(0), F.lit(5), F.lit(5))
    inside = stats.poisson(points.sparkSession, (0, 0, 10, 10), 50, 3, hull=hull)
    assert inside.where("x > 5 or y > 5").count() == 0 and inside.groupBy("rep").count().where("count <> 50").count() == 0


def test_shape_arguments_and_lines(spark):
    sf = "/root/testdata/sf0.001"
    s = X.shapes(spark, sf)
    out = shape.shape_metric(s, list(shape.SHAPE_METRICS), normalize=False, col_prefix="m")
    lim = out.agg(*[F.max(f"m_{c}").alias(c) for c in ("solidity", "convexity", "compactness", "rectangularity", "eccentricity", "shape_index")]).first()
    assert all(0 < v <= 1.0000001 for v in lim)
    for bad in ("area", ["nope"]):
        with pytest.raises(ValueError):
            shape.shape_metric(s, bad)
    t = shape.line_metric(X.trajectories(spark, sf), list(shape.LINE_METRICS))
    assert t.where("tortuosity < 1 or major_axis_len < minor_axis_len - 1e-9").count() == 0
    norm = shape.shape_metric(s, ["area"], normalize=True).agg(F.min("area"), F.max("area")).first()
    assert norm[0] >= 0 and norm[1] <= 1


def test_dissolve_merge_and_overlay(spark):
    rows = [(0, 0.0, 0.0, "a"), (1, 10.0, 0.0, "a"), (2, 30.0, 0.0, "a"), (3, 0.0, 10.0, "b")]
    df = spark.createDataFrame(rows, "uid long, x double, y double, class_name string").withColumn("geometry", G.box(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10))
    got = sorted((r.class_name, r.n, r.a) for r in overlay.dissolve(df, by="class_name").withColumn("a", G.area(F.col("geometry"))).collect())
    assert got == [("a", 1, 100.0), ("a", 2, 200.0), ("b", 1, 100.0)]
    tiled = df.where("uid < 2").withColumns({"tx": F.col("x").cast("int"), "ty": F.lit(0), "tw": F.lit(10), "th": F.lit(10)})
    merged = overlay.merge_instances(tiled, edge_tolerance=1.0).withColumn("a", G.area(F.col("geometry"))).collect()
    assert len(merged) == 1 and merged[0].n_parts == 2 and merged[0].a == pytest.approx(200, rel=0.02)
    rest = overlay.overlay(df.where("uid = 0"), df.where("uid = 0").withColumn("geometry", G.translate(F.col("geometry"), 5.0, 0.0)), "difference")
    assert rest.select(G.area(F.col("geometry"))).first()[0] == pytest.approx(50)
    ring = overlay.get_interfaces(df.where("uid = 0"), df.where("uid = 1"), 4.0).select(F.sum(G.area(F.col("geometry")))).first()[0]
    assert ring == pytest.approx(40, rel=0.02)


def test_get_objs_keeps_equal_geometries_of_different_ids(spark):
    one = G.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    objs = spark.range(4).select(F.col("id").alias("uid"), one.alias("geometry"))
    area = spark.range(2).select(G.box(F.lit(-5), F.lit(-5), F.lit(5), F.lit(5)).alias("geometry"))
    assert sorted(r.uid for r in objects.get_objs(area, objs, "contains", unique=False).collect()) == [0, 1, 2, 3]
    assert sorted(r.uid for r in objects.interface_members(area, area, objs, 1.0, unique=False).collect()) == [0, 1, 2, 3]
