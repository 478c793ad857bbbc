import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planarix.functions import geometry as G
from planarix.functions import projection as P
from planarix.kernels import density, filters, medial, planar, triangulation

SQUARE = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float)
ELL = np.array([[0, 0], [10, 0], [10, 5], [5, 5], [5, 10], [0, 10], [0, 0]], float)


def moved(ring, dx, dy):
    return ring + [dx, dy]


def test_expressions_match_closed_forms(spark):
    hole = G.polygon(*[F.array(*[G.xy(F.lit(float(x)), F.lit(float(y))) for x, y in r]) for r in (SQUARE, SQUARE * 0.5 + 2.5)])
    row = spark.range(1).select(
        G.area(hole).alias("a"), G.length(hole).alias("p"), G.centroid(hole).alias("c"), G.bounds(hole).alias("b"), F.size(G.holes(hole)).alias("h"), G.is_valid(hole).alias("v"), G.is_box(hole).alias("box"),
        G.contains_point(hole, F.lit(1.0), F.lit(1.0)).alias("in1"), G.contains_point(hole, F.lit(5.0), F.lit(5.0)).alias("in2"), G.point_distance(hole, F.lit(5.0), F.lit(5.0)).alias("d"), G.to_wkt(G.point(F.lit(1), F.lit(2))).alias("w"),
    ).first()
    assert (row.a, row.p, row.h, row.v, row.box, row.in1, row.in2, row.d) == (75.0, 60.0, 1, True, False, True, False, 2.5)
    assert (row.c.x, row.c.y, row.b.maxx) == (5.0, 5.0, 10.0) and row.w == "POINT (1.0 2.0)"
    box = spark.range(1).select(G.is_box(G.box(F.lit(0), F.lit(0), F.lit(2), F.lit(1))).alias("b"), G.area(G.translate(G.box(F.lit(0), F.lit(0), F.lit(2), F.lit(1)), 3, 4)).alias("a")).first()
    assert box.b and box.a == 2.0


def test_projection_round_trip(spark):
    row = spark.range(1).select(P.lonlat_to_xy(F.lit(15.0), F.lit(0.0)).alias("o"), P.lonlat_to_xy(F.lit(16.5), F.lit(50.0)).alias("a"), P.quadbin(F.lit(0), F.lit(0), 0).alias("q")).first()
    assert abs(row.o.x - 500000) < 1e-6 and abs(row.o.y) < 1e-6 and row.q == 5192650370358181887
    back = spark.range(1).select(P.xy_to_lonlat(F.lit(row.a.x), F.lit(row.a.y)).alias("b")).first().b
    assert abs(back.lon - 16.5) < 1e-8 and abs(back.lat - 50) < 1e-8


@pytest.mark.parametrize(
    ("b", "true"),
    [
        (moved(SQUARE * 0.4, 1, 1), {"contains", "contains_properly", "covers", "intersects"}),
        (SQUARE * 0.5, {"contains", "covers", "intersects"}),
        (SQUARE, {"contains", "covers", "within", "covered_by", "intersects"}),
        (moved(SQUARE, 5, 5), {"intersects", "overlaps"}),
        (moved(SQUARE, 10, 0), {"intersects", "touches"}),
        (moved(SQUARE, 10, 10), {"intersects", "touches"}),
        (moved(SQUARE, 20, 0), set()),
        (moved(SQUARE * 2, -5, -5), {"within", "covered_by", "intersects"}),
        (ELL, {"contains", "covers", "intersects"}),
    ],
)
def test_polygon_relations(b, true):
    for p in planar.PREDICATES:
        if p != "dwithin":
            assert planar.satisfies(p, "polygon", [SQUARE], "polygon", [b]) == (p in true), p


def test_other_relations():
    line, point = np.array([[-5, 5], [15, 5]], float), np.array([[5, 5]], float)
    assert planar.satisfies("crosses", "polygon", [SQUARE], "line", [line]) and planar.satisfies("crosses", "line", [line], "polygon", [SQUARE])
    assert planar.satisfies("contains", "polygon", [SQUARE], "point", [point]) and planar.satisfies("within", "point", [point], "polygon", [SQUARE])
    assert planar.satisfies("touches", "polygon", [SQUARE], "point", [np.array([[0, 5.0]])])
    assert planar.satisfies("intersects", "line", [line], "point", [point]) and not planar.satisfies("intersects", "line", [line], "point", [point + 1])
    assert planar.satisfies("crosses", "line", [line], "line", [line[:, ::-1]])
    assert planar.satisfies("dwithin", "polygon", [SQUARE], "polygon", [moved(SQUARE, 13, 0)], 3.0) and not planar.satisfies("dwithin", "polygon", [SQUARE], "polygon", [moved(SQUARE, 13, 0)], 2.9)
    hole = [SQUARE, (SQUARE * 0.6 + 2)[::-1]]
    assert not planar.satisfies("intersects", "polygon", hole, "polygon", [SQUARE * 0.2 + 4]) and planar.satisfies("overlaps", "polygon", hole, "polygon", [SQUARE * 0.7 + 1.5])


@pytest.mark.parametrize("seed", range(12))
def test_overlay_areas_add_up(seed):
    rnd = np.random.default_rng(seed)

    def star():
        t = np.sort(rnd.uniform(0, 2 * math.pi, 9))
        r = rnd.uniform(3, 10, 9)
        ring = np.column_stack([r * np.cos(t), r * np.sin(t)]) + rnd.uniform(-4, 4, 2)
        return np.vstack([ring, ring[:1]])

    a, b = [star()], [star()]
    if not planar.simple(a[0]) or not planar.simple(b[0]):
        pytest.skip("not simple")
    total = lambda ps: sum(planar.area(p) for p in ps)
    i, u, d = (total(planar.overlay([a], [b], h)) for h in ("intersection", "union", "difference"))
    assert i + u == pytest.approx(planar.area(a) + planar.area(b), rel=1e-6) and d + i == pytest.approx(planar.area(a), rel=1e-6)
    pts = rnd.uniform(-12, 12, (4000, 2))
    inside = (planar.locate(pts, a) == 1) & (planar.locate(pts, b) == 1)
    assert abs(inside.mean() * 576 - i) < 12


def test_overlay_of_boxes_and_holes():
    total = lambda ps: sum(planar.area(p) for p in ps)
    hole = planar.overlay([[SQUARE]], [[SQUARE * 0.4 + 2]], "difference")
    assert len(hole) == 1 and len(hole[0]) == 2 and planar.area(hole[0]) == 84
    assert total(planar.overlay([[SQUARE]], [[SQUARE]], "intersection")) == 100 and planar.overlay([[SQUARE]], [[SQUARE]], "difference") == []
    joined = planar.union_all([[SQUARE], [moved(SQUARE, 10, 0)], [moved(SQUARE, 30, 0)]])
    assert sorted(planar.area(p) for p in joined) == [100, 200]
    assert planar.overlay([[SQUARE]], [[moved(SQUARE, 50, 0)]], "intersection") == []


def test_buffers():
    grown = planar.buffer("polygon", [SQUARE], 2.0, 64)
    assert planar.area(grown[0]) == pytest.approx(100 + 80 + math.pi * 4, rel=2e-3)
    assert sum(planar.area(p) for p in planar.buffer("polygon", [SQUARE], -2.0)) == pytest.approx(36, rel=1e-3)
    assert planar.area(planar.buffer("polygon", [ELL], 1.0, 32)[0]) == pytest.approx(75 + 40 + math.pi * 1.25 - 1, rel=2e-2)
    assert planar.area(planar.buffer("point", [SQUARE[:1]], 3.0, 64)[0]) == pytest.approx(math.pi * 9, rel=2e-3)


def test_hulls_and_rectangles():
    rnd = np.random.default_rng(1)
    p = rnd.normal(size=(300, 2))
    hull = planar.convex_hull(p)
    assert (planar.locate(p, [hull]) >= 0).all() and planar.shoelace(hull) > 0
    t = 0.3
    rot = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
    box = planar.min_rotated_rectangle((SQUARE * [2, 1]) @ rot.T)
    sides = sorted(np.hypot(*(box[1] - box[0])) for box in (box, box[1:]))
    assert sides == pytest.approx([10, 20])
    x, y, r = planar.min_bounding_circle(SQUARE)
    assert (x, y) == pytest.approx((5, 5)) and r == pytest.approx(math.sqrt(50))
    ring = density.alpha_shape(np.vstack([p, p + [8, 0]]))
    assert 0 < abs(planar.shoelace(ring)) <= abs(planar.shoelace(planar.convex_hull(np.vstack([p, p + [8, 0]])))) + 1e-9
    assert len(density.hull(p, "ellipse")) == 65 and abs(planar.shoelace(density.hull(p, "bbox"))) > 0


def test_simplify_clip_valid_smooth():
    noisy = medial.resample(SQUARE, 200)
    assert len(planar.simplify(np.vstack([noisy[:-1], noisy[:1]]), 0.5)) <= 6
    clipped = planar.clip_convex(moved(SQUARE, 5, 5), SQUARE)
    assert abs(planar.shoelace(clipped)) == pytest.approx(25)
    bow = np.array([[0, 0], [10, 10], [10, 0], [0, 10], [0, 0]], float)
    assert not planar.simple(bow) and planar.simple(SQUARE)
    assert sum(planar.area(p) for p in planar.make_valid(bow)) == pytest.approx(50)
    for f, size in filters.SMOOTHERS.values():
        out = f(medial.resample(SQUARE, 101), size)
        assert out.shape == (101, 2) and (out[0] == out[-1]).all() and abs(planar.shoelace(out)) > 80


@pytest.mark.parametrize("kind", ["random", "grid", "line", "repeated"])
def test_delaunay_is_empty_circle(kind):
    rnd = np.random.default_rng(2)
    p = {"random": rnd.uniform(0, 100, (150, 2)), "grid": np.array([[x, y] for x in range(8) for y in range(8)], float), "line": np.column_stack([np.arange(9.0), np.arange(9.0)]), "repeated": np.repeat(rnd.uniform(0, 9, (20, 2)), 2, 0)}[kind]
    t = triangulation.delaunay(p)
    u = len(np.unique(p, axis=0))
    if kind == "line":
        assert len(t) == 0 and len(triangulation.edges(p)) == 8
        return
    c = triangulation.circumcentres(p, t)
    r = np.hypot(*(p[t[:, 0]] - c).T)
    gap = np.hypot(*(p[None] - c[:, None]).transpose(2, 0, 1))
    assert (gap >= r[:, None] - 1e-6 * np.maximum(1, r[:, None])).all()
    hull = planar.convex_hull(p)
    assert sum(abs(planar.shoelace(np.vstack([p[x], p[x[:1]]]))) for x in t) == pytest.approx(abs(planar.shoelace(hull)), rel=1e-6)
    d, g, n = ({tuple(e) for e in triangulation.edges(p, h).tolist()} for h in ("delaunay", "gabriel", "rel_nhood"))
    assert n <= g <= d and len({v for e in d for v in e}) == u


def test_medial_lines():
    bar = np.array([[0, 0], [200, 0], [200, 20], [0, 20], [0, 0]], float)
    lines = medial.medial_lines([bar], 300, simplify_level=1)
    longest = max(lines, key=lambda c: np.hypot(*np.diff(c, axis=0).T).sum())
    assert np.hypot(*np.diff(longest, axis=0).T).sum() > 150 and (planar.locate(longest, [bar]) >= 0).all()
    across = medial.perpendiculars(np.array([[20, 10], [180, 10]], float), [bar], 20, 100)
    assert len(across) == 9 and all(np.hypot(*(s[1] - s[0])) == pytest.approx(20) for s in across)
