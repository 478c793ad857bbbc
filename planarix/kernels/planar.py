"""Planar geometry on numpy arrays: predicates, hulls, overlay, buffers, simplification.

A ring is an (n, 2) array, closed for polygons. A polygon is a list of rings (shell, holes...).
"""

from __future__ import annotations

import math
import random

import numpy as np

EPS = 1e-9


def shoelace(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def area(poly: list[np.ndarray]) -> float:
    return abs(shoelace(poly[0])) - sum(abs(shoelace(h)) for h in poly[1:])


def perimeter(poly: list[np.ndarray]) -> float:
    return float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in poly))


def segments(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4) x1 y1 x2 y2; a lone vertex is a segment of length 0."""
    out = [np.hstack([r[:-1], r[1:]]) if len(r) > 1 else np.hstack([r, r]) for r in rings]
    return np.vstack(out) if out else np.zeros((0, 4))


def locate(points: np.ndarray, poly: list[np.ndarray]) -> np.ndarray:
    """1 inside, 0 on the boundary, -1 outside, for each point."""
    s = segments(poly)
    x, y = points[:, 0, None], points[:, 1, None]
    x1, y1, x2, y2 = (s[None, :, k] for k in range(4))
    scale = max(1.0, float(np.abs(s).max(initial=1.0)))
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(size > 0, size, 1), 0, 1)
    on = (np.hypot(x1 + t * dx - x, y1 + t * dy - y) <= EPS * scale).any(1)
    spans = (y1 > y) != (y2 > y)
    at = dx * (y - y1) / np.where(dy == 0, 1, dy) + x1
    inside = (spans & (x < at)).sum(1) % 2 == 1
    return np.where(on, 0, np.where(inside, 1, -1))


def crossings(a: np.ndarray, b: np.ndarray) -> list[list[float]]:
    """For each segment of a, the parameters in [0, 1] at which segments of b touch it."""
    cuts: list[list[float]] = [[] for _ in range(len(a))]
    if not len(a) or not len(b):
        return cuts
    d, e = a[:, None, 2:] - a[:, None, :2], b[None, :, 2:] - b[None, :, :2]
    w = b[None, :, :2] - a[:, None, :2]
    det = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
    scale = np.maximum(1e-300, np.hypot(d[..., 0], d[..., 1]) * np.hypot(e[..., 0], e[..., 1]))
    cross = np.abs(det) > 1e-12 * scale
    safe = np.where(cross, det, 1)
    t = (w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0]) / safe
    u = (w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) / safe
    hit = cross & (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
    for i, j in zip(*np.nonzero(hit), strict=True):
        cuts[i].append(float(t[i, j]))
    # collinear: the ends of b's segments that lie on a's
    size = (d**2).sum(-1)
    off = np.abs(w[..., 0] * d[..., 1] - w[..., 1] * d[..., 0]) / np.sqrt(np.maximum(size, 1e-300))
    flat = ~cross & (size > 0) & (off <= EPS * max(1.0, np.abs(a).max(), np.abs(b).max()))
    for i, j in zip(*np.nonzero(flat), strict=True):
        for p in (b[j, :2], b[j, 2:]):
            s = float(((p - a[i, :2]) * d[i, 0 if d.shape[1] == 1 else j]).sum() / size[i, 0 if size.shape[1] == 1 else j])
            if -EPS <= s <= 1 + EPS:
                cuts[i].append(s)
    return cuts


def split(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Segments of a cut wherever b touches them."""
    sa, sb = segments(a), segments(b)
    out = []
    for s, cut in zip(sa, crossings(sa, sb), strict=True):
        ts = sorted({0.0, 1.0, *(min(1.0, max(0.0, c)) for c in cut)})
        ts = [t for n, t in enumerate(ts) if n == 0 or t - ts[n - 1] > 1e-12]
        p, q = s[:2], s[2:]
        pts = [p if t == 0 else q if t == 1 else p + t * (q - p) for t in ts]
        out += [np.concatenate(x) for x in zip(pts[:-1], pts[1:], strict=True)] or [s]
    return np.array(out).reshape(-1, 4)


def _middles(s: np.ndarray) -> np.ndarray:
    return (s[:, :2] + s[:, 2:]) / 2


def inner_point(poly: list[np.ndarray]) -> np.ndarray:
    """A point strictly inside: the middle of the widest chord on a scan line between vertices."""
    ys = np.unique(np.concatenate([r[:, 1] for r in poly]))
    y = (ys[:-1] + ys[1:])[np.argmax(np.diff(ys))] / 2
    s = segments(poly)
    some = s[(s[:, 1] > y) != (s[:, 3] > y)]
    xs = np.sort(some[:, 0] + (y - some[:, 1]) / (some[:, 3] - some[:, 1]) * (some[:, 2] - some[:, 0]))
    k = int(np.argmax(xs[1::2] - xs[::2]))
    return np.array([(xs[2 * k] + xs[2 * k + 1]) / 2, y])


PREDICATES = ("contains", "contains_properly", "covered_by", "covers", "crosses", "intersects", "overlaps", "touches", "within", "dwithin")


def relation(kind_a: str, a: list[np.ndarray], kind_b: str, b: list[np.ndarray]) -> dict[str, bool]:
    """Which interiors, boundaries and exteriors of two geometries meet.

    Keys: ii, ib, bi, bb (interior of a with interior/boundary of b...), ae (some of a outside b), be.
    """
    dims = {"point": 0, "line": 1, "polygon": 2}
    da, db = dims[kind_a], dims[kind_b]
    if da < db:
        r = relation(kind_b, b, kind_a, a)
        return {"ii": r["ii"], "ib": r["bi"], "bi": r["ib"], "bb": r["bb"], "ae": r["be"], "be": r["ae"]}
    if da == 2:
        if db == 0:
            at = locate(b[0][:1], a)[0]
            return {"ii": at == 1, "ib": False, "bi": at == 0, "bb": False, "ae": True, "be": at == -1}
        cut_b = split(b, a)
        where_b = locate(_middles(cut_b), a) if len(cut_b) else np.zeros(0)
        ends_b = locate(np.vstack([cut_b[:, :2], cut_b[:, 2:]]), a)
        if db == 1:
            closed = len(b[0]) > 1 and (b[0][0] == b[0][-1]).all()
            tips = np.zeros((0, 2)) if closed else np.vstack([b[0][:1], b[0][-1:]])
            at = locate(tips, a) if len(tips) else np.zeros(0)
            inner_touch = bool((where_b == 0).any()) or bool((ends_b == 0).sum() > (at == 0).sum())
            return {"ii": bool((where_b == 1).any()), "ib": bool((at == 1).any()), "bi": inner_touch, "bb": bool((at == 0).any()), "ae": True, "be": bool((where_b == -1).any())}
        cut_a = split(a, b)
        where_a = locate(_middles(cut_a), b)
        same = bool((where_a == 0).all() and (where_b == 0).all())
        ii = bool((where_a == 1).any() or (where_b == 1).any())
        if not ii and ((where_b == 0).any() or (where_a == 0).any()) or same:
            ii = ii or locate(inner_point(b)[None], a)[0] == 1 or locate(inner_point(a)[None], b)[0] == 1
        touch = bool((ends_b == 0).any())
        a_out = bool((where_a == -1).any()) or (not same and bool((where_b == 1).any()))
        b_out = bool((where_b == -1).any()) or (not same and bool((where_a == 1).any()))
        if not ii:
            a_out = b_out = True
        return {"ii": bool(ii), "ib": bool((where_b == 1).any()), "bi": bool((where_a == 1).any()), "bb": touch, "ae": a_out, "be": b_out}
    if da == 1:
        s = segments(a)
        if db == 0:
            gap = distance_segments(s, segments([b[0][:1]]))
            on = gap <= EPS * max(1.0, np.abs(s).max())
            tip = on and any(np.hypot(*(b[0][0] - t)) <= EPS for t in (a[0][0], a[0][-1])) and not (a[0][0] == a[0][-1]).all()
            return {"ii": bool(on and not tip), "ib": False, "bi": bool(tip), "bb": False, "ae": True, "be": not on}
        t = segments(b)
        near = distance_segments(s, t) <= EPS * max(1.0, np.abs(s).max(), np.abs(t).max())
        tol = EPS * max(1.0, np.abs(s).max(), np.abs(t).max())
        a_on = all(distance_segments(segments([m[None]]), t) <= tol for m in _middles(split(a, b)))
        b_on = all(distance_segments(segments([m[None]]), s) <= tol for m in _middles(split(b, a)))
        tips_a, tips_b = [a[0][0], a[0][-1]], [b[0][0], b[0][-1]]
        bb = any(np.hypot(*(p - q)) <= tol for p in tips_a for q in tips_b)
        cut = {tuple(np.round(p, 9)) for row in split(a, b) for p in (row[:2], row[2:]) if distance_segments(segments([p[None]]), t) <= tol}
        only = cut <= {tuple(np.round(p, 9)) for p in tips_a + tips_b}
        ii = near and (a_on or b_on or not only or any(distance_segments(segments([m[None]]), t) <= tol for m in _middles(split(a, b))))
        return {"ii": bool(ii), "ib": bool(near and not ii), "bi": bool(near and not ii), "bb": bool(bb), "ae": not a_on, "be": not b_on}
    equal = bool(np.hypot(*(a[0][0] - b[0][0])) <= EPS)
    return {"ii": equal, "ib": False, "bi": False, "bb": False, "ae": not equal, "be": not equal}


def satisfies(predicate: str, kind_a: str, a: list[np.ndarray], kind_b: str, b: list[np.ndarray], distance: float = 0.0) -> bool:
    """Whether a.predicate(b)."""
    if predicate == "dwithin":
        return geometry_distance(kind_a, a, kind_b, b) <= distance
    r = relation(kind_a, a, kind_b, b)
    any_ = r["ii"] or r["ib"] or r["bi"] or r["bb"]
    dims = {"point": 0, "line": 1, "polygon": 2}
    da, db = dims[kind_a], dims[kind_b]
    return bool(
        {
            "intersects": lambda: any_,
            "contains": lambda: r["ii"] and not r["be"],
            "within": lambda: r["ii"] and not r["ae"],
            "covers": lambda: any_ and not r["be"],
            "covered_by": lambda: any_ and not r["ae"],
            "contains_properly": lambda: r["ii"] and not r["be"] and not r["bb"] and not r["bi"],
            "touches": lambda: any_ and not r["ii"],
            "overlaps": lambda: da == db and r["ii"] and r["ae"] and r["be"],
            "crosses": lambda: da != db and r["ii"] and (r["be"] if da > db else r["ae"]) or da == db == 1 and r["ii"] and r["ae"] and r["be"],
        }[predicate]()
    )


def distance_segments(a: np.ndarray, b: np.ndarray) -> float:
    """Smallest distance of two sets of segments."""
    if not len(a) or not len(b):
        return math.inf

    def to_points(s: np.ndarray, p: np.ndarray) -> float:
        d = s[:, None, 2:] - s[:, None, :2]
        size = (d**2).sum(-1)
        t = np.clip(((p[None] - s[:, None, :2]) * d).sum(-1) / np.where(size > 0, size, 1), 0, 1)
        near = s[:, None, :2] + t[..., None] * d
        return float(np.hypot(*(near - p[None]).reshape(-1, 2).T).min())

    best = min(to_points(a, np.vstack([b[:, :2], b[:, 2:]])), to_points(b, np.vstack([a[:, :2], a[:, 2:]])))
    return 0.0 if best > 0 and any(crossings(a, b)) else best


def geometry_distance(kind_a: str, a: list[np.ndarray], kind_b: str, b: list[np.ndarray]) -> float:
    """0 where geometries intersect."""
    for kind, g, other in ((kind_a, a, b), (kind_b, b, a)):
        if kind == "polygon" and locate(other[0][:1], g)[0] >= 0:
            return 0.0
    return distance_segments(segments(a), segments(b))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise hull by monotone chains; fewer than three vertices for collinear input."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array([*p, p[0]])

    def chain(order) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = chain(p) + chain(p[::-1])
    return np.array([*hull, hull[0]])


def min_rotated_rectangle(points: np.ndarray, hull: np.ndarray | None = None) -> np.ndarray:
    """Corners (4, 2) of the smallest enclosing rectangle, one side along a hull edge; of equal ones that of least perimeter."""
    hull = (convex_hull(points) if hull is None else hull)[:-1]
    if len(hull) < 3:
        a, b = hull[0], hull[-1]
        return np.array([a, b, b, a])
    p = hull.tolist()
    angles = sorted({round(math.atan2(b[1] - a[1], b[0] - a[0]) % (math.pi / 2), 12) for a, b in zip(p, p[1:] + p[:1], strict=True)})
    best = None
    for t in angles:
        c, s = math.cos(t), math.sin(t)
        pu, pv = [x * c + y * s for x, y in p], [y * c - x * s for x, y in p]
        wide, high = max(pu) - min(pu), max(pv) - min(pv)
        size, slack = wide * high, 1e-9 * max(1.0, wide * high)
        if best is None or size < best[0] - slack or (size < best[0] + slack and wide + high < best[1] - 1e-9):
            best = (size, wide + high, (c, s), min(pu), max(pu), min(pv), max(pv))
    _, _, (c, s), a, b, d, e = best
    return np.array([(u * c - v * s, u * s + v * c) for u, v in ((a, d), (b, d), (b, e), (a, e))])


def min_bounding_circle(points: np.ndarray, hull: np.ndarray | None = None) -> tuple[float, float, float]:
    """(x, y, r) by Welzl's move-to-front method over the hull."""
    p = (convex_hull(points) if hull is None else hull)[:-1].tolist()
    random.Random(0).shuffle(p)

    def two(a, b):
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.hypot(a[0] - b[0], a[1] - b[1]) / 2

    def three(a, b, c):
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if abs(d) < 1e-12:
            return max((two(a, b), two(b, c), two(a, c)), key=lambda z: z[2])
        s = [q[0] ** 2 + q[1] ** 2 for q in (a, b, c)]
        x = (s[0] * (b[1] - c[1]) + s[1] * (c[1] - a[1]) + s[2] * (a[1] - b[1])) / d
        y = (s[0] * (c[0] - b[0]) + s[1] * (a[0] - c[0]) + s[2] * (b[0] - a[0])) / d
        return x, y, math.hypot(a[0] - x, a[1] - y)

    holds = lambda c, q: math.hypot(q[0] - c[0], q[1] - c[1]) <= c[2] * (1 + 1e-12) + 1e-12
    c = (p[0][0], p[0][1], 0.0)
    for i in range(1, len(p)):
        if not holds(c, p[i]):
            c = (p[i][0], p[i][1], 0.0)
            for j in range(i):
                if not holds(c, p[j]):
                    c = two(p[i], p[j])
                    for k in range(j):
                        if not holds(c, p[k]):
                            c = three(p[i], p[j], p[k])
    return c


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with both ends kept; a closed ring is cut at its start and keeps at least four vertices."""
    if len(ring) < 3 or tolerance <= 0:
        return ring
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    stack = [(0, len(ring) - 1)]
    closed = (ring[0] == ring[-1]).all()
    if closed:
        far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
        keep[far] = True
        stack = [(0, far), (far, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = ring[b] - ring[a]
        w = ring[a + 1 : b] - ring[a]
        size = float(np.hypot(*d))
        gap = np.hypot(*w.T) if size == 0 else np.abs(d[0] * w[:, 1] - d[1] * w[:, 0]) / size
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    out = ring[keep]
    return out if not closed or len(out) >= 4 else ring


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray | None:
    """Sutherland-Hodgman clip of a closed ring to a convex counter-clockwise closed ring."""
    out = [tuple(p) for p in ring[:-1]]
    for a, b in zip(window[:-1], window[1:], strict=True):
        side = lambda p, a=a, b=b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        was, out = out, []
        for p, q in zip(was, was[1:] + was[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return None
    made = np.array(out + out[:1])
    return made if len(made) >= 4 and abs(shoelace(made)) > 0 else None


def _oriented(poly: list[np.ndarray]) -> list[np.ndarray]:
    """Shell counter-clockwise, holes clockwise."""
    return [r if (shoelace(r) > 0) == (n == 0) else r[::-1] for n, r in enumerate(poly)]


def overlay(a: list[list[np.ndarray]], b: list[list[np.ndarray]], how: str) -> list[list[np.ndarray]]:
    """intersection, union or difference of two sets of interior-disjoint polygons.

    Boundaries are cut at each other; the pieces that bound the result are chosen by where their
    middles lie, and linked into rings with the interior on the left.
    """
    ra, rb = ([r for p in g for r in _oriented(p)] for g in (a, b))
    if not ra or not rb:
        return a if how == "difference" or (how == "union" and ra) else b if how == "union" else []
    sa, sb = split(ra, rb), split(rb, ra)
    inside_b = np.max([locate(_middles(sa), p) for p in b], axis=0)
    inside_a = np.max([locate(_middles(sb), p) for p in a], axis=0)
    key = lambda s: tuple(np.round(s, 7))
    ways = {key(s) for s in sb}
    same = np.array([key(s) in ways for s in sa])
    shared = inside_b == 0
    if how == "intersection":
        chosen = np.vstack([sa[(inside_b == 1) | (shared & same)], sb[inside_a == 1]])
    elif how == "union":
        chosen = np.vstack([sa[(inside_b == -1) | (shared & same)], sb[inside_a == -1]])
    else:
        chosen = np.vstack([sa[(inside_b == -1) | (shared & ~same)], sb[inside_a == 1][:, [2, 3, 0, 1]]])
    return link(chosen)


def link(edges: np.ndarray) -> list[list[np.ndarray]]:
    """Rings, then polygons with holes, from directed edges with the interior on their left."""
    name = lambda p: (round(float(p[0]), 7), round(float(p[1]), 7))
    out_of: dict[tuple, list[int]] = {}
    for n, e in enumerate(edges):
        if name(e[:2]) != name(e[2:]):
            out_of.setdefault(name(e[:2]), []).append(n)
    left = {n for v in out_of.values() for n in v}
    rings = []
    for start in sorted(left):
        if start not in left:
            continue
        ring, n = [], start
        while n in left:
            left.discard(n)
            ring.append(edges[n, :2])
            here = name(edges[n, 2:])
            options = [m for m in out_of.get(here, []) if m in left]
            if not options:
                break
            back = math.atan2(edges[n, 1] - edges[n, 3], edges[n, 0] - edges[n, 2])
            # the first edge clockwise from where we came keeps rings simple
            n = min(options, key=lambda m: (back - math.atan2(edges[m, 3] - edges[m, 1], edges[m, 2] - edges[m, 0])) % (2 * math.pi) or 2 * math.pi)
        if len(ring) >= 3 and here == name(ring[0]):
            ring = np.array([*ring, ring[0]])
            if abs(shoelace(ring)) > 1e-9:
                rings.append(ring)
    shells = [[r] for r in rings if shoelace(r) > 0]
    for hole in (r for r in rings if shoelace(r) < 0):
        probe = inner_point([hole[::-1]])[None]
        owners = [s for s in shells if locate(probe, s[:1])[0] == 1]
        if owners:
            min(owners, key=lambda s: abs(shoelace(s[0]))).append(hole)
    return shells


def union_all(polys: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Union by halves, so that rings stay small as long as possible."""
    groups = [[p] for p in polys]
    while len(groups) > 1:
        groups = [overlay(groups[i], groups[i + 1], "union") if i + 1 < len(groups) else groups[i] for i in range(0, len(groups), 2)]
    return groups[0] if groups else []


def buffer(kind: str, rings: list[np.ndarray], distance: float, arc: int = 8) -> list[list[np.ndarray]]:
    """All points within `distance`: the union of capsules around edges, and the polygon. Negative distances shrink polygons."""
    turn = np.linspace(0, 2 * math.pi, 4 * arc, endpoint=False)
    circle = abs(distance) * np.column_stack([np.cos(turn), np.sin(turn)])
    if distance == 0:
        return [rings] if kind == "polygon" else []
    capsules = [[convex_hull(np.vstack([s[:2] + circle, s[2:] + circle]))] for s in segments(rings)]
    if kind != "polygon":
        return union_all(capsules)
    if distance > 0:
        hull = convex_hull(rings[0])
        if len(rings) == 1 and abs(abs(shoelace(hull)) - area(rings)) <= 1e-9 * area(rings):  # convex: exact in one hull
            return [[convex_hull(np.vstack([p + circle for p in rings[0]]))]]
        return union_all([rings, *capsules])
    return overlay([rings], union_all(capsules), "difference")


def simple(ring: np.ndarray) -> bool:
    """Whether a closed ring doesn't meet itself but in neighbouring corners."""
    s = segments([ring])
    for i, cuts in enumerate(crossings(s, s)):
        near = sum(1 for t in cuts if t <= EPS or t >= 1 - EPS)
        if len(cuts) > near:
            return False
        if near > 6:
            return False
        del i
    corners = {tuple(p) for p in np.round(ring[:-1], 9)}
    return len(corners) == len(ring) - 1


def make_valid(ring: np.ndarray) -> list[list[np.ndarray]]:
    """Parts with odd winding of a closed ring that may cross itself."""
    s = segments([ring])
    pieces = []
    for seg, cut in zip(s, crossings(s, s), strict=True):
        ts = sorted({0.0, 1.0, *(min(1.0, max(0.0, c)) for c in cut)})
        pts = [seg[:2] + t * (seg[2:] - seg[:2]) for t in ts]
        pieces += [np.concatenate(x) for x in zip(pts[:-1], pts[1:], strict=True) if np.hypot(*(x[1] - x[0])) > 1e-9]
    out = []
    for e in pieces:  # orient each piece so that the inside of the even-odd region is on its left
        d = e[2:] - e[:2]
        normal = np.array([-d[1], d[0]]) / np.hypot(*d)
        mid, step = (e[:2] + e[2:]) / 2, 1e-6 * max(1.0, float(np.abs(ring).max()))
        left, right = locate(np.array([mid + step * normal, mid - step * normal]), [ring])
        if left == 1 and right == -1:
            out.append(e)
        elif right == 1 and left == -1:
            out.append(e[[2, 3, 0, 1]])
    return link(np.array(out).reshape(-1, 4)) if out else []
