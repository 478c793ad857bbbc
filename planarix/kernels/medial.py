"""Medial lines of polygons and perpendiculars along them."""

from __future__ import annotations

import numpy as np

from planarix.kernels import planar, triangulation


def resample(ring: np.ndarray, n: int, delta: float | None = None) -> np.ndarray:
    """n points at equal distances along a line, ends included."""
    d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(ring, axis=0).T))])
    at = np.arange(0, d[-1], delta) if delta else np.linspace(0, d[-1], n)
    return np.column_stack([np.interp(at, d, ring[:, 0]), np.interp(at, d, ring[:, 1])])


def chains(ridges: np.ndarray, close: float = 1.0) -> list[np.ndarray]:
    """Ridges joined at shared vertices into lines that end where three meet, then near ends merged greedily."""
    name = lambda p: (round(float(p[0]), 6), round(float(p[1]), 6))
    near: dict[tuple, set[tuple]] = {}
    for r in ridges:
        a, b = name(r[:2]), name(r[2:])
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    used: set[frozenset] = set()
    out = []
    starts = sorted(v for v in near if len(near[v]) != 2) + sorted(v for v in near if len(near[v]) == 2)
    for s in starts:
        for n in sorted(near[s]):
            if frozenset((s, n)) in used:
                continue
            line, here = [s], n
            used.add(frozenset((s, n)))
            while True:
                line.append(here)
                more = [m for m in sorted(near[here]) if frozenset((here, m)) not in used]
                if len(near[here]) != 2 or not more:
                    break
                used.add(frozenset((here, more[0])))
                here = more[0]
            out.append(np.array(line))
    out.sort(key=len, reverse=True)
    merged = True
    while merged and len(out) > 1:
        merged = False
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                for a in (out[i], out[i][::-1]):
                    for b in (out[j], out[j][::-1]):
                        if not merged and np.hypot(*(a[-1] - b[0])) <= close:
                            out[i] = np.vstack([a, b[1:]])
                            del out[j]
                            merged = True
                    if merged:
                        break
                if merged:
                    break
            if merged:
                break
    return out


def medial_lines(rings: list[np.ndarray], num_points: int | None = 500, delta: float = 0.3, simplify_level: float = 30) -> list[np.ndarray]:
    """Voronoi ridges of the outline, resampled to num_points or else every `delta`, with both ends inside the polygon, as lines."""
    shell = planar.simplify(rings[0], simplify_level)
    if num_points is None:
        num_points = max(8, round(planar.perimeter([shell]) / delta))
    pts = resample(shell, num_points)[:-1]
    pts = np.vstack([pts, *[resample(h, max(8, num_points // 4))[:-1] for h in rings[1:]]])
    # break the symmetry of regular outlines by less than any coordinate matters
    pts = pts + np.random.default_rng(0).normal(0, 1e-7 * max(1.0, np.abs(pts).max()), pts.shape)
    ridges = triangulation.voronoi_ridges(pts)
    if not len(ridges):
        return []
    body = [shell, *rings[1:]]
    inside = (planar.locate(ridges[:, :2], body) == 1) & (planar.locate(ridges[:, 2:], body) == 1)
    return [c for c in chains(ridges[inside]) if len(c) > 1]


def clip_line(line: np.ndarray, poly: list[np.ndarray]) -> np.ndarray | None:
    """The longest piece of a segment inside a polygon."""
    pieces = planar.split([line], poly)
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2
    inside = planar.locate(mid, poly) >= 0
    best, run = None, []
    for p, ok in [*zip(pieces, inside, strict=True), (None, False)]:
        if ok:
            run.append(p)
        elif run:
            made = np.array([run[0][:2], run[-1][2:]])
            if best is None or np.hypot(*(made[1] - made[0])) > np.hypot(*(best[1] - best[0])):
                best = made
            run = []
    return best


def perpendiculars(line: np.ndarray, poly: list[np.ndarray], step: float = 100, length: float | None = None) -> list[np.ndarray]:
    """Normal segments every `step` along a line, clipped to the polygon."""
    d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))])
    total = d[-1]
    at = lambda s: np.array([np.interp(s, d, line[:, 0]), np.interp(s, d, line[:, 1])])
    if length is None:
        length = float(np.ptp(poly[0], axis=0).max()) / 2
    out, reach = [], min(10.0, 0.01 * total)
    for s in np.arange(0, total + 1e-9, step):
        t = at(min(total, s + reach)) - at(max(0.0, s - reach))
        size = np.hypot(*t)
        if size == 0:
            continue
        n = np.array([-t[1], t[0]]) / size * length / 2
        got = clip_line(np.array([at(s) - n, at(s) + n]), poly)
        if got is not None:
            out.append(got)
    return out
