"""Density clustering kernels and cluster hulls for the points of one slide."""

from __future__ import annotations

import math

import numpy as np

from planarix.kernels import planar, triangulation


class _Cells:
    """Points by grid cell, for radius and nearest-neighbour look-ups."""

    def __init__(self, xy: np.ndarray, size: float) -> None:
        self.xy, self.size = xy, max(size, 1e-12)
        self.table: dict[tuple[int, int], list[int]] = {}
        for i, (a, b) in enumerate(np.floor(xy / self.size).astype(int).tolist()):
            self.table.setdefault((a, b), []).append(i)

    def within(self, i: int, r: float) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.floor(self.xy[i] / self.size).astype(int)
        n = int(math.ceil(r / self.size))
        some = np.array([j for x in range(a - n, a + n + 1) for y in range(b - n, b + n + 1) for j in self.table.get((x, y), ())], int)
        d = np.hypot(*(self.xy[some] - self.xy[i]).T)
        return some[d <= r], d[d <= r]


def dbscan(xy: np.ndarray, eps: float, min_samples: int, **_) -> np.ndarray:
    """Labels in order of the smallest core; border points take the smallest adjacent label."""
    n, cells = len(xy), _Cells(xy, eps)
    near = [cells.within(i, eps)[0] for i in range(n)]
    core = np.array([len(v) >= min_samples for v in near], bool)
    label, count = np.full(n, -1), 0
    for i in range(n):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = count
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = count
                        stack.append(j)
            count += 1
    for i in range(n):
        if not core[i]:
            got = [label[j] for j in near[i] if core[j]]
            label[i] = min(got) if got else -1
    return label


def adbscan(xy: np.ndarray, eps: float, min_samples: int, *, reps: int = 20, share: float = 0.6, agree: float = 0.9, seed: int = 0, **_) -> np.ndarray:
    """Ensemble of DBSCANs over samples (thinned densities), aligned to the full run; a point keeps the label that `agree` of the runs give it."""
    base, rnd, n = dbscan(xy, eps, min_samples), np.random.default_rng(seed), len(xy)
    if n == 0:
        return base
    votes: list[dict[int, int]] = [{} for _ in range(n)]
    need = max(2, math.ceil(min_samples * share))
    for _ in range(reps):
        pick = np.sort(rnd.choice(n, max(1, int(n * share)), replace=False))
        got = dbscan(xy[pick], eps, need)
        names = {}
        for c in set(got.tolist()) - {-1}:  # the full run's label that most of a cluster's points have
            v, k = np.unique(base[pick[got == c]], return_counts=True)
            names[c] = int(v[np.argmax(k)])
        cells = _Cells(xy[pick], eps)
        for i in range(n):
            at = int(np.searchsorted(pick, i))
            if at < len(pick) and pick[at] == i:
                c = got[at]
            else:
                a, b = np.floor(xy[i] / cells.size).astype(int)
                some = np.array([j for x in (a - 1, a, a + 1) for y in (b - 1, b, b + 1) for j in cells.table.get((x, y), ())], int)
                d = np.hypot(*(xy[pick[some]] - xy[i]).T) if len(some) else np.zeros(0)
                c = got[some[np.argmin(d)]] if len(d) and d.min() <= eps else -1
            v = names.get(int(c), -1)
            votes[i][v] = votes[i].get(v, 0) + 1
    out = np.array([max(sorted(v), key=v.get) if max(v.values()) >= agree * reps else -1 for v in votes])
    kept = {c: k for k, c in enumerate(sorted(set(out.tolist()) - {-1}))}
    return np.array([kept.get(int(c), -1) for c in out])


def optics(xy: np.ndarray, eps: float, min_samples: int, *, cut: float | None = None, **_) -> np.ndarray:
    """Ordering by reachability up to `eps`, cut into clusters at `cut` (half of eps by default)."""
    import heapq

    n, cells = len(xy), _Cells(xy, eps)
    cut = eps / 2 if cut is None else cut
    reach, seen, order = np.full(n, np.inf), np.zeros(n, bool), []
    core = np.full(n, np.inf)
    for i in range(n):
        _, d = cells.within(i, eps)
        if len(d) >= min_samples:
            core[i] = np.partition(d, min_samples - 1)[min_samples - 1]
    for s in range(n):
        heap = [(np.inf, s)]
        while heap:
            _, i = heapq.heappop(heap)
            if seen[i]:
                continue
            seen[i] = True
            order.append(i)
            if np.isfinite(core[i]):
                near, d = cells.within(i, eps)
                for j, r in zip(near.tolist(), np.maximum(d, core[i]).tolist(), strict=True):
                    if not seen[j] and r < reach[j]:
                        reach[j] = r
                        heapq.heappush(heap, (r, j))
    label, now = np.full(n, -1), -1
    for i in order:
        if reach[i] > cut:
            now = now + 1 if core[i] <= cut else now
            label[i] = now if core[i] <= cut else -1
        else:
            label[i] = now
    return label


def hdbscan(xy: np.ndarray, min_samples: int = 30, *, min_cluster_size: int | None = None, **_) -> np.ndarray:
    """Hierarchy of mutual reachability, condensed by `min_cluster_size`, clusters chosen by stability."""
    n, size = len(xy), min_cluster_size or min_samples
    if n < 2:
        return np.full(n, -1)
    k = min(min_samples, n) - 1
    core = np.array([np.partition(np.hypot(*(xy - p).T), k)[k] for p in xy])
    # minimum spanning tree of mutual reachability, by Prim
    best, link, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    i, tree = 0, []
    for _ in range(n - 1):
        inside[i] = True
        d = np.maximum(np.maximum(np.hypot(*(xy - xy[i]).T), core), core[i])
        closer = ~inside & (d < best)
        best[closer], link[closer] = d[closer], i
        i = int(np.argmin(np.where(inside, np.inf, best)))
        tree.append((best[i], link[i], i))
    parent, members = list(range(2 * n - 1)), {i: 1 for i in range(n)}
    top, child, fresh = list(range(n)), {}, n

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    at = list(range(n))
    for w, a, b in sorted(tree):
        ra, rb = find(a), find(b)
        child[fresh] = (at[ra], at[rb], w)
        members[fresh] = members[at[ra]] + members[at[rb]]
        top[rb] = ra
        at[ra] = fresh
        fresh += 1
    del parent
    leaves = lambda node: [x for x in _descend(node, child) if x < n]
    # condense: a node splits only if both sides are large enough
    root, stability, kids, born, content = fresh - 1, {}, {}, {}, {}
    stack = [(root, root, 0.0)]
    born[root], stability[root], kids[root], content[root] = 0.0, 0.0, [], leaves(root)
    while stack:
        node, owner, _ = stack.pop()
        if node < n:
            continue
        a, b, w = child[node]
        lam = 1.0 / max(w, 1e-12)
        big = [c for c in (a, b) if members[c] >= size]
        if len(big) == 2:
            stability[owner] += (lam - born[owner]) * members[node]
            for c in big:
                born[c], stability[c], kids[c], content[c] = lam, 0.0, [], leaves(c)
                kids[owner].append(c)
                stack.append((c, c, lam))
        else:
            for c in (a, b):
                if c in big:
                    stack.append((c, owner, lam))
                else:
                    stability[owner] += (lam - born[owner]) * members[c]
    chosen: set[int] = set()

    def pick(c: int) -> float:
        below = sum(pick(x) for x in kids[c])
        if c != root and (not kids[c] or stability[c] >= below):
            for x in _under(c, kids):
                chosen.discard(x)
            chosen.add(c)
            return stability[c]
        return below

    pick(root)
    label = np.full(n, -1)
    for number, c in enumerate(sorted(chosen, key=lambda c: min(content[c]))):
        label[content[c]] = number
    return label


def _descend(node: int, child: dict) -> list[int]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        out.append(x)
        if x in child:
            stack += child[x][:2]
    return out


def _under(c: int, kids: dict) -> list[int]:
    out, stack = [], list(kids[c])
    while stack:
        x = stack.pop()
        out.append(x)
        stack += kids[x]
    return out


def ellipse(xy: np.ndarray) -> tuple[float, float, float]:
    """(major, minor, angle in radians) of the standard deviational ellipse."""
    d = xy - xy.mean(0)
    xss, yss, cv = (d[:, 0] ** 2).sum(), (d[:, 1] ** 2).sum(), (d[:, 0] * d[:, 1]).sum()
    t = math.atan2(xss - yss + math.sqrt((xss - yss) ** 2 + 4 * cv**2), 2 * cv) if cv else 0.0
    n = max(1, len(xy) - 2)
    c, s = math.cos(t), math.sin(t)
    sx = math.sqrt(2 * ((d[:, 0] * c - d[:, 1] * s) ** 2).sum() / n)
    sy = math.sqrt(2 * ((d[:, 0] * s + d[:, 1] * c) ** 2).sum() / n)
    return sx, sy, t


def ellipse_ring(xy: np.ndarray, sides: int = 64) -> np.ndarray:
    sx, sy, t = ellipse(xy)
    turn = np.linspace(0, 2 * math.pi, sides + 1)
    p = np.column_stack([sx * np.cos(turn), sy * np.sin(turn)])
    c, s = math.cos(-t), math.sin(-t)
    ring = p @ np.array([[c, s], [-s, c]]) + xy.mean(0)
    ring[-1] = ring[0]
    return ring


def alpha_shape(xy: np.ndarray) -> np.ndarray:
    """Outer ring of the tightest union of Delaunay triangles that is one piece and holds every point."""
    t = triangulation.delaunay(xy)
    if len(t) < 2:
        return planar.convex_hull(xy)
    sides = np.stack([np.hypot(*(xy[t[:, k]] - xy[t[:, (k + 1) % 3]]).T) for k in range(3)], 1)
    size = np.array([abs(planar.shoelace(np.vstack([xy[x], xy[x[:1]]]))) for x in t])
    radius = sides.prod(1) / np.maximum(4 * size, 1e-12)
    used, order = set(t.ravel().tolist()), np.argsort(radius)

    def fits(count: int) -> np.ndarray | None:
        keep = t[order[:count]]
        if set(keep.ravel().tolist()) != used:
            return None
        edge: dict[tuple[int, int], int] = {}
        for tri in keep.tolist():
            for k in range(3):
                a, b = tri[k], tri[(k + 1) % 3]
                if edge.pop((b, a), None) is None:
                    edge[a, b] = 1
        polys = planar.link(np.array([[*xy[a], *xy[b]] for a, b in edge]))
        return polys[0][0] if len(polys) == 1 else None

    lo, hi = 1, len(t)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) is not None else (mid + 1, hi)
    found = fits(lo)
    return planar.convex_hull(xy) if found is None else found


def hull(xy: np.ndarray, kind: str) -> np.ndarray:
    """Closed ring around points; degenerate sets give a degenerate ring."""
    if kind == "bbox":
        (a, b), (c, d) = xy.min(0), xy.max(0)
        return np.array([[a, b], [c, b], [c, d], [a, d], [a, b]])
    if kind == "ellipse" and len(xy) > 2:
        return ellipse_ring(xy)
    return alpha_shape(xy) if kind == "alpha_shape" and len(xy) > 3 else planar.convex_hull(xy)
