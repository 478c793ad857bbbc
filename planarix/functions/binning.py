"""Classification schemes: upper bounds of right-closed bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planarix.storage import ranged

SCHEMES = (
    "boxplot", "equalinterval", "fisherjenks", "fisherjenkssampled", "headtailbreaks", "jenkscaspall", "jenkscaspallforced", "jenkscaspallsampled",
    "maxp", "maximumbreaks", "naturalbreaks", "percentiles", "prettybreaks", "quantiles", "stdmean", "userdefined",
)
#: Schemes that go by a sample: quantiles of the rows, as many as the caller says.
SAMPLED = {"fisherjenkssampled": "fisherjenks", "jenkscaspallsampled": "jenkscaspall"}


def bin_index(v: Column, bounds: list[float]) -> Column:
    """0-based bin of a value; above the last bound the last bin."""
    out = F.lit(len(bounds) - 1)
    for n in range(len(bounds) - 2, -1, -1):
        out = F.when(v <= F.lit(float(bounds[n])), n).otherwise(out)
    return F.when(v.isNotNull(), out)


def fisher_jenks(values: np.ndarray, counts: np.ndarray, k: int) -> list[float]:
    """Bounds of the k classes of least squared deviation, over distinct ascending values with counts.

    The best last cut moves right with the number of values, so a layer of the dynamic programme is
    halved again and again: k n log n steps, each level at once.
    """
    n, k = len(values), min(k, len(values))
    centred = values - values.mean()
    w, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (counts, counts * centred, counts * centred**2))
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])  # noqa: E731  values[i:j]
    best = np.concatenate([[np.inf], cost(np.zeros(n, int), np.arange(1, n + 1))])
    back = []
    for c in range(2, k + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        # ranges of j that are still open, with the bounds of their best cuts
        lo, hi, first, last = (np.array([v]) for v in (c, n, c - 1, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            top = np.minimum(last, mid - 1)
            size = top - first + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(start - first, size)
            t = best[i] + cost(i, np.repeat(mid, size))
            least = np.minimum.reduceat(t, start)
            at = np.flatnonzero(t == np.repeat(least, size))
            at = at[np.searchsorted(at, start)]
            new[mid], cut[mid] = least, i[at]
            lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, i[at]), (i[at], last)))
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        best = new
        back.append(cut)
    out, j = [float(values[n - 1])], n
    for cut in reversed(back):
        j = cut[j]
        out.append(float(values[j - 1]))
    return out[::-1]


def jenks_caspall(values: np.ndarray, counts: np.ndarray, k: int, forced: bool = False) -> list[float]:
    """Bounds of classes whose values lie nearest to their own class's median, starting from quantiles.

    With `forced`, single values then move over a bound as long as that lowers the summed absolute
    deviation from the medians.
    """
    n, total = len(values), np.concatenate([[0.0], np.cumsum(counts)])
    mass = np.concatenate([[0.0], np.cumsum(counts * values)])

    def median(i: int, j: int) -> float:  # of values[i:j] with their counts
        rows = total[j] - total[i]
        at = [values[int(np.searchsorted(total, total[i] + np.floor(x), "right")) - 1] for x in ((rows - 1) / 2, rows / 2)]
        return float(sum(at) / 2)

    def spread(i: int, j: int) -> float:
        m = median(i, j)
        h = i + int(np.searchsorted(values[i:j], m, "right"))
        return m * (total[h] - total[i]) - (mass[h] - mass[i]) + (mass[j] - mass[h]) - m * (total[j] - total[h])

    ends = np.unique(np.searchsorted(total[1:], total[-1] * np.arange(1, k + 1) / k - 1e-9) + 1).clip(max=n)
    for _ in range(500):
        edges = np.concatenate([[0], ends])
        middle = np.array([median(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        new = np.unique(np.concatenate([np.searchsorted(values, (middle[:-1] + middle[1:]) / 2, "right"), [n]]))
        new = new[new > 0]
        if np.array_equal(new, ends):
            break
        ends = new
    moved = forced
    while moved:
        moved = False
        for c in range(len(ends) - 1):
            lo, hi = (ends[c - 1] if c else 0), ends[c + 1]
            now = spread(lo, ends[c]) + spread(ends[c], hi)
            for e in (ends[c] - 1, ends[c] + 1):
                if lo < e < hi and spread(lo, e) + spread(e, hi) < now - 1e-12 * max(1.0, abs(now)):
                    ends[c], moved = e, True
                    break
    return [float(values[e - 1]) for e in ends]


def _widest_gaps(v: DataFrame, k: int) -> list[float]:
    """Middles of the k widest gaps between neighbouring distinct values, the lowest of equals; one row a range comes to the driver."""
    rows, place = ranged(v.distinct(), ["v"])
    rows = rows.withColumn("p", F.shiftright(place, 33))
    inner = rows.withColumn("after", F.lead("v").over(Window.partitionBy("p").orderBy("v"))).where("after is not null").select("v", "after")
    found = [(r["v"], r["after"]) for r in inner.orderBy((F.col("v") - F.col("after")), "v").limit(k).collect()]
    ends = sorted((r["a"], r["b"]) for r in rows.groupBy("p").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect())
    found += [(b, a) for (_, b), (a, _) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted((a + b) / 2 for a, b in sorted(found, key=lambda g: (g[0] - g[1], g[0]))[:k])


def classify(df: DataFrame, col: str, scheme: str = "fisherjenks", k: int = 5, bounds: list[float] | None = None, *, sample: int = 1000, most: int = 2_000_000) -> list[float]:
    """Upper bounds of the bins of a numeric column.

    Aggregates decide, but for schemes that look for the best classes: these see every distinct value
    with its count on the driver, and raise where there are more than `most`. The sampled ones
    see `sample` quantiles instead, at any size. Natural breaks and max-p look for the optimum
    that Fisher-Jenks finds: classes of least squared deviation, contiguous on the line.
    """
    scheme = scheme.lower()
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}, got {scheme!r}")
    v = df.select(F.col(col).cast("double").alias("v")).where("v is not null")
    if scheme == "userdefined":
        hi = v.agg(F.max("v")).first()[0]
        return [*bounds, hi] if hi is not None and hi > bounds[-1] else list(bounds)
    quant = lambda ps: [float(x) for x in v.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in ps]))).first()[0]]
    one = v.agg(F.min("v"), F.max("v"), F.avg("v"), F.stddev_pop("v"), F.count("*")).first()
    lo, hi, mean, std, n = one
    if n == 0:
        return []
    if scheme == "quantiles":
        return sorted(set(quant([(i + 1) / k for i in range(k)])))
    if scheme == "equalinterval":
        return [lo + (hi - lo) * (i + 1) / k for i in range(k)]
    if scheme == "percentiles":
        return quant([0.01, 0.1, 0.5, 0.9, 0.99, 1.0])
    if scheme == "stdmean":
        cuts = [c for c in (mean - 2 * std, mean - std, mean + std, mean + 2 * std) if c < hi]
        return [*cuts, hi]
    if scheme == "boxplot":
        q1, q2, q3 = quant([0.25, 0.5, 0.75])
        top = q3 + 1.5 * (q3 - q1)
        return [q1 - 1.5 * (q3 - q1), q1, q2, q3, top, *([hi] if hi > top else [])]
    if scheme == "headtailbreaks":
        out, part = [], v
        while True:
            m, distinct = part.agg(F.avg("v"), F.count_distinct("v")).first()
            out.append(float(m))
            if distinct <= 1 or m >= hi:
                return out if out[-1] >= hi else [*out, hi]
            part = part.where(F.col("v") > F.lit(float(m)))
    if scheme == "prettybreaks":
        raw = (hi - lo) / k or 1.0
        unit = 10.0 ** np.floor(np.log10(raw))
        step = unit * min((m for m in (1, 2, 5, 10) if m * unit >= raw), default=10)
        cuts = np.arange(np.floor(lo / step) + 1, np.ceil(hi / step) + 1) * step
        return [float(c) for c in cuts]
    if scheme == "maximumbreaks":
        return [*_widest_gaps(v, k - 1), hi]
    if scheme in SAMPLED:
        values, weight = np.unique(np.array(quant(np.linspace(0, 1, sample))), return_counts=True)
    else:
        rows = v.groupBy("v").agg(F.count("*").alias("n")).limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"{scheme} sees every distinct value, and there are more than {most}: use one of {tuple(SAMPLED)}, or raise `most`")
        rows = rows.sort_values("v")
        values, weight = rows["v"].to_numpy(float), rows["n"].to_numpy()
    weight = weight.astype(float)
    scheme = SAMPLED.get(scheme, scheme)
    out = jenks_caspall(values, weight, k, scheme.endswith("forced")) if scheme.startswith("jenks") else fisher_jenks(values, weight, k)
    return [*out[:-1], hi]
