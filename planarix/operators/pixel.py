"""Pixel features: SQL over long pixel tables, and numpy kernels over tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planarix.kernels import planar, raster

INTENSITY_METRICS = ("min", "max", "mean", "median", "std", "quantiles", "meanmediandiff", "mad", "iqr", "skewness", "kurtosis", "histenergy", "histentropy")


def _named(prefix: str, q: float) -> str:
    return f"{prefix}quantile_{q:g}".replace(".", "_")


def intensity_feats(pixels: DataFrame, value_col: str = "v", metrics: list[str] | tuple[str, ...] = ("mean",), quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), n_bins: int = 32, hist_range: tuple[float, float] | None = None, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row a label: intensity statistics from a long pixel table (label, value). Label 0 is background.

    Histogram metrics use global bounds. Skewness needs three values, kurtosis four, else they are null.
    """
    if bad := [m for m in metrics if m not in INTENSITY_METRICS]:
        raise ValueError(f"Illegal metrics {bad}. Choose from {INTENSITY_METRICS}")
    keys, v = [*(by or []), "label"], F.col(value_col).cast("double")
    rows = pixels.where("label > 0").withColumn("__v", v)
    x, n = F.col("__v"), F.count("*")
    pct = lambda *ps: F.percentile(x, F.array(*[F.lit(float(p)) for p in ps]))
    make: dict[str, list[Column]] = {
        "min": [F.min(x)], "max": [F.max(x)], "mean": [F.avg(x)], "median": [F.median(x)], "std": [F.stddev_pop(x)],
        "quantiles": [pct(*quantiles)[i] for i in range(len(quantiles))],
        "meanmediandiff": [F.try_divide(F.avg(x) - F.median(x), F.median(x))],
        "iqr": [pct(0.25, 0.75)[1] - pct(0.25, 0.75)[0]],
        "skewness": [F.when(n > 2, F.skewness(x))], "kurtosis": [F.when(n > 3, F.kurtosis(x))],
    }
    names = {m: [f"{prefix}{m}"] for m in metrics} | ({"quantiles": [_named(prefix, q) for q in quantiles]} if "quantiles" in metrics else {})
    aggs = [c.alias(a) for m in metrics if m in make for c, a in zip(make[m], names[m], strict=True)]
    out = rows.groupBy(*keys).agg(*aggs, n.alias("__n")).drop("__n")
    if "mad" in metrics:
        med = rows.groupBy(*keys).agg(F.median(x).alias("__med"))
        out = out.join(rows.join(med, keys).groupBy(*keys).agg(F.median(F.abs(x - F.col("__med"))).alias(f"{prefix}mad")), keys)
    if {"histenergy", "histentropy"} & set(metrics):
        if hist_range is None:
            lo, hi = rows.agg(F.min(x), F.max(x)).first()
            hist_range = (lo or 0.0, hi or 0.0)
        lo, width = float(hist_range[0]), (float(hist_range[1]) - float(hist_range[0])) / n_bins or 1.0
        bins = rows.withColumn("__b", F.least(F.floor((x - lo) / F.lit(width)), F.lit(n_bins - 1))).groupBy(*keys, "__b").agg(n.cast("double").alias("__c"))
        from pyspark.sql import Window

        p = F.col("__c") / F.sum("__c").over(Window.partitionBy(*keys))
        made = bins.withColumn("__p", p).groupBy(*keys).agg(F.sum(F.pow("__p", 2)).alias(f"{prefix}histenergy"), F.abs(F.sum(-F.col("__p") * F.log("__p"))).alias(f"{prefix}histentropy"))
        out = out.join(made.select(*keys, *[f"{prefix}{m}" for m in ("histenergy", "histentropy") if m in metrics]), keys)
    return out.select(*keys, *[a for m in metrics for a in names[m]])


def rgb_intensity_feats(pixels: DataFrame, metrics: list[str] | tuple[str, ...] = ("mean",), by: list[str] | None = None, **kw) -> DataFrame:
    """intensity_feats of columns r, g and b with prefixes R_, G_ and B_."""
    keys, out = [*(by or []), "label"], None
    for c in "rgb":
        one = intensity_feats(pixels, c, metrics, by=by, prefix=f"{c.upper()}_", **kw)
        out = one if out is None else out.join(one, keys)
    return out


def cooccurrence(pixels: DataFrame, value_col: str = "v", dy: int = 0, dx: int = 1, by: list[str] | None = None) -> DataFrame:
    """(i, j, n): directed co-occurrence counts at an offset, by an equi-join of pixel positions."""
    by = by or []
    a = pixels.select(*by, F.col("prow").alias("y"), F.col("pcol").alias("x"), F.col(value_col).alias("i"))
    b = pixels.select(*by, (F.col("prow") - dy).alias("y"), (F.col("pcol") - dx).alias("x"), F.col(value_col).alias("j"))
    return a.join(b, [*by, "y", "x"]).groupBy(*by, "i", "j").agg(F.count("*").alias("n"))


def bounding_boxes(pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Half-open bounding box of each label."""
    return pixels.where("label > 0").groupBy(*(by or []), "label").agg(F.min("prow").alias("r0"), (F.max("prow") + 1).alias("r1"), F.min("pcol").alias("c0"), (F.max("pcol") + 1).alias("c1"))


# ---- tiles: numpy arrays of one image each -------------------------------------------------


def _frame(rows: dict[int, dict[str, float]]) -> pd.DataFrame:
    out = pd.DataFrame.from_dict(rows, orient="index")
    out.index.name = "label"
    return out.reset_index()


def _objects(lab: np.ndarray, pad: int = 0):
    """(label, its mask, its window) of each object, in a window of its bounds and `pad` pixels around; one pass over the image."""
    y, x = np.nonzero(lab > 0)
    if not len(y):
        return
    n = lab[y, x]
    order = np.argsort(n, kind="stable")
    y, x, n = y[order], x[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    lows, highs = ([f.reduceat(v, start) for v in (y, x)] for f in (np.minimum, np.maximum))
    for k, i in enumerate(start.tolist()):
        window = tuple(slice(max(0, int(lo[k]) - pad), int(hi[k]) + 1 + pad) for lo, hi in zip(lows, highs, strict=True))
        yield int(n[i]), lab[window] == n[i], window


def _checked_shapes(image: np.ndarray, *others: np.ndarray | None) -> None:
    for a in others:
        if a is not None and a.shape != image.shape[:2]:
            raise ValueError(f"shapes differ: {image.shape[:2]} and {a.shape}")


def _inside(lab: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Labels in the region of interest, where a mask is positive."""
    return lab if mask is None else lab * (mask > 0)


def _statistics(v: np.ndarray, metrics, quantiles, n_bins: int, span: tuple[float, float]) -> dict[str, float]:
    """The metrics of intensity_feats of some values, with histograms over `span`; zeros without values."""
    row = {}
    if v.size:
        m, s, med = v.mean(), v.std(), np.median(v)
        h = np.histogram(v, n_bins, span)[0] / len(v)
        z = (v - m) / s if s > 0 else v * 0
        every = {
            "min": v.min(), "max": v.max(), "mean": m, "median": med, "std": s, "meanmediandiff": (m - med) / max(med, 1e-6), "mad": np.median(np.abs(v - med)), "iqr": np.subtract(*np.percentile(v, (75, 25))),
            "skewness": (z**3).mean() if len(v) > 2 else np.nan, "kurtosis": (z**4).mean() - 3 if len(v) > 3 else np.nan, "histenergy": (h**2).sum(), "histentropy": -(h[h > 0] * np.log(h[h > 0])).sum(),
        }
    for k in metrics:
        if k not in INTENSITY_METRICS:
            raise ValueError(f"Illegal metric {k!r}. Choose from {INTENSITY_METRICS}")
        if k == "quantiles":
            row |= {f"quantile_{q:g}": float(np.quantile(v, q)) if v.size else 0.0 for q in quantiles}
        else:
            row[k] = float(every[k]) if v.size else 0.0
    return row


def grayscale_feats(image: np.ndarray, lab: np.ndarray, metrics=("mean", "std"), quantiles=(0.25, 0.5, 0.75), n_bins: int = 32, mask: np.ndarray | None = None) -> pd.DataFrame:
    """The statistics of intensity_feats from an image and its instance mask, after a percentile rescale; only where `mask` is positive."""
    _checked_shapes(image, lab, mask)
    g, lab = raster.gray(raster.rescale(image)), _inside(lab, mask)
    used = g[lab > 0]
    span = (used.min(), used.max()) if used.size else (0.0, 1.0)
    return _frame({n: _statistics(g[w][m], metrics, quantiles, n_bins, span) for n, m, w in _objects(lab)})


def textural_feats(image: np.ndarray, lab: np.ndarray, metrics=("contrast",), distances=(1,), angles=(0.0,), mask: np.ndarray | None = None) -> pd.DataFrame:
    """Co-occurrence features {metric}_d-{distance}_a-{angle}; objects under four pixels a side get zeros."""
    if bad := [k for k in metrics if k not in TEXTURE_METRICS]:
        raise ValueError(f"Illegal metrics {bad}. Choose from {TEXTURE_METRICS}")
    _checked_shapes(image, lab, mask)
    g, rows = np.clip(raster.gray(raster.rescale(image)) * 255, 0, 255).astype(np.int64), {}
    for n, m, w in _objects(_inside(lab, mask)):
        rows[n] = {}
        for dist in distances:
            for ang in angles:
                got = {} if min(m.shape) < 4 else raster.glcm_metrics(raster.glcm(g[w] * m, dist, ang))
                rows[n] |= {f"{k}_d-{dist}_a-{ang:.2f}": got.get(k, 0.0) for k in metrics}
    return _frame(rows)


TEXTURE_METRICS = ("contrast", "dissimilarity", "homogeneity", "ASM", "energy", "correlation")
CHROMATIN_METRICS = ("chrom_area", "chrom_nuc_prop", "n_chrom_clumps", "chrom_boundary_prop", "manders_coloc_coeff")


def chromatin_clumps(image: np.ndarray, lab: np.ndarray, mask: np.ndarray | None = None, mean: float = 0.0, std: float = 1.0) -> np.ndarray:
    """Dark clumps inside nuclei: pixels not above the first of two multi-Otsu thresholds, of intensities normalised by `mean` and `std`."""
    _checked_shapes(image, lab, mask)
    lab = _inside(lab, mask)
    g = (raster.gray(raster.rescale(image)) - mean) / std
    v = g[lab > 0]
    if not v.size or v.min() == v.max():
        return np.zeros(lab.shape, bool)
    z = (g - v.mean()) / v.std()
    t = raster.multi_otsu(z[lab > 0], 3)[0]
    return (lab > 0) & (z <= t)


def chromatin_feats(image: np.ndarray, lab: np.ndarray, metrics=("chrom_area",), erode: bool = False, mask: np.ndarray | None = None, mean: float = 0.0, std: float = 1.0) -> pd.DataFrame:
    if bad := [m for m in metrics if m not in CHROMATIN_METRICS]:
        raise ValueError(f"Illegal metrics {bad}. Choose from {CHROMATIN_METRICS}")
    clumps, rows, lab = chromatin_clumps(image, lab, mask, mean, std), {}, _inside(lab, mask)
    if erode:
        clumps = raster.erode(clumps)
    g = raster.gray(raster.rescale(image))
    for n, m, w in _objects(lab, 1):
        c, rim = clumps[w] & m, m & ~raster.erode(m)
        every = {
            "chrom_area": c.sum(), "chrom_nuc_prop": c.sum() / m.sum(), "n_chrom_clumps": raster.label(c).max(), "chrom_boundary_prop": (c & rim).sum() / max(1, rim.sum()),
            "manders_coloc_coeff": g[w][c].sum() / max(g[w][m].sum(), 1e-12),
        }
        rows[n] = {k: float(every[k]) for k in metrics}
    return _frame(rows)


def collagen_fibers(image: np.ndarray, lab: np.ndarray | None = None, sigma: float = 2.5, min_size: int = 25, rm_bg: bool = False, rm_fg: bool = False, mask: np.ndarray | None = None) -> np.ndarray:
    """Edge mask of fibres: Canny edges without nuclei, background or dark parts, small ones dropped; only where `mask` is positive."""
    edges = raster.canny(raster.gray(image.astype(float) / 255), sigma)
    if lab is not None:
        edges &= ~raster.dilate(lab > 0, 2)
    if rm_bg or rm_fg:
        bg, dark = raster.tissue_components(image, lab)
        edges &= ~(bg if rm_bg else np.zeros_like(bg)) & ~(dark if rm_fg else np.zeros_like(dark))
    edges = raster.remove_small(edges, min_size - 1)
    return edges if mask is None else edges & (mask > 0)


FIBER_METRICS = ("length", "tortuosity", "average_turning_angle", "major_axis_len", "minor_axis_len", "major_axis_angle", "minor_axis_angle")


def fiber_feats(image: np.ndarray, metrics=("length",), lab: np.ndarray | None = None, normalize: bool = False, return_edges: bool = False, **kw) -> pd.DataFrame:
    """Features of each fibre: pixel count, count over chord, mean turning angle in radians, rotated rectangle.

    With `normalize`, average ranks in [0, 1] over the image; with `return_edges`, the outlines of the fibres (grown by a
    pixel) as `rings`, a list of (n, 2) arrays. Other arguments are those of collagen_fibers.
    """
    if bad := [m for m in metrics if m not in FIBER_METRICS]:
        raise ValueError(f"Illegal metrics {bad}. Choose from {FIBER_METRICS}")
    found = raster.label(collagen_fibers(image, lab, **kw))
    rows, edges = {}, {}
    for n, m, w in _objects(found, 1):
        y, x = np.nonzero(m)
        p = np.column_stack([x + w[1].start, y + w[0].start]).astype(float)
        box = planar.min_rotated_rectangle(p)
        a, b = box[1] - box[0], box[2] - box[1]
        a, b = (a, b) if np.hypot(*a) >= np.hypot(*b) else (b, a)
        chord = float(np.hypot(*(p[-1] - p[0])))
        head = np.arctan2(*np.diff(p, axis=0).T[::-1])
        turn = np.abs(np.diff(head))
        turn = np.minimum(turn, 2 * np.pi - turn)
        deg = lambda v: float(np.degrees(np.arctan2(v[1], v[0]) % np.pi))
        fold = lambda t: min(t, 180 - t)
        every = {
            "length": float(len(p)), "tortuosity": len(p) / chord if chord else np.nan, "average_turning_angle": float(turn.mean()) if len(turn) else 0.0,
            "major_axis_len": float(np.hypot(*a)), "minor_axis_len": float(np.hypot(*b)), "major_axis_angle": fold(deg(a)), "minor_axis_angle": fold(deg(b)),
        }
        rows[n] = {k: every[k] for k in metrics}
        if return_edges:
            parts = [r + [w[1].start, w[0].start] for poly in raster.trace(raster.dilate(m, 1)) for r in poly]
            edges[n] = parts
    out = _frame(rows)
    if normalize and len(out):
        spread = max(1, len(out) - 1)
        out[list(metrics)] = (out[list(metrics)].rank(method="average") - 1) / spread
    if return_edges:
        out["rings"] = [edges[n] for n in out["label"]]
    return out


def stromal_intensity_feats(image: np.ndarray, lab: np.ndarray | None = None, metrics=("mean", "std"), quantiles=(0.25, 0.5, 0.75), n_bins: int = 32, hist_range: tuple[float, float] | None = None, mask: np.ndarray | None = None) -> pd.Series:
    """Area and channel statistics ({stain}_{RGB}_{metric}) of the haematoxylin and eosin parts of an image outside nuclei, where `mask` is positive.

    Histograms go over `hist_range`, or over the part's own values.
    """
    _checked_shapes(image, lab, mask)
    eosin = raster.eosin_mask(image)
    hema = raster.hematoxylin_mask(image, eosin)
    keep = np.ones(image.shape[:2], bool) if lab is None else lab == 0
    keep &= True if mask is None else mask > 0
    out = {}
    for stain, m in (("hematoxylin", hema & keep), ("eosin", eosin & keep)):
        out[f"{stain}_area"] = float(m.sum())
        for k, c in enumerate("RGB"):
            v = image[..., k][m].astype(float)
            span = hist_range or ((v.min(), v.max()) if v.size else (0.0, 1.0))
            out |= {f"{stain}_{c}_{name}": x for name, x in _statistics(v, metrics, quantiles, n_bins, span).items()}
    return pd.Series(out)
