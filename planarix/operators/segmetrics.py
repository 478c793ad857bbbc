"""Segmentation metrics as aggregates over a (gt, pred) pixel table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pixels: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    return pixels.groupBy(F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_metrics(pixels: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """(class, tp, fp, fn, tn, iou, dice, sensitivity, specificity, precision, accuracy) for every class of either side."""
    c = confusion(pixels, gt, pred)
    both = c.select(F.col("gt").alias("class"), "n", (F.col("gt") == F.col("pred")).alias("hit"), F.lit(True).alias("is_gt")).unionAll(c.select(F.col("pred"), "n", F.col("gt") == F.col("pred"), F.lit(False)))
    s = both.groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("hit") & F.col("is_gt"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & ~F.col("is_gt"), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~F.col("hit") & F.col("is_gt"), F.col("n"))), F.lit(0)).alias("fn"),
    ).crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn"))
    r = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return s.select(
        "class", "tp", "fp", "fn", "tn", r(tp, tp + fp + fn).alias("iou"), r(2 * tp, 2 * tp + fp + fn).alias("dice"), r(tp, tp + fn).alias("sensitivity"), r(tn, tn + fp).alias("specificity"),
        r(tp, tp + fp).alias("precision"), r(tp + tn, F.col("all")).alias("accuracy"),
    )


def instance_pairs(pixels: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """(g, p, inter, union, iou) of overlapping instances; label 0 is background."""
    inter = pixels.where((F.col(gt) > 0) & (F.col(pred) > 0)).groupBy(F.col(gt).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("inter"))
    sg = pixels.where(F.col(gt) > 0).groupBy(F.col(gt).alias("g")).agg(F.count("*").alias("sg"))
    sp = pixels.where(F.col(pred) > 0).groupBy(F.col(pred).alias("p")).agg(F.count("*").alias("sp"))
    j = inter.join(sg, "g").join(sp, "p").withColumn("union", F.col("sg") + F.col("sp") - F.col("inter"))
    return j.select("g", "p", "inter", "union", (F.col("inter") / F.col("union")).alias("iou"), "sg", "sp")


def panoptic_quality(pixels: DataFrame, gt: str = "gt", pred: str = "pred", threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, sq, dq, pq, aji, f1, ap over instances. Above a half, matches are unique."""
    pairs = instance_pairs(pixels, gt, pred)
    n = pixels.agg(F.count_distinct(F.when(F.col(gt) > 0, F.col(gt))).alias("ng"), F.count_distinct(F.when(F.col(pred) > 0, F.col(pred))).alias("np"))
    hit = pairs.where(F.col("iou") > threshold).agg(F.count("*").alias("tp"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("sum_iou"))
    best = pairs.groupBy("g").agg(F.max_by(F.struct("p", "inter", "union"), F.struct("iou", -F.col("p"))).alias("b"))
    used = best.select(F.col("b.p").alias("p")).distinct()
    sp = pixels.where(F.col(pred) > 0).groupBy(F.col(pred).alias("p")).agg(F.count("*").alias("s"))
    sg = pixels.where(F.col(gt) > 0).groupBy(F.col(gt).alias("g")).agg(F.count("*").alias("s"))
    top = best.agg(F.coalesce(F.sum("b.inter"), F.lit(0)).alias("ai"), F.coalesce(F.sum("b.union"), F.lit(0)).alias("au"))
    rest = sp.join(used, "p", "left_anti").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("rp")).crossJoin(sg.join(best.select("g"), "g", "left_anti").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("rg")))
    row = n.crossJoin(hit).crossJoin(top).crossJoin(rest)  # one row each
    fp, fn = F.col("np") - F.col("tp"), F.col("ng") - F.col("tp")
    sq, dq = F.coalesce(F.try_divide(F.col("sum_iou"), F.col("tp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * fp + 0.5 * fn), F.lit(0.0))
    return row.select(
        "tp", fp.alias("fp"), fn.alias("fn"), sq.alias("sq"), dq.alias("dq"), (sq * dq).alias("pq"), F.coalesce(F.try_divide(F.col("ai").cast("double"), F.col("au") + F.col("rp") + F.col("rg")), F.lit(0.0)).alias("aji"),
        dq.alias("f1"), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + fp + fn), F.lit(0.0)).alias("ap"),
    )
