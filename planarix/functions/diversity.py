"""Diversity and inequality indices of an array of counts or values."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a zero counts as inside a logarithm.
SMALL = sys.float_info.min


def _sum(a: Column, f=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v.cast("double")))


def simpson_index(counts: Column) -> Column:
    """1 - sum of squared shares; null for no counts."""
    n = _sum(counts)
    return F.when(n > 0, 1.0 - _sum(counts, lambda v: F.pow(v / n, 2.0)))


def shannon_index(counts: Column) -> Column:
    """-sum p ln p over non-zero shares."""
    n = _sum(counts)
    return F.when(n > 0, F.abs(_sum(counts, lambda v: F.when(v > 0, -(v / n) * F.log(v / n)).otherwise(0.0))))


def gini_index(values: Column) -> Column:
    """Gini coefficient; raises on negative values, null for none or a zero sum."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v).cast("double")
    total = _sum(v)
    ranked = F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    bad = F.array_min(v) < 0
    return F.when(bad, F.raise_error(F.lit("gini_index needs non-negative values")).cast("double")).when((n > 0) & (total > 0), (2.0 * ranked - n * total - total) / (n * total))


def theil_index(values: Column) -> Column:
    """sum s ln(n s) with zeros as the smallest positive number."""
    v = F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.when(x == 0, F.lit(SMALL)).otherwise(x.cast("double")))
    n, total = F.size(v).cast("double"), _sum(v)
    return F.when(n > 0, _sum(v, lambda x: (x / total) * F.log(n * x / total)))


def theil_between_group(values: Column, groups: Column) -> Column:
    """Between-group share of the Theil index, from parallel arrays of values and group labels."""
    pairs = F.arrays_zip(values.alias("v"), groups.alias("g"))
    n, total = F.size(values).cast("double"), _sum(values)

    def part(g: Column) -> Column:
        mine = F.filter(pairs, lambda p: p["g"] == g)
        share = F.aggregate(mine, F.lit(0.0), lambda a, p: a + p["v"].cast("double")) / total
        share_in = F.when(share == 0, 1.0).otherwise(share)
        return share * F.log(n / F.size(mine) * share_in)

    return F.aggregate(F.transform(F.array_distinct(groups), part), F.lit(0.0), lambda a, v: a + v)


def theil_within_group(values: Column, groups: Column) -> Column:
    return theil_index(values) - theil_between_group(values, groups)


DIVERSITY_LOOKUP = {"simpson_index": simpson_index, "shannon_index": shannon_index, "gini_index": gini_index, "theil_index": theil_index}
GROUP_DIVERSITY_LOOKUP = {"theil_between_group": theil_between_group, "theil_within_group": theil_within_group}
