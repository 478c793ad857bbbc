"""Line metrics as expressions over a line's vertices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planarix.functions import geometry as G


def chord(geom: Column) -> Column:
    """First to last vertex."""
    r = geom["rings"][0]
    a, b = r[0], F.element_at(r, -1)
    return F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))


def tortuosity(geom: Column) -> Column:
    """Length over chord; null where the chord is 0."""
    c = chord(geom)
    return F.when(c > 0, G.length(geom) / c)


def average_turning_angle(geom: Column) -> Column:
    """Mean absolute change of heading in degrees, folded at 180; null below three vertices."""
    r = geom["rings"][0]
    n = F.size(r)
    at = lambda i: F.element_at(r, i)
    heading = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.atan2(at(i + 1)["y"] - at(i)["y"], at(i + 1)["x"] - at(i)["x"]))

    def turn(i: Column) -> Column:
        d = F.abs(F.element_at(heading, i + 1) - F.element_at(heading, i))
        return F.degrees(F.when(d > math.pi, 2 * math.pi - d).otherwise(d))

    turns = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), turn)
    total = F.aggregate(turns, F.lit(0.0), lambda a, v: a + v)
    return F.when(n >= 3, total / (n - 2))
