"""Spatial joins without pairs of everything: cells of a pyramid of grids, an upper bound, then an exact test.

``Pyramid`` fixes an origin, a finest cell and the levels above it, each of twice the cell. A point finds some place near
it in the cells around it on every level; the distance to that place bounds its nearest neighbour's. What lies within the
bound is then found through the one level whose cells are about as wide, so that each ball meets eight cells at most, and
each box stands in eight cells at most on the levels that it is needed on. Rows grow with points and boxes, not with their
product. Points and boxes are expanded into cells, which Spark does not foresee when it sizes a join: both sides are merged,
never broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "xyz"
#: Relative slack of a bound, for rounding in the distances it is compared with.
SLACK = 1e-9


@dataclass(frozen=True)
class Pyramid:
    """Where the cells lie: origin, upper corner, finest cell, and the coarsest level."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    cell: float
    top: int

    @classmethod
    def over(cls, places: DataFrame, cell: Column) -> "Pyramid | None":
        """The pyramid over ``places(x, y, z)`` with ``cell``, an aggregate, as finest cell; None if there are none."""
        box = places.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))], cell.alias("cell")).first()
        if box["lox"] is None:
            return None
        low, high = tuple(box[f"lo{a}"] for a in AXES), tuple(box[f"hi{a}"] for a in AXES)
        span = max(b - a for a, b in zip(low, high, strict=True))
        size = max(float(box["cell"] or 0.0), span * 2.0**-40, 1e-9)
        return cls(low, high, size, max(0, math.ceil(math.log2(max(span / size, 1.0)))))

    def size(self, level: Column) -> Column:
        return F.lit(self.cell) * F.pow(F.lit(2.0), level)

    def index(self, value: Column, axis: int, level: Column) -> Column:
        return F.floor((value - F.lit(self.low[axis])) / self.size(level))


def upper_reach(points: DataFrame, places: DataFrame, pyramid: Pyramid, key: str = "p", centre: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """``key, reach``: the distance from each point to some place near it.

    Each occupied cell of each level shows one place. A point looks into the eight cells around it (around its projection
    on the places' box) on every level, so it finds one on the coarsest at the latest.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(pyramid.top))).alias("level")
    at = places.select(*AXES, levels)
    cells = at.select("level", *[pyramid.index(F.col(a), i, F.col("level")).alias(f"i{a}") for i, a in enumerate(AXES)], *AXES)
    shown = cells.groupBy("level", "ix", "iy", "iz").agg(F.min(F.struct(*AXES)).alias("place"))
    asked = points.select(key, *centre, levels)
    for i, (a, c) in enumerate(zip(AXES, centre, strict=True)):
        inside = F.least(F.greatest(F.col(c), F.lit(pyramid.low[i])), F.lit(pyramid.high[i]))
        first = F.floor((inside - F.lit(pyramid.low[i])) / pyramid.size(F.col("level")) - 0.5)
        asked = asked.withColumn(f"i{a}", F.explode(F.array(first, first + 1)))
    off = [F.col(f"place.{a}") - F.col(c) for a, c in zip(AXES, centre, strict=True)]
    d2 = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    return asked.join(shown.hint("merge"), ["level", "ix", "iy", "iz"]).groupBy(key).agg(F.sqrt(F.min(d2)).alias("reach"))


def ball_pairs(points: DataFrame, boxes: DataFrame, pyramid: Pyramid, centre: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """Rows of ``points(centre, reach, ...)`` with those of ``boxes(lox, hix, loy, ..., hiz, ...)`` that come within ``reach``.

    Each pair once: in the cell that holds the lower corner of what the ball's and the box's bounds share. Few levels are
    in use (each doubles the cell), so the driver reads their numbers.
    """
    extent = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES])
    level_of = lambda width: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, F.lit(pyramid.cell)) / F.lit(pyramid.cell)))).cast("int")
    reach = F.col("reach") * (1 + SLACK)
    boxes = boxes.withColumn("_own", level_of(extent))
    points = points.withColumn("_asks", level_of(2 * reach))
    own = sorted(r[0] for r in boxes.select("_own").distinct().collect())
    asked = sorted(r[0] for r in points.select("_asks").distinct().collect())
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    stands = F.array_distinct(F.concat(F.array("_own"), F.filter(numbers(asked), lambda x: x > F.col("_own"))))
    looks = F.array_distinct(F.concat(F.array("_asks"), F.filter(numbers(own), lambda x: x > F.col("_asks"))))
    b = boxes.withColumn("_level", F.explode(stands))
    p = points.withColumn("_level", F.explode(looks))
    for i, (a, c) in enumerate(zip(AXES, centre, strict=True)):
        level = F.col("_level")
        b = b.withColumn(f"_i{a}", F.explode(F.sequence(pyramid.index(F.col(f"lo{a}"), i, level), pyramid.index(F.col(f"hi{a}"), i, level))))
        p = p.withColumn(f"_i{a}", F.explode(F.sequence(pyramid.index(F.col(c) - reach, i, level), pyramid.index(F.col(c) + reach, i, level))))
    # On a level above its own a point meets only the boxes that are on no finer one.
    j = p.join(b.hint("merge"), ["_level", "_ix", "_iy", "_iz"]).where((F.col("_level") == F.col("_asks")) | (F.col("_level") == F.col("_own")))
    d2 = F.lit(0.0)
    for i, (a, c) in enumerate(zip(AXES, centre, strict=True)):
        j = j.where(F.col(f"_i{a}") == pyramid.index(F.greatest(F.col(c) - reach, F.col(f"lo{a}")), i, F.col("_level")))
        gap = F.greatest(F.col(f"lo{a}") - F.col(c), F.col(c) - F.col(f"hi{a}"), F.lit(0.0))
        d2 = d2 + gap * gap
    return j.where(d2 <= reach * reach).drop("_own", "_asks", "_level", *[f"_i{a}" for a in AXES])
