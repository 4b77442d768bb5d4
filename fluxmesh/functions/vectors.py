"""Column expressions for 3-vectors: tuples of three columns, so plans stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(prefix + n) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """``a`` at length one; the zero vector stays zero."""
    n = norm(a)
    return tuple(F.when(n > 0, p / n).otherwise(F.lit(0.0)) for p in a)


def named(a: Vec, prefix: str = "", names: str = "xyz") -> list[Column]:
    return [p.alias(prefix + n) for p, n in zip(a, names, strict=True)]


def closest_on_triangle(rows: DataFrame, p: Vec, a: Vec, b: Vec, c: Vec, keep: list[str]) -> DataFrame:
    """``keep`` and the barycentric weights ``wb``, ``wc`` of the triangle's point nearest to ``p``: the seven regions
    of the plane in the order corner a, corner b, edge ab, corner c, edge ac, edge bc, inside.

    The products are columns of their own, so that generated code computes each once.
    """
    ab, ac = sub(b, a), sub(c, a)
    ends = [dot(e, q) for q in (sub(p, a), sub(p, b), sub(p, c)) for e in (ab, ac)]
    r = rows.select(*keep, *[d.alias(f"d{i}") for i, d in enumerate(ends, 1)])
    d1, d2, d3, d4, d5, d6 = (F.col(f"d{i}") for i in range(1, 7))
    r = r.select("*", (d1 * d4 - d3 * d2).alias("vc"), (d5 * d2 - d1 * d6).alias("vb"), (d3 * d6 - d5 * d4).alias("va"))
    va, vb, vc = F.col("va"), F.col("vb"), F.col("vc")
    region = F.lit(7)
    tests = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)]
    for k in range(6, 0, -1):
        region = F.when(tests[k - 1], k).otherwise(region)
    r = r.select("*", region.alias("region"), F.try_divide(d4 - d3, (d4 - d3) + (d5 - d6)).alias("t_bc"))
    at = F.col("region")
    wb = F.when(at == 2, 1.0).when(at == 3, F.try_divide(d1, d1 - d3)).when(at == 6, 1.0 - F.col("t_bc")).when(at == 7, F.try_divide(vb, va + vb + vc)).otherwise(0.0)
    wc = F.when(at == 4, 1.0).when(at == 5, F.try_divide(d2, d2 - d6)).when(at == 6, F.col("t_bc")).when(at == 7, F.try_divide(vc, va + vb + vc)).otherwise(0.0)
    return r.select(*keep, wb.alias("wb"), wc.alias("wc"))
