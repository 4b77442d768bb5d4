"""Placement search by reciprocity: a grid of adjoint values, trilinear interpolation, and angles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxmesh.functions.vectors import dot, vec
from fluxmesh.sources.scratch import written


def grid_shape(points: DataFrame, spacing: float, margin: float) -> dict:
    """Origin and counts of the grid that covers ``points(x, y, z)`` with a margin: one row is read."""
    box = points.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {"h": spacing}
    for a in "xyz":
        lo, hi = box[f"lo{a}"] - margin, box[f"hi{a}"] + margin
        out[f"o{a}"], out[f"n{a}"] = lo, math.ceil((hi - lo) / spacing) + 1
    return out


def max_index(grid: dict) -> tuple[int, int, int]:
    """The largest valid index along each axis."""
    return tuple(int(grid[f"n{a}"]) - 1 for a in "xyz")


def upper(grid: dict) -> tuple[float, float, float]:
    """The place of the last grid point along each axis."""
    return tuple(float(grid[f"o{a}"]) + float(grid["h"]) * n for a, n in zip("xyz", max_index(grid), strict=True))


def center(grid: dict) -> tuple[float, float, float]:
    return tuple(0.5 * (float(grid[f"o{a}"]) + u) for a, u in zip("xyz", upper(grid), strict=True))


def grid_points(spark, grid: dict) -> DataFrame:
    """``ix, iy, iz, x, y, z`` with z running fastest."""
    nx, ny, nz = grid["nx"], grid["ny"], grid["nz"]
    i = F.col("id")
    idx = {"x": F.floor(i / (ny * nz)), "y": F.floor(i / nz) % ny, "z": i % nz}
    rows = spark.range(nx * ny * nz).select(*[idx[a].cast("int").alias(f"i{a}") for a in "xyz"])
    return rows.select("ix", "iy", "iz", *[(F.lit(float(grid[f"o{a}"])) + F.col(f"i{a}") * float(grid["h"])).alias(a) for a in "xyz"])


def world_to_index(samples: DataFrame, grid: dict) -> DataFrame:
    """``samples`` with fractional grid coordinates ``ux, uy, uz``."""
    return samples.select("*", *[((F.col(a) - F.lit(float(grid[f"o{a}"]))) / float(grid["h"])).alias(f"u{a}") for a in "xyz"])


def require_inside(samples: DataFrame, grid: dict, key: str, tolerance: float = 1e-6) -> DataFrame:
    """Raise for a sample outside the grid (or not a number), naming it and the axis; never clamp."""
    indexed = world_to_index(samples, grid)
    outside = F.lit(None).cast("string")
    for a in "zyx":
        u = F.col(f"u{a}")
        outside = F.when(u.isNull() | F.isnan(u) | (u < -tolerance) | (u > grid[f"n{a}"] - 1 + tolerance), a).otherwise(outside)
    bad = indexed.select(key, outside.alias("axis")).where("axis is not null").agg(F.min(F.struct(key, "axis")).alias("first")).first()["first"]
    if bad:
        raise ValueError(f"sample {bad[0]} lies outside the grid along {bad[1]}")
    return indexed


def trilinear(samples: DataFrame, grid: dict, values: DataFrame, keys: list[str], columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Values at each sample from its cell's eight grid points, joined by index; ``by`` are group columns of ``values``."""
    s = world_to_index(samples, grid)
    for a in "xyz":
        top = F.lit(max(grid[f"n{a}"] - 2, 0))
        s = s.withColumn(f"c{a}", F.greatest(F.least(F.floor(f"u{a}"), top), F.lit(0)).cast("int"))
    corner = F.explode(F.array(*[F.struct(*[F.lit(k >> b & 1).alias(f"d{a}") for b, a in enumerate("zyx")]) for k in range(8)])).alias("q")
    s = s.select("*", corner)
    weight = F.lit(1.0)
    for a in "xyz":
        f = F.col(f"u{a}") - F.col(f"c{a}")
        weight = weight * F.when(F.col(f"q.d{a}") == 1, f).otherwise(1.0 - f)
    s = s.select(*keys, *[(F.col(f"c{a}") + F.col(f"q.d{a}")).alias(f"i{a}") for a in "xyz"], weight.alias("w"))
    # Sorted and spilled, whatever sizes are estimated: Spark takes the exploded samples for as small as their rows.
    return s.join(values.hint("merge"), ["ix", "iy", "iz"]).groupBy(*keys, *by).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


#: Cells along an edge of a tile. A tile also holds the first layer of the next ones.
TILE = 8


def _extent(grid: dict, axis: str) -> Column:
    """Grid points along an edge of the tile: fewer at the grid's end."""
    return F.least(F.lit(TILE), F.lit(max_index(grid)["xyz".index(axis)]) - F.col(f"t{axis}") * TILE) + 1


def tiled(values: DataFrame, grid: dict, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, tx, ty, tz`` and an array of each of ``columns``: grid values as tiles with one layer of overlap, z fastest.

    Every cell of the grid lies in one tile with all its corners. A grid that lacks a point or has one twice raises.
    """
    rows = values.select(*by, "ix", "iy", "iz", *columns)
    for a in "xyz":
        i, last = F.col(f"i{a}"), max_index(grid)["xyz".index(a)]
        own = F.floor(i / TILE).cast("int")
        # A layer that begins a tile also ends the one before; the grid's last layer begins none.
        first = F.when((i == last) & (i % TILE == 0) & (i > 0), None).otherwise(own)
        rows = rows.withColumn(f"t{a}", F.explode(F.array_compact(F.array(first, F.when((i % TILE == 0) & (i > 0), own - 1)))))
    place = F.lit(0)
    for a in "xyz":
        place = place * _extent(grid, a) + (F.col(f"i{a}") - F.col(f"t{a}") * TILE)
    size = _extent(grid, "x") * _extent(grid, "y") * _extent(grid, "z")
    keys = [*by, "tx", "ty", "tz"]
    tiles = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(place.cast("int").alias("at"), *columns))).alias("_v"), F.count_distinct(place).alias("_n"))
    whole = (F.size("_v") == size) & (F.col("_n") == size)
    return tiles.select(*keys, *[F.when(whole, F.col(f"_v.{c}")).otherwise(F.raise_error(F.lit("the grid's values are not whole"))).alias(c) for c in columns])


def trilinear_tiled(samples: DataFrame, grid: dict, tiles: DataFrame, keys: list[str], columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``trilinear`` from the one tile of each sample: a join row for a sample and ``by``, no sum to shuffle."""
    s = world_to_index(samples, grid)
    for a in "xyz":
        last = max_index(grid)["xyz".index(a)]
        cell = F.greatest(F.least(F.floor(f"u{a}"), F.lit(max(last - 1, 0))), F.lit(0)).cast("int")
        s = s.withColumn(f"_c{a}", cell).withColumn(f"t{a}", F.floor(F.col(f"_c{a}") / TILE).cast("int"))
        s = s.withColumn(f"_f{a}", F.col(f"u{a}") - F.col(f"_c{a}")).withColumn(f"_l{a}", F.col(f"_c{a}") - F.col(f"t{a}") * TILE)
    # Places in the tile's arrays: the lowest corner, and the steps to the next along each axis (none on an axis of one point).
    ey, ez = _extent(grid, "y"), _extent(grid, "z")
    stride = {"x": ey * ez, "y": ez, "z": F.lit(1)}
    step = {a: stride[a] if max_index(grid)["xyz".index(a)] else F.lit(0) for a in "xyz"}
    base = sum((F.col(f"_l{a}") * stride[a] for a in "xyz"), F.lit(0))
    s = s.select(*keys, "tx", "ty", "tz", base.cast("int").alias("_base"), *[step[a].cast("int").alias(f"_s{a}") for a in "xyz"], *[f"_f{a}" for a in "xyz"])
    held = tiles.select(*by, "tx", "ty", "tz", *[F.col(c).alias(f"_v_{c}") for c in columns])
    met = s.join(held, ["tx", "ty", "tz"])
    corners = []
    for k in range(8):
        weight, place = F.lit(1.0), F.col("_base")
        for bit, a in zip((4, 2, 1), "xyz", strict=True):
            weight = weight * (F.col(f"_f{a}") if k & bit else 1.0 - F.col(f"_f{a}"))
            place = place + F.col(f"_s{a}") if k & bit else place
        corners.append((weight, place))
    return met.select(*keys, *by, *[sum((w * F.get(f"_v_{c}", i) for w, i in corners), F.lit(0.0)).alias(c) for c in columns])


def reciprocity(dipoles: DataFrame, grid: dict, q: DataFrame, rate: float, by: tuple[str, ...] = ("p",)) -> DataFrame:
    """``p, d, e``: ``rate * sum over dipoles of m . Q_d(s)``; dipole positions in mm as x, y, z.

    A dipole outside the grid raises: its value would be extrapolated.
    """
    require_inside(dipoles, grid, "j")
    field = ["qx", "qy", "qz"]
    # Written, so that their size is known: samples are not shuffled to meet a few tiles.
    tiles = written(tiled(q, grid, field, ("d",)), "tiles")
    at = trilinear_tiled(dipoles, grid, tiles, [*by, "j", "mx", "my", "mz"], field, ("d",))
    return at.groupBy(*by, "d").agg((F.lit(float(rate)) * F.sum(dot(vec("m"), vec("q")))).alias("e"))


def magnitude_or_component(e: DataFrame, by: tuple[str, ...], free: bool) -> DataFrame:
    """``objective``: the norm over three directions, or the one direction's value."""
    value = F.sqrt(F.sum(F.col("e") * F.col("e"))) if free else F.sum("e")
    return e.groupBy(*by).agg(value.alias("objective"))


def dirichlet(samples: DataFrame, by: list[str], n_samples: int, n_angles: int, angle_index: str = "s", value: str = "e") -> DataFrame:
    """Periodic interpolation of ``n_samples`` (odd) equal angles at ``n_angles``: ``a, theta`` and the value."""
    if n_samples % 2 == 0:
        raise ValueError("an odd number of samples is needed")
    spark = samples.sparkSession
    angles = spark.range(n_angles).select(F.col("id").cast("int").alias("a"), (F.col("id") * (2 * math.pi / n_angles)).alias("theta"))
    # Dealt before they are multiplied: the sums of a group then meet in its task and none of them is shuffled.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = (samples.repartition(tasks, *by) if by else samples).crossJoin(F.broadcast(angles))
    off = F.col("theta") - F.col(angle_index) * (2 * math.pi / n_samples)
    kernel: Column = F.lit(1.0)
    for h in range(1, (n_samples - 1) // 2 + 1):
        kernel = kernel + 2.0 * F.cos(h * off)
    return j.groupBy(*by, "a", "theta").agg(F.sum(F.col(value) * kernel / n_samples).alias(value))


def best_angle(profile: DataFrame, by: list[str], n_angles: int, value: str = "e") -> DataFrame:
    """The first largest angle, refined by the parabola through its periodic neighbours, half a step at most."""
    best = profile.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), "a")).alias("m")).select(*by, F.col("m.a").alias("a0"), (-F.col("m.v")).alias("f0"))
    step = profile.select(*by, F.col("a"), F.col(value).alias("f"))
    lo = step.select(*by, F.pmod(F.col("a") + 1, F.lit(n_angles)).alias("a0"), F.col("f").alias("f_lo"))
    hi = step.select(*by, F.pmod(F.col("a") - 1, F.lit(n_angles)).alias("a0"), F.col("f").alias("f_hi"))
    r = best.join(lo, [*by, "a0"]).join(hi, [*by, "a0"])
    bend = F.col("f_lo") - 2 * F.col("f0") + F.col("f_hi")
    delta = F.when(bend < 0, F.greatest(F.least(0.5 * (F.col("f_lo") - F.col("f_hi")) / bend, F.lit(0.5)), F.lit(-0.5))).otherwise(F.lit(0.0))
    return r.select(*by, "a0", "f0", ((F.col("a0") + delta) * (2 * math.pi / n_angles)).alias("theta"))


def best_placement(objectives: DataFrame, key: str = "p", value: str = "objective") -> DataFrame:
    """One row: the largest objective, the first of equals."""
    best = objectives.agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("m"))
    return best.select(F.col("m.k").alias(key), (-F.col("m.v")).alias(value))


def ranked(objectives: DataFrame, key: str = "p", value: str = "objective") -> DataFrame:
    return objectives.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)))
