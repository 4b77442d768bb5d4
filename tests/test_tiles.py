"""Tiles of a grid against NumPy, at all edges of grid and tiles."""

import numpy as np
import pytest
from fluxmesh.operators import search
from pyspark.sql import functions as F


def grid_of(n):
    return {"h": 2.0, "ox": -1.0, "oy": 3.0, "oz": 0.5, "nx": n[0], "ny": n[1], "nz": n[2]}


def values_of(spark, grid):
    k = F.col("ix") * 3 + F.col("iy") * 5 + F.col("iz") * 7
    return search.grid_points(spark, grid).select("ix", "iy", "iz", (k * k % 31).cast("double").alias("q"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("q", F.col("q") + 100 * F.col("d"))


@pytest.mark.parametrize("n", [(9, 10, 18), (2, 17, 8), (1, 3, 16)])
def test_tiles_give_the_interpolated_values(spark, n):
    grid, rng = grid_of(n), np.random.default_rng(5)
    u = np.vstack([rng.random((300, 3)) * (np.array(n) - 1), [np.zeros(3), np.array(n) - 1.0], np.minimum(rng.integers(0, 18, (60, 3)), np.array(n) - 1)])
    xyz = u * 2.0 + [-1.0, 3.0, 0.5]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "i int, x double, y double, z double")
    tiles = search.tiled(values_of(spark, grid), grid, ["q"], ("d",))
    got = {(r.i, r.d): r.q for r in search.trilinear_tiled(points, grid, tiles, ["i"], ["q"], ("d",)).collect()}
    assert len(got) == 2 * len(u)
    ix = np.stack(np.meshgrid(*[np.arange(k) for k in n], indexing="ij"), -1)
    cube = ((ix * [3, 5, 7]).sum(-1) ** 2 % 31).astype(float)
    for i, p in enumerate(u):
        c = np.clip(np.floor(p), 0, np.maximum(np.array(n) - 2, 0)).astype(int)
        f, want = p - c, 0.0
        for corner in np.ndindex(2, 2, 2):
            at = np.minimum(c + corner, np.array(n) - 1)
            want += np.prod(np.where(corner, f, 1 - f)) * cube[tuple(at)]
        assert np.isclose(got[i, 0], want) and np.isclose(got[i, 1], want + 100)


def test_each_cell_lies_in_one_tile(spark):
    grid = grid_of((9, 10, 18))
    rows = search.tiled(values_of(spark, grid), grid, ["q"], ("d",)).where("d = 0").collect()
    assert sorted((r.tx, r.ty, r.tz, len(r.q)) for r in rows) == [(0, y, z, 9 * (9 if y == 0 else 2) * (9 if z < 2 else 2)) for y in range(2) for z in range(3)]


def test_a_grid_with_a_hole_or_a_repeated_point_raises(spark):
    grid = grid_of((3, 3, 3))
    v = values_of(spark, grid)
    for bad in (v.where("not (ix = 1 and iy = 1 and iz = 1)"), v.where("not (ix = 1 and iy = 1 and iz = 1)").unionByName(v.where("ix = 0 and iy = 0 and iz = 0"))):
        with pytest.raises(Exception, match="not whole"):
            search.tiled(bad, grid, ["q"], ("d",)).collect()
    assert search.tiled(v.limit(0), grid, ["q"], ("d",)).count() == 0


def test_corners_of_a_grid():
    grid = grid_of((9, 10, 18))
    assert search.max_index(grid) == (8, 9, 17)
    assert search.upper(grid) == (15.0, 21.0, 34.5) and search.center(grid) == (7.0, 12.0, 17.5)
