"""Spatial joins, blocked sums, the clustered layout, tall matrices and warm starts against plain NumPy."""

import numpy as np
import pytest
from fluxmesh.operators import ensemble, mesh, metrics, solve, source, spatial, sparse, tall, warm
from fluxmesh.plans.solve_queries import RATE, _request
from fluxmesh.sources import layout, synth
from fluxmesh.sources.scratch import written
from fluxmesh.subject import Subject
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def bar(spark):
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet")
    return synth.bar_nodes(suppliers), synth.bar_tets(suppliers)


# ---- nearest triangles ------------------------------------------------------------------------------------------


def brute_closest(p, a, b, c):
    """Squared distance of a point to each triangle, by clamping to the plane and to the three edges."""
    def segment(u, v):
        t = np.clip(((p - u) * (v - u)).sum(1) / np.maximum(((v - u) ** 2).sum(1), 1e-300), 0, 1)
        return (((u + t[:, None] * (v - u)) - p) ** 2).sum(1)

    n = np.cross(b - a, c - a)
    nn = np.maximum((n * n).sum(1), 1e-300)
    foot = p - (((p - a) * n).sum(1) / nn)[:, None] * n
    inside = np.ones(len(a), bool)
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(v - u, foot - u) * n).sum(1) >= 0
    return np.minimum(np.minimum(segment(a, b), segment(b, c)), np.minimum(segment(c, a), np.where(inside, ((foot - p) ** 2).sum(1), np.inf)))


def triangles(spark, rng, n, sizes):
    low = rng.uniform(0, 100, (n, 1, 3))
    xyz = low + rng.uniform(-1, 1, (n, 3, 3)) * sizes[:, None, None]
    nodes = [(3 * i + k, *map(float, xyz[i, k])) for i in range(n) for k in range(3)]
    tris = [(i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(n)]
    return xyz, spark.createDataFrame(nodes, "node int, x double, y double, z double"), spark.createDataFrame(tris, "t int, a int, b int, c int")


@pytest.mark.parametrize("sizes", ["even", "mixed", "flat"])
def test_closest_points_equal_all_pairs(spark, sizes):
    rng = np.random.default_rng(3)
    n = 300
    size = {"even": np.full(n, 3.0), "mixed": 10 ** rng.uniform(-2, 2, n), "flat": np.full(n, 2.0)}[sizes]
    xyz, nodes, tris = triangles(spark, rng, n, size)
    at = np.vstack([rng.uniform(-5, 105, (60, 3)), rng.uniform(-400, 500, (20, 3)), xyz[:10, 0], np.array([[1e4, 1e4, 1e4]])])
    placements = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "p int, cx double, cy double, cz double")
    found = {r.p: r for r in source.closest_points(placements, nodes, tris).collect()}
    assert len(found) == len(at)
    for i, p in enumerate(at):
        d2 = brute_closest(p, xyz[:, 0], xyz[:, 1], xyz[:, 2])
        r = found[i]
        assert r.d2 == pytest.approx(d2.min(), rel=1e-9, abs=1e-9) and d2[r.t] == pytest.approx(d2.min(), rel=1e-9, abs=1e-9)
        assert ((np.array([r.qx, r.qy, r.qz]) - p) ** 2).sum() == pytest.approx(r.d2, rel=1e-9, abs=1e-9)


def test_equal_distances_take_the_lower_triangle(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0)], "node int, x double, y double, z double")
    tris = spark.createDataFrame([(7, 0, 1, 2), (4, 0, 2, 3)], "t int, a int, b int, c int")
    at = spark.createDataFrame([(1, 0.5, 0.5, 2.0), (2, 1.0, 0.0, 3.0), (3, 0.25, 0.25, 0.0)], "p int, cx double, cy double, cz double")
    assert {r.p: r.t for r in source.closest_points(at, nodes, tris).collect()} == {1: 4, 2: 7, 3: 4}
    assert source.closest_points(at, nodes, tris.limit(0)).count() == 0


def test_candidates_grow_with_points(spark):
    nodes, tets = bar(spark)
    tris = mesh.skin_triangles(nodes, tets)
    surface = source.surface_corners(nodes, tris)
    ends = [F.array(*[F.col(f"{n}{x}") for n in ("a", "b", "k3")]) for x in "xyz"]
    boxes = surface.select("t", *[F.col(f"a{x}").alias(x) for x in "xyz"], *[f(e).alias(f"{n}{x}") for e, x in zip(ends, "xyz", strict=True) for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    pyramid = spatial.Pyramid.over(boxes, F.lit(25.0))
    points = synth.bar_placements(spark.read.parquet(f"{SF}/customer.parquet")).select("p", "cx", "cy", "cz")
    pairs = spatial.ball_pairs(points.join(spatial.upper_reach(points, boxes, pyramid), "p"), boxes, pyramid)
    n, m = points.count(), tris.count()
    assert pairs.count() == pairs.select("p", "t").distinct().count() < 25 * n < n * m / 10


def test_targets_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    at = np.vstack([rng.uniform(0, 50, (400, 3)), [[10.0, 10, 10], [10.0, 10, 14]]])
    vol = rng.uniform(0.5, 2, len(at))
    elements = spark.createDataFrame([(i, float(v), *map(float, x)) for i, (v, x) in enumerate(zip(vol, at, strict=True))], "e int, vol double, bx double, by double, bz double")
    aims = np.vstack([rng.uniform(-10, 60, (30, 3)), [[10.0, 10, 12]], rng.uniform(200, 900, (5, 3))])
    radius = rng.choice([0.0, -1.0, 0.001, 4.0, 15.0], len(aims))
    radius[30] = 1e-3
    targets = spark.createDataFrame([(f"n{i}", *map(float, x), float(r)) for i, (x, r) in enumerate(zip(aims, radius, strict=True))], "name string, tx double, ty double, tz double, radius double")
    got = {}
    for r in metrics.resolve_targets(elements, targets).collect():
        got.setdefault(r.name, {})[r.e] = r.w
    for i, (x, r) in enumerate(zip(aims, radius, strict=True)):
        off = x - at
        d2 = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]
        pick = [int(np.argmin(d2))] if r <= 0 else (np.flatnonzero(d2 <= r * r) if (d2 <= r * r).any() else np.flatnonzero(d2 == d2.min()))
        assert set(got[f"n{i}"]) == set(map(int, pick)), i
        assert all(got[f"n{i}"][int(e)] == pytest.approx(vol[e] / vol[pick].sum()) for e in pick)
    assert len(got["n30"]) == 2
    assert metrics.resolve_targets(elements.limit(0), targets).count() == 0


# ---- blocked sums -----------------------------------------------------------------------------------------------


def test_blocked_field_equals_broadcast(spark, monkeypatch):
    nodes, _ = bar(spark)
    part = spark.read.parquet(f"{SF}/part.parquet")
    dipoles = synth.dipoles_of(part, "p_partkey", "p_size").withColumn("g", F.col("j") % 3).withColumn("sz", F.lit(0.2))
    dipoles = dipoles.unionByName(dipoles.limit(7))  # repeated rows count
    want = {(r.g, r.node): r for r in source.dipole_field(nodes, dipoles, 1e6, ("g",)).collect()}
    monkeypatch.setattr(source, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(source, "BLOCK_ROWS", 40)
    plan = source.dipole_field(nodes, dipoles, 1e6, ("g",))
    got = plan.collect()
    assert len(got) == len(want) > 0
    for r in got:
        assert np.allclose([r.ax, r.ay, r.az], [want[r.g, r.node][c] for c in ("ax", "ay", "az")], rtol=1e-9, atol=1e-12)
    text = plan._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


# ---- layout -----------------------------------------------------------------------------------------------------


def test_reordering_keeps_the_mesh(spark):
    nodes, tets = bar(spark)
    tris = mesh.skin_triangles(nodes, tets)
    n2, t2, s2 = mesh.reordered(nodes, tets, tris)
    xyz = {r.node: (r.x, r.y, r.z) for r in nodes.collect()}
    new = {r.node: (r.x, r.y, r.z) for r in n2.collect()}
    assert sorted(new) == list(range(len(xyz))) and sorted(new.values()) == sorted(xyz.values())
    old_rows = sorted(([xyz[r[n]] for n in mesh.LOCAL], r.tag) for r in tets.collect())
    rows = t2.orderBy("e").collect()
    assert sorted(([new[r[n]] for n in mesh.LOCAL], r.tag) for r in rows) == old_rows
    lowest = [min(r[n] for n in mesh.LOCAL) for r in rows]
    assert [r.e for r in rows] == list(range(len(rows))) and lowest == sorted(lowest)
    keys = {r.node: r.key for r in mesh.morton_keys(n2).collect()}
    assert [keys[i] for i in range(len(keys))] == sorted(keys.values())
    old = {r.t: [xyz[r[c]] for c in "abc"] for r in tris.collect()}
    assert {r.t: [new[r[c]] for c in "abc"] for r in s2.collect()} == old


def test_region_reads_skip_folders(spark, tmp_path):
    nodes, tets = bar(spark)
    path = f"file://{tmp_path}/layout"
    layout.write_layout(nodes, tets, mesh.skin_triangles(nodes, tets), path, 16)
    whole = spark.read.parquet(f"{path}/tets")
    assert whole.count() == tets.count() and spark.read.parquet(f"{path}/tris").count() == mesh.skin_triangles(nodes, tets).count()
    box = (40.0, 10.0, 10.0), (80.0, 60.0, 90.0)
    got = layout.read_region(spark, path, *box)
    inside = [r for r in whole.collect() if all(lo <= v <= hi for lo, v, hi in zip(box[0], (r.bx, r.by, r.bz), box[1], strict=True))]
    assert {r.e for r in got.collect()} == {r.e for r in inside} and len(inside) > 20
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numFiles").value() < whole.select("block").distinct().count()
    points = spark.createDataFrame([(1, 50.0, 50.0, 50.0), (2, 52.0, 50.0, 50.0), (3, 9e5, 0.0, 0.0)], "p int, cx double, cy double, cz double")
    near = layout.elements_near(spark, path, points, 21.0)
    want = {(p, r.e) for r in whole.collect() for p, x in ((1, 50.0), (2, 52.0)) if (r.bx - x) ** 2 + (r.by - 50) ** 2 + (r.bz - 50) ** 2 <= 441}
    assert {(r.p, r.e) for r in near.collect()} == want and want
    assert near.groupBy("p", "e").count().where("count > 1").count() == 0


# ---- tall matrices ----------------------------------------------------------------------------------------------


def test_factors_and_bases_equal_dense_algebra(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(3000, 5)) @ np.diag([1, 1e-2, 1e-4, 1e-6, 1.0])
    a[:, 4] = a[:, 0] * 2 - a[:, 1]  # a direction less
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], "id int, a double, b double, c double, d double, e double").repartition(40)
    names = list("abcde")
    r = tall.factor(rows, names)
    assert np.allclose(r, np.triu(r)) and np.allclose(r.T @ r, a.T @ a, rtol=1e-10, atol=1e-10)
    q, s = tall.dominant_basis(rows, names, ["id"], rtol=1e-8)
    assert np.allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-9, atol=1e-12)
    kept = [c for c in q.columns if c.startswith("q")]
    assert len(kept) == 4
    m = np.array([[row[c] for c in kept] for row in q.orderBy("id").collect()])
    assert np.abs(m.T @ m - np.eye(4)).max() < 1e-10
    u = np.linalg.svd(a, full_matrices=False)[0][:, :4]
    assert np.abs(m @ (m.T @ u) - u).max() < 1e-6


def test_factors_of_groups_and_of_few_rows(spark):
    rng = np.random.default_rng(2)
    data = {g: rng.normal(size=(n, 3)) for g, n in (("x", 1), ("y", 2), ("z", 500))}
    rows = spark.createDataFrame([(g, *map(float, x)) for g, m in data.items() for x in m], "g string, a double, b double, c double").repartition(9)
    found = {}
    for r in tall.tall_factors(rows, ["a", "b", "c"], ("g",)).collect():
        found.setdefault(r.g, {})[r.i] = r.r
    for g, m in data.items():
        r = np.array([found[g][i] for i in range(3)])
        assert np.allclose(r.T @ r, m.T @ m)
    assert np.array_equal(tall.factor(rows.limit(0), ["a"]), np.zeros((1, 1)))
    q, s = tall.dominant_basis(rows.select((F.col("a") * 0).alias("a")), ["a"], [])
    assert q.columns == [] and s.tolist() == [0.0]
    with pytest.raises(ValueError):
        tall.tall_factors(rows, [])


# ---- warm starts ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def request_parts(spark):
    s = Subject(synth.cube_nodes(spark, 3), synth.cube_tets(spark, 3))
    _, placements, dipoles = _request(spark, SF)
    placements = placements.where("p < 2")
    nodal = s.nodal_source(source.place_dipoles(s.frames(placements), dipoles), RATE)
    elements = sparse.element_means(nodal, s.corners, ["ax", "ay", "az"], ("p",))
    unit = written(sparse.rhs(s.corners.withColumn("sigma", F.lit(1.0)), elements, ("p", "tag")), "unit")
    return s, placements, dipoles, unit


def drawn(s, n):
    return ensemble.draws(s.tissues.where("tag in (2, 3)"), n, 7)


def test_starts_do_not_depend_on_the_ensemble(spark, request_parts):
    s, _, _, unit = request_parts
    few = {(r.p, r.k, r.node): r.x0 for r in s.draw_starts(unit, drawn(s, 3)).collect()}
    more = {(r.p, r.k, r.node): r.x0 for r in s.draw_starts(unit, drawn(s, 12)).where("k < 3").collect()}
    assert few.keys() == more.keys() and len(few) == 2 * 3 * (4**3 - 1)
    top = max(map(abs, few.values()))
    assert max(abs(few[k] - more[k]) for k in few) <= 1e-9 * top


def test_starts_are_galerkin_projections(spark, request_parts):
    """``W' A (x0 - x) = W' r`` for the nominal matrix, and x0 is nearer to a draw's solution than the nominal one."""
    s, _, _, unit = request_parts
    csr = s.csr(by_tag=True)
    dense = {}
    for tag, v in zip(csr.tags, csr.values, strict=True):
        m = np.zeros((len(csr.nodes),) * 2)
        for i in range(len(csr.nodes)):
            m[i, csr.idx[csr.ptr[i] : csr.ptr[i + 1]]] = v[csr.ptr[i] : csr.ptr[i + 1]]
        dense[tag] = m
    at = {n: i for i, n in enumerate(csr.nodes.tolist())}
    b = {}
    for r in unit.collect():
        if r.node in at:
            b.setdefault((r.p, r.tag), np.zeros(len(at)))[at[r.node]] += r.b
    nominal = {r.tag: r.sigma for r in s.tissues.collect()}
    sig = {}
    for r in drawn(s, 3).collect():
        sig.setdefault(r.k, {})[r.tag] = r.sigma
    got = {}
    for r in s.draw_starts(unit, drawn(s, 3)).collect():
        got.setdefault((r.p, r.k), np.zeros(len(at)))[at[r.node]] = r.x0
    a = sum(nominal[t] * m for t, m in dense.items())
    for (p, k), x0 in got.items():
        x = np.linalg.solve(a, sum(nominal[t] * b[p, t] for t in dense))
        parts = {t: b[p, t] - dense[t] @ x for t in dense}
        w = np.linalg.qr(np.stack([np.linalg.solve(a, parts[t]) for t in dense], 1))[0][:, :1]  # two tissues share one direction
        r0 = sum(sig[k][t] * parts[t] for t in dense)
        want = x + w @ np.linalg.solve(w.T @ a @ w, w.T @ r0)
        exact = np.linalg.solve(sum(sig[k][t] * m for t, m in dense.items()), sum(sig[k][t] * b[p, t] for t in dense))
        assert np.linalg.norm(x0 - want) <= 1e-2 * np.linalg.norm(x - exact) + 1e-4 * np.linalg.norm(x)
        assert np.linalg.norm(x0 - exact) < np.linalg.norm(x - exact)


def test_warm_solves_agree_with_cold_ones(spark, request_parts):
    s, placements, dipoles, unit = request_parts
    cold, hot = (s.simulate_conductivity_uq(placements, dipoles, RATE, n=2, seed=7, warm_start=w).select("p", "k", "e", F.col("magn").alias(f"m{int(w)}")) for w in (False, True))
    j = cold.join(hot, ["p", "k", "e"])
    top = j.agg(F.max("m0")).first()[0]
    assert j.count() == 2 * 2 * 162 and j.where(F.abs(F.col("m0") - F.col("m1")) > 1e-4 * top).count() == 0
    sigmas = drawn(s, 4)
    maps = sigmas.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("tag", "sigma"))).alias("sigmas"))
    b = ensemble.combine(unit, sigmas, ("p", "node"), "b").join(maps, "k")
    b = written(b.join(s.draw_starts(unit, sigmas), ["p", "k", "node"], "left"), "b")
    steps = [solve.solve(s.csr(by_tag=True), b, ["p", "k"], sigmas="sigmas", start=x).agg(F.sum("iterations")).first()[0] for x in (None, "x0")]
    assert steps[1] < steps[0]


def test_empty_basis(spark):
    none = spark.createDataFrame([(1, t, n, 0.0) for t in (2, 3) for n in range(4)], "p int, tag int, node int, v double")
    assert warm.orthonormal(none, [2, 3]).count() == 0
