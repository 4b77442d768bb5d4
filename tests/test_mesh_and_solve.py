import numpy as np
import pytest
from fluxmesh.model import tissue_table
from fluxmesh.operators import mesh, recovery, search, solve, source, sparse
from fluxmesh.sources import synth
from fluxmesh.subject import Subject
from pyspark.sql import functions as F

N = 3


@pytest.fixture(scope="module")
def subject(spark):
    s = Subject(synth.cube_nodes(spark, N), synth.cube_tets(spark, N))
    yield s
    s.free()


@pytest.fixture(scope="module")
def request_tables(spark):
    placements = spark.createDataFrame([(0, 50.0, 50.0, 101.0, 50.0, 90.0, 100.0, 4.0), (1, 30.0, 60.0, 102.0, 70.0, 60.0, 100.0, 4.0)], "p int, cx double, cy double, cz double, hx double, hy double, hz double, dist double")
    dipoles = spark.createDataFrame([(0, -0.02, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 0.02, 0.0, 0.0, 0.0, 0.0, -1.0)], "j int, sx double, sy double, sz double, mx double, my double, mz double")
    return placements, dipoles


def dense(rows, n):
    k = np.zeros((n, n))
    for r in rows:
        k[r.r, r.c] = r.v
    return k


def test_geometry(subject):
    assert np.isclose(subject.grads.agg(F.sum("vol")).first()[0], 1e-3)
    zero = subject.grads.select(*[F.max(F.abs(F.col(f"g0{a}") + F.col(f"g1{a}") + F.col(f"g2{a}") + F.col(f"g3{a}"))).alias(a) for a in "xyz"]).first()
    assert max(zero) < 1e-9
    assert subject.tris.count() == 12 * N * N
    n = subject.normals.select((F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2).alias("s")).toPandas().s
    assert np.allclose(n, 1)


def test_stiffness_is_symmetric_with_zero_rows(subject):
    n = (N + 1) ** 3
    k = dense(sparse.stiffness(subject.corners).collect(), n)
    assert np.allclose(k, k.T, atol=1e-12) and np.abs(k.sum(1)).max() < 1e-12
    a = {(r.r, r.c): r.v for r in sparse.stiffness(subject.corners.repartition(3), deterministic=True).collect()}
    b = {(r.r, r.c): r.v for r in sparse.stiffness(subject.corners.repartition(7, "e"), deterministic=True).collect()}
    assert a == b


def test_solutions_equal_dense_algebra(spark, subject):
    csr = subject.csr()
    m = len(csr.nodes)
    k = np.zeros((m, m))
    k[np.repeat(np.arange(m), np.diff(csr.ptr)), csr.idx] = csr.combined()
    rng = np.random.default_rng(0)
    b = rng.normal(size=m)
    for two in (None, solve.Hierarchy(csr.ptr, csr.idx, csr.combined(), coarsest=20)):
        x, its, rel = solve.pcg(csr.ptr, csr.idx, csr.combined(), b, 1e-10, 2000, None, two)
        assert np.allclose(k @ x, b, atol=1e-8) and rel <= 1e-10 and its > 1
    assert solve.pcg(csr.ptr, csr.idx, csr.combined(), 0 * b)[1:] == (0, 0.0)
    with pytest.raises(solve.SolverConvergenceError):
        solve.solve_or_raise(csr.ptr, csr.idx, csr.combined(), b, 1e-30, 3)
    rhs = spark.createDataFrame([(p, int(n), float(v * (p + 1))) for p in range(2) for n, v in zip(csr.nodes, b, strict=True)], "p int, node int, b double")
    out = solve.solve(csr, rhs, ["p"], 1e-10).toPandas()
    one, twice = (out[out.p == p].sort_values("node").v.to_numpy() for p in range(2))
    assert np.allclose(2 * one, twice, rtol=1e-6) and np.allclose(k @ one, b, atol=1e-7)


def test_dipole_field_of_one_dipole(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 100.0), (1, 100.0, 0.0, 0.0)], "node int, x double, y double, z double")
    d = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0)], "j int, sx double, sy double, sz double, mx double, my double, mz double")
    got = {r.node: (r.ax, r.ay, r.az) for r in source.dipole_field(nodes, d, 3.0).collect()}
    assert np.allclose(got[0], 0) and np.allclose(got[1], (0, 3e-7 * 2 / 0.01, 0))


def test_frames_are_orthonormal_and_bad_handles_raise(spark, subject, request_tables):
    placements, _ = request_tables
    for r in subject.frames(placements).collect():
        m = np.array([[r[f"r{i}{k}"] for k in range(3)] for i in range(3)])
        assert np.allclose(m.T @ m, np.eye(3)) and np.isclose(np.linalg.det(m), 1)
    with pytest.raises(ValueError, match="normal"):
        source.require_frames(spark.createDataFrame([(3, True)], "p int, degenerate boolean"))
    for bad in (placements.withColumn("cx", F.lit(float("nan"))), placements.withColumn("hx", F.col("cx")).withColumn("hy", F.col("cy")).withColumn("hz", F.col("cz"))):
        with pytest.raises(ValueError):
            subject.frames(bad)


def test_recovery_reproduces_linear_and_harmonic_fields(subject):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(12, 3))
    w = recovery.spr_fit(pts)
    assert np.isclose(w.sum(), 1) and np.abs(w @ pts).max() < 1e-9
    assert recovery.spr_fit(pts[:3]) is None and recovery.spr_fit(np.zeros((6, 3))) is None
    pts = rng.normal(size=(40, 3)) * 0.01
    g, degree = recovery.harmonic_fit(pts)
    x, y, z = pts.T
    for v, want in ((2 * x - z, (2, 0, -1)), (x * x - y * y + 3 * y * z, (0, 0, 0)), (5 + y + x * y * z, (0, 1, 0))):
        assert np.allclose(v @ g, want, atol=1e-6)
    assert degree == 3 and recovery.harmonic_fit(pts[:10])[1] == 2 and recovery.harmonic_fit(pts[:5])[1] in (0, 1) and recovery.harmonic_fit(pts[:2])[1] == 0
    weights = subject.spr_weights().groupBy("slot").agg(F.sum("w").alias("s")).toPandas()
    assert np.allclose(weights.s, 1)


def test_forward_is_linear_and_equals_the_adjoint(spark, subject, request_tables):
    placements, dipoles = request_tables
    one = subject.simulate(placements, dipoles, 1e6, "raw").toPandas().set_index(["p", "e"]).sort_index()
    two = subject.simulate(placements, dipoles, 2e6, "raw").toPandas().set_index(["p", "e"]).sort_index()
    assert np.allclose(2 * one.ex, two.ex, rtol=1e-4, atol=1e-3 * one.magn.max())
    roi = subject.roi(spark.createDataFrame([("t", 50.0, 50.0, 80.0, 20.0)], "name string, tx double, ty double, tz double, radius double")).select("e", "w")
    axes = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0)], "d int, dx double, dy double, dz double")
    nodal = subject.nodal_source(source.place_dipoles(subject.frames(placements), dipoles), 1e6)
    weights = subject.adjoint(roi, axes)
    by_adjoint = {(r.p, r.d): r.e for r in subject.exact_functional(weights, nodal).collect()}
    w = roi.toPandas().set_index("e").w
    for (p, d), e in by_adjoint.items():
        f = one.loc[p]
        forward = (f.loc[w.index, ["ex", "ey", "ez"][d]] * w).sum()
        assert abs(e - forward) < 2e-3 * max(1.0, abs(forward), abs(one.magn).max())


def test_uncertainty_without_spread_is_the_forward_field(spark, subject, request_tables):
    placements, dipoles = request_tables
    raw = subject.simulate(placements, dipoles, 1e6, "raw").toPandas().set_index(["p", "e"]).magn.sort_index()
    none = spark.createDataFrame([(t, 0.0) for t in range(1, 11)], "tag int, cov double")
    uq = subject.simulate_conductivity_uq(placements, dipoles, 1e6, n=2, overrides=none).toPandas()
    for k in (0, 1):
        assert np.allclose(uq[uq.k == k].set_index(["p", "e"]).magn.sort_index(), raw, rtol=1e-3, atol=1e-3 * raw.max())


def test_summaries_come_in_order(subject, request_tables):
    placements, dipoles = request_tables
    rows = list(subject.iter_simulate(placements, dipoles, 1e6, "spr_tissue", "gray_matter"))
    assert [r.p for r in rows] == [0, 1] and all(r.peak > 0 for r in rows)
    with pytest.raises(ValueError):
        subject.simulate(placements, dipoles, 1e6, "unknown")


def test_grid_interpolation(spark):
    grid = search.grid_shape(spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 20.0, 5.0)], "x double, y double, z double"), 4.0, 2.0)
    assert (grid["nx"], grid["ny"], grid["nz"], grid["ox"]) == (5, 7, 4, -2.0)
    values = search.grid_points(spark, grid).withColumn("q", F.col("x") + 2 * F.col("y") - F.col("z"))
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 9.9, 19.5, 4.9), (2, -2.0, -2.0, -2.0)], "i int, x double, y double, z double")
    got = {r.i: r.q for r in search.trilinear(pts, grid, values, ["i"], ["q"]).collect()}
    assert np.allclose([got[i] for i in range(3)], [0, 9.9 + 39 - 4.9, -4])
    with pytest.raises(ValueError, match="along x"):
        search.require_inside(pts.withColumn("x", F.lit(99.0)), grid, "i")
    with pytest.raises(ValueError):
        search.dirichlet(pts, ["i"], 8, 64)


def test_bad_meshes_raise(spark, subject):
    with pytest.raises(ValueError, match="unknown volume tags"):
        Subject(subject.nodes, subject.tets.withColumn("tag", F.lit(77)))
    with pytest.raises(ValueError, match="finite"):
        Subject(subject.nodes.withColumn("x", F.lit(float("inf"))), subject.tets)
    with pytest.raises(ValueError):
        mesh.reindex(subject.nodes.where("node > 3"), subject.tets)
    with pytest.raises(Exception, match="no conductivity"):
        sparse.conductivity(spark.createDataFrame([(99,)], "tag int"), tissue_table(spark)).collect()
    with pytest.raises(ValueError, match="volume"):
        mesh.require_volumes(spark.createDataFrame([(0.0,)], "vol double"))


def test_crop_renumbers(subject):
    nodes, tets, tris = mesh.crop(subject.nodes, subject.tets, subject.tris, (0.0, 0.0, 0.0), 45.0)
    n = nodes.count()
    assert 0 < n < subject.nodes.count() and nodes.agg(F.max("node")).first()[0] == n - 1
    assert tets.select(F.greatest("n0", "n1", "n2", "n3").alias("m")).agg(F.max("m")).first()[0] < n and tris.count() > 0


def test_coils_stand_on_the_skin_only(spark, request_tables):
    """A second surface inside the head, nearer to a centre than the skin, changes no frame."""
    placements, _ = request_tables
    nodes, tets = synth.cube_nodes(spark, 3), synth.cube_tets(spark, 3)
    skin = mesh.skin_triangles(nodes, tets)
    last = skin.count()
    high = nodes.agg(F.max("node")).first()[0]
    bone = spark.createDataFrame([(high + 1, 0.0, 0.0, 100.9), (high + 2, 100.0, 0.0, 100.9), (high + 3, 50.0, 100.0, 100.9)], "node int, x double, y double, z double")
    inner = spark.createDataFrame([(last, high + 1, high + 2, high + 3, 1004)], "t int, a int, b int, c int, tag int")
    with Subject(nodes, tets, skin) as one, Subject(nodes.unionByName(bone), tets, skin.unionByName(inner)) as two:
        assert sorted(one.frames(placements).collect()) == sorted(two.frames(placements).collect())


def test_only_used_nodes_must_be_finite(spark):
    nodes, tets = synth.cube_nodes(spark, 2), synth.cube_tets(spark, 2)
    stray = nodes.unionByName(spark.createDataFrame([(999, float("nan"), 0.0, None)], "node int, x double, y double, z double"))
    with Subject(stray, tets) as s:
        assert s.ground.collect() == Subject(nodes, tets).ground.collect()
    with pytest.raises(ValueError):
        Subject(nodes.withColumn("x", F.when(F.col("node") == 4, float("nan")).otherwise(F.col("x"))), tets)


def test_dipoles_outside_the_grid_are_refused(spark):
    grid = {"h": 1.0, "ox": 0.0, "oy": 0.0, "oz": 0.0, "nx": 3, "ny": 3, "nz": 3}
    q = search.grid_points(spark, grid).selectExpr("0 d", "ix", "iy", "iz", "1D qx", "1D qy", "1D qz")
    at = spark.createDataFrame([(0, 7, 1.0, 5.0, 1.0, 1.0, 0.0, 0.0)], "p int, j int, x double, y double, z double, mx double, my double, mz double")
    with pytest.raises(ValueError, match="sample 7 lies outside the grid along y"):
        search.reciprocity(at, grid, q, 1.0)


def test_harmonic_basis_is_harmonic():
    """Each column has no Laplacian: by central differences, which are exact for cubics."""
    rng = np.random.default_rng(0)
    p, h = rng.normal(size=(40, 3)), 0.5
    total = sum(recovery.harmonic_basis(*(p + s * h * np.eye(3)[a]).T) for a in range(3) for s in (1, -1)) - 6 * recovery.harmonic_basis(*p.T)
    assert np.abs(total).max() < 1e-9
    assert np.linalg.matrix_rank(recovery.harmonic_basis(*p.T)) == 16
    assert np.allclose(recovery.harmonic_basis(*p.T)[:, 1:4], p)


def grid_laplacian(k):
    """The seven-point matrix of a k x k x k grid, with a shift that makes it definite."""
    i = np.arange(k**3)
    at = np.stack([i % k, i // k % k, i // k**2])
    r, c, v = [i], [i], [np.full(k**3, 6.01)]
    for a, step in enumerate((1, k, k * k)):
        inner = i[at[a] < k - 1]
        r += [inner, inner + step]
        c += [inner + step, inner]
        v += [np.full(len(inner), -1.0)] * 2
    return solve.compress(k**3, k**3, np.concatenate(r), np.concatenate(c), np.concatenate(v))


def test_hierarchy_is_symmetric_and_saves_iterations():
    a = grid_laplacian(16)
    h = solve.Hierarchy(*a, coarsest=50)
    rows = [n for n, _ in h.levels()]
    assert len(rows) >= 3 and all(x > 2 * y for x, y in zip(rows, rows[1:]))
    b, c = np.random.default_rng(3).normal(size=(2, 16**3))
    assert abs(h(b) @ c - b @ h(c)) < 1e-8 * abs(b @ h(b)) and b @ h(b) > 0
    plain, cycled = solve.pcg(*a, b), solve.pcg(*a, b, precondition=h)
    assert cycled[1] <= 15 and cycled[1] < plain[1] / 2
    assert np.abs(plain[0] - cycled[0]).max() < 1e-4 * np.abs(plain[0]).max()


def test_product_and_pairs_against_dense():
    a = grid_laplacian(4)
    dense = np.zeros((64, 64))
    dense[solve.row_ids(a[0]), a[1]] = a[2]
    ptr, idx, v = solve.product(a, a, 64)
    got = np.zeros((64, 64))
    got[solve.row_ids(ptr), idx] = v
    assert np.allclose(got, dense @ dense)
    sizes = np.bincount(solve.aggregate_pairs(*a))
    assert sizes.max() <= 4 and sizes.min() >= 1 and sizes.sum() == 64


def test_numbers_run_over_blocks(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int")
    got = mesh.numbered(rows, F.floor(F.col("k") / 10), ["k"], "at").select("k", "at").collect()
    assert all(r.k == r.at for r in got) and len(got) == 101
