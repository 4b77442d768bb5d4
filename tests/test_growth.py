"""Plans that must grow with their tables: nothing that is expanded is broadcast, read by one task or shuffled whole."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxmesh.operators import mesh, metrics, search, source
from fluxmesh.sources import synth
from fluxmesh.subject import Subject


def suppliers(spark, n):
    k = F.col("id")
    return spark.range(0, n, 1, 1).select(k.alias("s_suppkey"), (k % 25).cast("int").alias("s_nationkey"), (k % 997).cast("double").alias("s_acctbal"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_spatial_join_are_not_broadcast(spark):
    rows = suppliers(spark, 20)
    nodes, tets = synth.bar_nodes(rows), synth.bar_tets(rows)
    placements = spark.range(50).select(F.col("id").cast("int").alias("p"), (F.col("id") * 9.0).alias("cx"), F.lit(40.0).alias("cy"), F.lit(101.0).alias("cz"))
    found = source.closest_points(placements, nodes, mesh.skin_triangles(nodes, tets))
    assert found.count() == 50
    joins = [line for line in plan_of(found).splitlines() if "Join" in line and ("_level" in line or "level#" in line)]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_the_mesh_of_a_small_file_is_made_by_many_tasks(spark):
    rows = suppliers(spark, 3 * synth.TASK_LAYERS)
    nodes, tets = synth.bar_nodes(rows), synth.bar_tets(rows)
    assert nodes.rdd.getNumPartitions() == 3 and tets.rdd.getNumPartitions() == 3
    assert nodes.count() == 25 * 3 * synth.TASK_LAYERS


def test_nodes_are_not_sized_by_their_suppliers(spark):
    """Spark must not take 25 nodes for as small as one supplier."""
    rows = suppliers(spark, 2000)
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    for made in (synth.bar_nodes(rows), synth.bar_tets(rows), synth.bar_potential(rows)):
        assert size(made) >= 2000 * 25 * 8


def test_angles_are_not_shuffled(spark):
    samples = spark.range(90).select((F.col("id") / 9).cast("int").alias("c"), (F.col("id") % 9).cast("int").alias("s"), F.col("id").cast("double").alias("e"))
    out = search.dirichlet(samples, ["c"], 9, 64)
    assert plan_of(out).count("Exchange hashpartitioning") == 1 and "hashpartitioning(c#" in plan_of(out)
    assert out.count() == 640


def test_a_request_on_a_small_mesh_is_dealt_by_placement_only(spark):
    i = F.col("id")
    placements = spark.range(3).select(i.cast("int").alias("p"), (50.0 + i).alias("cx"), F.lit(50.0).alias("cy"), F.lit(101.0).alias("cz"), (50.0 + i).alias("hx"), F.lit(90.0).alias("hy"), F.lit(100.0).alias("hz"), F.lit(4.0).alias("dist"))
    dipoles = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1)], "j int, sx double, sy double, sz double, mx double, my double, mz double")
    with Subject(synth.cube_nodes(spark, 2), synth.cube_tets(spark, 2)) as s:
        _, _, elements = s.potentials(placements, dipoles, 1e6)
        assert not re.search(r"hashpartitioning\(p#\d+, (e|node)#", plan_of(elements))
        # Nor are an ensemble's fields and an adjoint's values: what follows a solve is dealt by placement once.
        by_more = r"hashpartitioning\(p#\d+, (k|e|node)#"
        assert not re.search(by_more, plan_of(s.simulate_conductivity_uq(placements, dipoles, 1e6, n=2)))
        solved, nodal, elements = s.potentials(placements, dipoles, 1e6, dealt=False)
        assert not re.search(by_more, plan_of(s.raw_field(placements, solved, nodal, elements)))
        weights = spark.createDataFrame([(0, i, 1.0, 0.0, 0.0) for i in range(27)], "d int, node int, wx double, wy double, wz double")
        assert not re.search(by_more, plan_of(s.exact_functional(weights, nodal)))


def test_a_region_of_interest_does_not_repeat_the_mesh_in_its_plan(spark):
    rows = suppliers(spark, 8)
    nodes, tets = synth.bar_nodes(rows), synth.bar_tets(rows)
    elements = mesh.barycentres(nodes, tets).join(mesh.gradients(nodes, tets).select("e", "vol"), "e")
    targets = spark.createDataFrame([("a", 60.0, 40.0, 50.0, 0.0), ("b", 60.0, 40.0, 50.0, 22.0)], "name string, tx double, ty double, tz double, radius double")
    found = metrics.resolve_targets(elements, targets)
    assert plan_of(found).count("Join") <= 4
    assert {r.name for r in found.collect()} == {"a", "b"}


def test_fields_of_many_dipoles_are_added_up_by_blocks(spark, monkeypatch):
    i = F.col("id")
    nodes = spark.range(60).select(i.cast("int").alias("node"), (25.0 * i).alias("x"), (i % 5 * 20.0).alias("y"), (i % 3 * 30.0).alias("z"))
    dipoles = spark.range(90).select((i * 0.02).alias("sx"), (i % 7 * 0.01).alias("sy"), F.lit(0.11).alias("sz"), (i % 3 * 0.1).alias("mx"), F.lit(0.2).alias("my"), (i % 4 * 0.3).alias("mz"))
    want = {r.node: r for r in source.dipole_field(nodes, dipoles, 1e6).collect()}
    for name, value in (("HELD_DIPOLES", 10), ("BLOCK_ROWS", 16), ("TILE_NODES", 5), ("TILE_DIPOLES", 7)):
        monkeypatch.setattr(source, name, value)
    made = source.dipole_field(nodes, dipoles, 1e6)
    assert "NestedLoop" not in plan_of(made) and "Cartesian" not in plan_of(made)
    got = {r.node: r for r in made.collect()}
    assert set(got) == set(want) and all(abs(got[k][c] - want[k][c]) < 1e-9 * max(1.0, abs(want[k][c])) for k in want for c in ("ax", "ay", "az"))


def test_dipoles_of_blocked_pairs_are_added_up_before_they_meet_nodes(spark):
    from fluxmesh.plans.space_queries import blocked_pairs

    plan = plan_of(blocked_pairs(spark, "/root/testdata/sf0.001"))
    join = plan.index("ShuffledHashJoin")
    assert plan.index("HashAggregate", join) > join and "sum(mx#" in plan[join:]


def test_plans_of_a_mesh_read_several_times_do_not_repeat_it(spark):
    from fluxmesh.plans import mesh_queries as m

    sf = "/root/testdata/sf0.001"
    # Joins of nodes' coordinates: four for each time the mesh is made.
    for made, most in ((m.combine_matrix, 5), (m.galerkin_product, 5), (m.recover_elements, 14), (m.nodal_field, 14)):
        assert plan_of(made(spark, sf)).count("Join") <= most, made.__name__


def test_weights_on_a_large_mesh_do_not_carry_cached_plans(spark, monkeypatch):
    monkeypatch.setattr("fluxmesh.subject.HELD_CORNERS", 1)
    rows = suppliers(spark, 6)
    with Subject(synth.bar_nodes(rows), synth.bar_tets(rows)) as s:
        weights = s.harmonic_weights()
        assert "InMemoryTableScan" not in plan_of(weights) and "Join" not in plan_of(weights)
        assert weights.select("slot").distinct().count() == s.slots.count()


def test_a_layout_has_a_bounded_number_of_folders(spark, monkeypatch, tmp_path):
    from fluxmesh.sources import layout

    monkeypatch.setattr(layout, "MOST_BLOCKS", 5)
    rows = suppliers(spark, 12)
    layout.write_layout(synth.bar_nodes(rows), synth.bar_tets(rows), None, f"file://{tmp_path}/m", 8)
    assert len(list((tmp_path / "m" / "nodes").glob("block=*"))) == 5
    points = spark.createDataFrame([(0, 60.0, 40.0, 55.0)], "p int, cx double, cy double, cz double")
    bary = mesh.barycentres(synth.bar_nodes(rows), synth.bar_tets(rows))
    near = bary.where("(bx-60)*(bx-60)+(by-40)*(by-40)+(bz-55)*(bz-55) <= 900").count()
    assert layout.elements_near(spark, f"file://{tmp_path}/m", points, 30.0).count() == near > 0


def test_rows_of_an_index_are_shuffled_once(spark):
    from fluxmesh.model import FieldSpec
    from fluxmesh.operators import ordering

    i = F.col("id")
    rows = spark.range(400).select((i % 3).alias("g"), (i * 7 % 101).cast("double").alias("v"), (i % 5 + 1).cast("double").alias("w"), i.alias("k"), F.array(F.lit("all")).alias("regions"))
    plan = plan_of(ordering.ranked(rows, FieldSpec("v", "w", ("g",), ("k",)), ["all"], by_range=True))
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan and "lambda c" not in plan


def test_samples_meet_few_tiles_without_a_shuffle(spark):
    i = F.col("id")
    samples = spark.range(50).select(F.lit(0).alias("p"), i.cast("int").alias("j"), (i * 1.0).alias("x"), (i * 0.5).alias("y"), (i * 0.25).alias("z"), F.lit(1.0).alias("mx"), F.lit(0.0).alias("my"), F.lit(0.0).alias("mz"))
    grid = search.grid_shape(samples, 5.0, 5.0)
    q = search.grid_points(spark, grid).select(F.lit(0).alias("d"), "ix", "iy", "iz", F.col("x").alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"))
    e = search.reciprocity(samples, grid, q, 2.0)
    assert "hashpartitioning(tx#" not in plan_of(e)
    assert abs(e.first()["e"] - 2.0 * sum(range(50))) < 1e-6


def test_alike_dipoles_are_placed_once(spark, monkeypatch):
    monkeypatch.setattr(source, "ALIKE_ROWS", 8)
    i = F.col("id")
    axes = [F.lit(float(a == b)).alias(f"r{a}{b}") for a in range(3) for b in range(3)]
    frames = spark.range(5).select(i.cast("int").alias("p"), *axes, (10.0 * i).alias("ox"), F.lit(0.0).alias("oy"), F.lit(-0.0).alias("oz"))
    dipoles = spark.range(60).select(i.cast("int").alias("j"), (i % 2 * 0.008).alias("sx"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sz"), F.lit(0.1).alias("mx"), F.lit(0.0).alias("my"), (i % 3 * 0.01).alias("mz"))
    dipoles = dipoles.unionByName(dipoles.where("j = 7"))  # repeated rows count
    alike = source.place_alike(frames, dipoles)
    columns = ["p", "j", "sx", "sy", "sz", "mx", "my", "mz"]
    got = sorted(tuple(r) for r in alike.select("p", F.explode("js").alias("q"), *columns[2:]).select("p", "q.j", *columns[2:]).collect())
    assert got == sorted(tuple(r) for r in source.place_dipoles(frames, dipoles).select(*columns).collect()) and len(got) == 305
    assert alike.count() < 305


def test_scaled_rounding_is_that_of_sql(spark):
    import duckdb

    from fluxmesh.model import clean_scaled

    values = [0.0, -0.0, 0.5, -0.5, 2.5e-7, -2.5e-7, 0.25e-7, 1.00000005, -1.23456785, 4.9999999999999994e-8, 1234.56789012345, 3e9, -7e12, 1e300, float("inf"), float("nan"), None]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", clean_scaled(F.col("x"), 7).alias("v")).orderBy("i").collect()]
    want = [None if v is None else duckdb.sql(f"SELECT round('{v!r}'::DOUBLE, 7) + 0e0").fetchall()[0][0] for v in values]
    assert [repr(a) for a in got] == [repr(b) for b in want]


def test_grid_values_and_samples_are_not_broadcast(spark):
    i = F.col("id")
    samples = spark.range(50).select(i.cast("int").alias("j"), (i * 1.0).alias("x"), (i * 0.5).alias("y"), (i * 0.25).alias("z"))
    grid = search.grid_shape(samples, 5.0, 5.0)
    q = search.grid_points(spark, grid).select(F.lit(0).alias("d"), "ix", "iy", "iz", F.col("x").alias("q"))
    out = search.trilinear(samples, grid, q, ["j"], ["q"], ("d",))
    assert all(abs(r.q - r.j) < 1e-9 for r in out.collect()) and out.count() == 50
    assert "SortMergeJoin" in plan_of(out) and "Broadcast" not in plan_of(out)


def test_draws_of_a_matrix_are_not_shuffled(spark):
    from fluxmesh.operators import ensemble, sparse
    from fluxmesh.plans import mesh_queries as m

    assert "hashpartitioning(k#" not in plan_of(m.combine_matrix(spark, "/root/testdata/sf0.001")).split("BroadcastExchange")[0]
    rows = suppliers(spark, 4)
    grads = mesh.gradients(synth.bar_nodes(rows), synth.bar_tets(rows))
    sigmas = spark.createDataFrame([(0, 2, 0.5), (0, 3, 1.5), (1, 3, 2.0)], "k int, tag int, sigma double")
    by_tissue = sparse.stiffness(mesh.corners(grads).withColumn("sigma", F.lit(1.0)), by=("tag",))
    want = {(r.k, r.r, r.c): r.v for r in ensemble.combine(by_tissue, sigmas).collect()}
    got = {(r.k, r.r, r.c): r.v for r in ensemble.combine_parts(sparse.unit_parts(grads, [2, 3]), sigmas, [2, 3]).collect()}
    assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_far_dipoles_meet_nodes_as_equivalent_ones(spark, monkeypatch):
    i = F.col("id")
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_003)) / 100_003.0
    # A bar, a cloud and a crowd: cells that are thin, whole and overfull.
    bar = spark.range(6000).select(*[(h(k) * s).alias(a) for k, (a, s) in enumerate((("x", 40.0), ("y", 0.03), ("z", 0.0)))], "id")
    cloud = spark.range(3000).select(*[(h(k) * 10.0).alias(a) for k, a in enumerate("xyz")], "id")
    crowd = spark.range(3000).select(*[(0.5 + h(k) * 0.01).alias(a) for k, a in enumerate("xyz")], "id")
    for places in (bar, cloud, cloud.unionByName(crowd)):
        dipoles = places.select(*[F.col(a).alias(f"s{a}") for a in "xyz"], (h(7) - 0.5).alias("mx"), (h(8) - 0.5).alias("my"), (h(9) - 0.5).alias("mz"))
        nodes = places.where("id % 7 = 0").select(F.row_number().over(Window.orderBy("x", "y", "z")).alias("node"), ((F.col("x") + 0.01) * 1e3).alias("x"), ((F.col("y") + 0.1) * 1e3).alias("y"), ((F.col("z") + 0.07) * 1e3).alias("z"))
        monkeypatch.setattr(source, "CELL_DIPOLES", 40)
        monkeypatch.setattr(source, "BLOCK_ROWS", 64)
        dipoles, nodes = dipoles.localCheckpoint(), nodes.localCheckpoint()
        want = {r.node: r for r in source.dipole_field(nodes, dipoles).collect()}
        monkeypatch.setattr(source, "TREE_PAIRS", 1)
        got = {r.node: r for r in source.dipole_field(nodes, dipoles).collect()}
        monkeypatch.undo()
        assert set(got) == set(want) and len(got) > 400
        size = sum(abs(want[k][c]) for k in want for c in ("ax", "ay", "az")) / len(want)
        assert max(abs(got[k][c] - want[k][c]) for k in want for c in ("ax", "ay", "az")) < 1e-12 * size
    # In place of 6000 dipoles of the bar, a far cell is as many equivalent ones as its size asks for.
    assert source._orders(1.0, [40.0, 0.03, 0.0])[2] == 1 and source._orders(1.0, [40.0, 0.03, 0.0])[1] < 12
