"""Queries that hold the solves against identities whose outcome SQL can state from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxmesh.operators import mesh, solve, sparse
from fluxmesh.plans.mesh_queries import R, out, sql
from fluxmesh.plans.registry import query
from fluxmesh.plans.solve_queries import N, RATE, _axes, _bar, _request, _roi, _subject


@query(f"SELECT s_suppkey::INT AS p, {(N + 1) ** 3 - 1}::BIGINT AS unknowns, true AS balanced FROM supplier")
def forward_residual(spark, sf_dir):
    """Each placement's potential, multiplied by the matrix in Spark again, gives its right-hand side."""
    s, placements, dipoles = _request(spark, sf_dir)
    solved, _, elements = s.potentials(placements, dipoles, RATE)
    k = sparse.reduce_matrix(sparse.stiffness(s.corners), s.ground)
    kv = k.join(solved.select("p", F.col("node").alias("c"), F.col("v").alias("x")), "c").groupBy("p", F.col("r").alias("node")).agg(F.sum(F.col("v") * F.col("x")).alias("kv"))
    j = kv.join(sparse.rhs(s.corners, elements, ("p",)), ["p", "node"])
    off, size = F.sqrt(F.sum((F.col("kv") - F.col("b")) ** 2)), F.sqrt(F.sum(F.col("b") ** 2))
    return j.groupBy("p").agg(F.count("*").alias("unknowns"), (off <= 1.01 * solve.TOLERANCE * size).alias("balanced"))


@query("SELECT s_suppkey::INT AS p, d::INT AS d, true AS agrees FROM supplier, range(3) t(d)")
def adjoint_equals_forward(spark, sf_dir):
    """The adjoint's value along each axis is the region's mean of the forward field."""
    s, placements, dipoles = _request(spark, sf_dir)
    solved, nodal, elements = s.potentials(placements, dipoles, RATE, dealt=False)
    raw = s.raw_field(placements, solved, nodal, elements)
    means = raw.join(F.broadcast(_roi(s)), "e").groupBy("p").agg(*[F.sum(F.col("w") * F.col(f"e{a}")).alias(f"m{a}") for a in "xyz"])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"m{a}").alias("mean")) for i, a in enumerate("xyz")])).alias("q")
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    means = means.select("p", size.alias("size"), each).select("p", "size", "q.d", "q.mean")
    adjoint = s.exact_functional(s.adjoint(_roi(s), _axes(s)), nodal)
    return means.join(adjoint, ["p", "d"]).select("p", "d", (F.abs(F.col("e") - F.col("mean")) <= 1e-4 * F.col("size")).alias("agrees"))


@query(f"SELECT s_suppkey::INT AS p, {6 * N**3}::BIGINT AS elements, true AS agrees FROM supplier")
def uncertainty_without_spread(spark, sf_dir):
    """With no spread every draw's field is the forward field."""
    s, placements, dipoles = _request(spark, sf_dir)
    still = s.tissues.select("tag", F.lit(0.0).alias("cov"))
    drawn = s.simulate_conductivity_uq(placements, dipoles, RATE, n=2, overrides=still).groupBy("p", "e").agg(F.min("magn").alias("lo"), F.max("magn").alias("hi"))
    forward = s.simulate(placements, dipoles, RATE, "raw").select("p", "e", "magn")
    near = (F.abs(F.col("hi") - F.col("magn")) <= 1e-4 * F.col("top")) & (F.abs(F.col("lo") - F.col("magn")) <= 1e-4 * F.col("top"))
    top = forward.groupBy("p").agg(F.max("magn").alias("top"))
    return drawn.join(forward, ["p", "e"]).join(top, "p").groupBy("p").agg(F.count("*").alias("elements"), F.min(near).alias("agrees"))


INNER = "bnd AS (SELECT unnest([a, b, c]) AS node FROM outer_ UNION SELECT node FROM corner_nodes GROUP BY node HAVING count(DISTINCT tag) > 1)"


@query(sql(f"SELECT slot, {R('1e0', 'one', 5)}, {R('x', 'x', 5)}, {R('y', 'y', 5)}, {R('z', 'z', 5)} FROM slots JOIN nodes USING (node) WHERE node NOT IN (SELECT node FROM bnd)", INNER))
def spr_reproduces_linear(spark, sf_dir):
    """Weights of inner slots turn the barycentres' coordinates into the node's own."""
    s = _bar(spark, sf_dir)
    inner = s.slots.join(mesh.tissue_boundary(s.tets), "node", "left_anti").select("slot")
    w = s.spr_weights().join(inner, "slot").join(s.elements.select("e", "bx", "by", "bz"), "e")
    sums = w.groupBy("slot").agg(F.sum("w").alias("one"), *[F.sum(F.col("w") * F.col(f"b{a}")).alias(a) for a in "xyz"])
    return out(sums, ["slot"], 5)


@query(sql("SELECT slot, true AS constant, true AS linear FROM slots"))
def harmonic_reproduces_gradient(spark, sf_dir):
    """Gradient weights give nothing for a constant and the unit vectors for the coordinates."""
    s = _bar(spark, sf_dir)
    w = s.harmonic_weights().where("status > 0").join(s.nodes, "node")
    still = F.lit(True)
    unit = F.lit(True)
    for a in "xyz":
        still = still & (F.abs(F.sum(f"w{a}")) <= 1e-6 * F.sum(F.abs(f"w{a}")))
        for b in "xyz":
            unit = unit & (F.abs(F.sum(F.col(f"w{a}") * F.col(b) * 1e-3) - (1.0 if a == b else 0.0)) <= 1e-6)
    return w.groupBy("slot").agg(still.alias("constant"), unit.alias("linear"))


@query()
def aggregation_levels(spark, sf_dir):
    """``level, rows, entries`` of the solver's hierarchy, coarsened down to ten rows."""
    csr = _subject(spark).csr()
    levels = solve.Hierarchy(csr.ptr, csr.idx, csr.combined(), coarsest=10).levels()
    return spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(levels)], "level int, rows int, entries int")
