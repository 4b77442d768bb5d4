"""Queries that solve systems. SQL can not express them; tests hold them against dense algebra and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxmesh.model import clean
from fluxmesh.operators import ensemble, search
from fluxmesh.plans.registry import query
from fluxmesh.sources import synth
from fluxmesh.subject import Subject

RATE = 1e6
#: Cells a side of the cube on which systems are solved.
N = 4


def _subject(spark):
    return Subject(synth.cube_nodes(spark, N), synth.cube_tets(spark, N))


def _bar(spark, sf_dir):
    """The mesh that grows with the suppliers, for what needs no solve."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return Subject(synth.bar_nodes(suppliers), synth.bar_tets(suppliers))


def _request(spark, sf_dir):
    """The cube, a placement of each supplier and a coil of a dipole for each nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return _subject(spark), synth.placements_of(read("supplier"), "s_suppkey", "s_acctbal"), synth.dipoles_of(read("nation"), "n_nationkey", "n_regionkey")


def out(df, keys, digits=6):
    return df.select(*keys, *[clean(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys])


@query()
def forward_raw(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    return out(s.simulate(placements, dipoles, RATE, "raw"), ["p", "e"], 4)


@query()
def forward_harmonic(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    return out(s.simulate(placements, dipoles, RATE, "harmonic"), ["p", "e"], 4)


@query()
def forward_summary(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    return out(s.summarize(s.simulate(placements, dipoles, RATE, "raw"), "gray_matter"), ["p"], 4)


@query()
def solver_telemetry(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    solved = s.potentials(placements, dipoles, RATE)[0]
    return solved.groupBy("p").agg(F.max("iterations").alias("iterations"), F.max("residual").alias("residual"))


@query()
def spr_weights(spark, sf_dir):
    return out(_bar(spark, sf_dir).spr_weights(), ["slot", "e"], 9)


@query()
def harmonic_weights(spark, sf_dir):
    return out(_bar(spark, sf_dir).harmonic_weights(), ["slot", "node", "status"], 4)


@query()
def uq_run(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    return out(ensemble.moments(s.simulate_conductivity_uq(placements, dipoles, RATE, n=8), ["p", "e"], "magn"), ["p", "e", "n"], 4)


def _roi(s):
    targets = s.spark.createDataFrame([("t", 50.0, 50.0, 70.0, 15.0)], "name string, tx double, ty double, tz double, radius double")
    return s.roi(targets).select("e", "w")


def _axes(s):
    return s.spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0)], "d int, dx double, dy double, dz double")


@query()
def adjoint_solve(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    nodal = s.nodal_source(s.placed(s.frames(placements), dipoles), RATE)
    return out(s.exact_functional(s.adjoint(_roi(s), _axes(s)), nodal), ["p", "d"], 6)


@query()
def placement_search(spark, sf_dir):
    s, placements, dipoles = _request(spark, sf_dir)
    found = s.optimize_placement(placements, dipoles, RATE, _roi(s), _axes(s), fine=64, spacing=12.0)
    return out(search.ranked(found), ["p", "rank"], 4)
