"""A head model and what is asked of it: forward fields, uncertainty, and placement search, each as one lazy plan."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fluxmesh.functions.vectors import dot, vec
from fluxmesh.model import region_filter, region_tag, tissue_table
from fluxmesh.operators import ensemble, mesh, metrics, recovery, search, solve, source, sparse, warm
from fluxmesh.results import ELEMENT_FIELD, EnsembleResult, FieldResult, labelled
from fluxmesh.sources.msh import read_msh
from fluxmesh.sources.msh_split import read_msh_split
from fluxmesh.sources.scratch import written

#: Corners of a mesh that every task of a request may hold whole; requests on such a mesh are dealt by placement.
HELD_CORNERS = 200_000
#: Rows (corners times placements) that one task of such a request works on.
TASK_ROWS = 1_000_000


class Subject:
    """Tables of one mesh, cached on first use. Arguments are checked when a plan is built, before anything runs."""

    def __init__(self, nodes: DataFrame, tets: DataFrame, tris: DataFrame | None = None, tissues: DataFrame | None = None, reorder: bool = False):
        self.spark: SparkSession = nodes.sparkSession
        self._kept: dict[str, DataFrame] = {}
        self._csr: dict[str, solve.Csr] = {}
        self._n_corners: int | None = None
        if reorder:
            ids = self._keep("curve", lambda: mesh.curve_order(mesh.used_nodes(nodes, tets)))
            moved = mesh.reordered(mesh.used_nodes(nodes, tets), tets, tris, ids)
            nodes, tets, tris = (self._keep(f"moved {k}", lambda df=df: df) if df is not None else None for k, df in enumerate(moved))
        self.nodes = mesh.used_nodes(mesh.require_finite(nodes, tets), tets)
        self.tets = mesh.require_known_tags(tets)
        self.tris = mesh.skin_surface(tris) if tris is not None else mesh.skin_triangles(nodes, tets)
        self.tissues = tissues if tissues is not None else tissue_table(self.spark)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tissues: DataFrame | None = None, reorder: bool = True, split: bool = True) -> "Subject":
        """The head model of a mesh file, its nodes and elements along the Morton curve unless told otherwise.

        Byte ranges of the file are read by many tasks; without ``split`` one task reads it whole, through Spark's own readers.
        """
        m = read_msh_split(spark, path) if split else read_msh(spark, path)
        return cls(m["nodes"], m["tets"], m["tris"], tissues, reorder)

    @property
    def mesh(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, tets, skin triangles) in the numbering that every result refers to."""
        return self.nodes, self.tets, self.tris

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = build().persist()
        return self._kept[name]

    def _table(self, name: str, build) -> DataFrame:
        """A table of the mesh: cached on a small mesh, else written once. A cached table's plan stands in every plan that
        reads it, and would fill the driver."""
        if self.held:
            return self._keep(name, build)
        if name not in self._kept:
            self._kept[name] = written(build(), name)
        return self._kept[name]

    def free(self) -> None:
        """Give the cached tables back."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
        self._csr.clear()
        self._n_corners = None

    def __enter__(self) -> "Subject":
        return self

    def __exit__(self, *_) -> None:
        self.free()

    @property
    def grads(self) -> DataFrame:
        return self._table("grads", lambda: mesh.require_volumes(mesh.gradients(self.nodes, self.tets)))

    @property
    def corners(self) -> DataFrame:
        return self._held(self._table("corners", lambda: sparse.conductivity(mesh.corners(self.grads), self.tissues)))

    @property
    def held(self) -> bool:
        """Whether each task may hold the whole mesh: then a request is dealt by placement once and stays so."""
        if self._n_corners is None:
            self._n_corners = 4 * self.tets.count()
        return self._n_corners <= HELD_CORNERS

    def _held(self, rows: DataFrame) -> DataFrame:
        """``rows`` of the mesh, joined where the request's rows are if the mesh is small."""
        return F.broadcast(rows) if self.held else rows

    def _dealt(self, rows: DataFrame, tasks: int | None) -> DataFrame:
        """``rows`` of a request with all of a placement in one task, so that sums by placement shuffle nothing."""
        return rows.repartition(tasks, "p") if tasks else rows

    def _tasks(self, placements: DataFrame, draws: int = 1) -> int | None:
        """Tasks that a request on a small mesh is dealt to; None on others, whose sums are spread by node and element."""
        if not self.held:
            return None
        rows = placements.count() * self._n_corners * draws
        return max(self.spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))

    @property
    def elements(self) -> DataFrame:
        return self._table("elements", lambda: mesh.barycentres(self.nodes, self.tets).join(self.grads.select("e", "tag", "vol"), "e"))

    @property
    def normals(self) -> DataFrame:
        return self._keep("normals", lambda: mesh.skin_normals(self.nodes, self.tris))

    @property
    def slots(self) -> DataFrame:
        return self._held(self._table("slots", lambda: mesh.tissue_slots(self.tets).withColumn("slot", F.col("slot").cast("int"))))

    @property
    def ground(self) -> DataFrame:
        return self._keep("ground", lambda: sparse.ground_node(self.nodes))

    def csr(self, by_tag: bool = False) -> solve.Csr:
        name = "tags" if by_tag else "nominal"
        if name not in self._csr:
            corners = self.corners.withColumn("sigma", F.lit(1.0)) if by_tag else self.corners
            k = sparse.stiffness(corners, by=("tag",) if by_tag else ())
            self._csr[name] = solve.collect_csr(sparse.reduce_matrix(k, self.ground), by_tag)
        return self._csr[name]

    # ---- forward ------------------------------------------------------------------------------------------------

    def frames(self, placements: DataFrame) -> DataFrame:
        """One row a placement, cached: every later step starts from it."""
        frames = source.coil_frames(source.valid_placements(placements), self.nodes, self.tris, self.normals).persist()
        self._kept[f"frames {len(self._kept)}"] = frames
        return source.require_frames(frames)

    def placed(self, frames: DataFrame, dipoles: DataFrame, draws: int = 1) -> DataFrame:
        """The dipoles of every placement, all of one in a task if the mesh is small."""
        return source.place_dipoles(self._dealt(frames, self._tasks(frames, draws)), dipoles)

    def nodal_source(self, placed: DataFrame, rate: float, by: tuple[str, ...] = ("p",)) -> DataFrame:
        """``by, node, ax, ay, az`` of placed dipoles."""
        if self.held and by:
            return source.held_field(self.nodes, placed, rate, by)
        return source.dipole_field(self.nodes, placed, rate, by)

    def potentials(self, placements: DataFrame, dipoles: DataFrame, rate: float, levels: int = 1, dealt: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(potential with telemetry, nodal dA/dt, element dA/dt) of every placement. ``dealt`` deals the potential by
        placement again after the solve, for sums that follow; ``raw_field`` does so itself."""
        nodal = self.nodal_source(self.placed(self.frames(placements), dipoles), rate)
        elements = sparse.element_means(nodal, self.corners, ["ax", "ay", "az"], ("p",))
        b = sparse.rhs(self.corners, elements, ("p",))
        solved = solve.solve(self.csr(), b, ["p"], levels=levels)
        return self._dealt(solved, self._tasks(placements)) if dealt else solved, nodal, elements

    def raw_field(self, placements: DataFrame, solved: DataFrame, nodal: DataFrame, elements: DataFrame, draws: int = 0) -> DataFrame:
        """``p, e, ex, ey, ez, magn`` (with ``draws``: ``p, k, ...``) of a potential and its dA/dt at nodes and elements.

        On a small mesh potential and nodal dA/dt are dealt by placement together and added up where they meet: a join by
        placement and element would shuffle both once more. The ground's potential is zero and adds nothing.
        """
        by = ("p", "k") if draws else ("p",)
        if not self.held:
            gradient = sparse.reconstruct(self.corners, solved.select(*by, "node", "v"), None, by).drop("magn").join(elements, ["p", "e"])
            field = gradient.select(*by, "e", *[(F.col(f"e{a}") - F.col(f"a{a}")).alias(f"e{a}") for a in "xyz"])
        else:
            k = [F.col("k")] if draws else []
            rows = solved.select("p", *k, "node", "v", *[F.lit(0.0).alias(f"a{a}") for a in "xyz"])
            still = nodal.select("p", *[F.lit(None).cast("int").alias("k") for _ in k], F.col("node").cast("int").alias("node"), F.lit(0.0).alias("v"), *[f"a{a}" for a in "xyz"])
            rows = self._dealt(rows.unionByName(still), self._tasks(placements, max(draws, 1)))
            if draws:
                rows = rows.withColumn("k", F.explode(F.when(F.col("k").isNull(), F.sequence(F.lit(0), F.lit(draws - 1))).otherwise(F.array("k"))))
            met = self.corners.select("e", "node", "gx", "gy", "gz").join(rows, "node")
            field = met.groupBy(*by, "e").agg(*[F.sum(-F.col("v") * F.col(f"g{a}") - F.col(f"a{a}") / 4).alias(f"e{a}") for a in "xyz"])
        return field.withColumn("magn", F.sqrt(dot(vec("e"), vec("e"))))

    def simulate(self, placements: DataFrame, dipoles: DataFrame, rate: float, mode: str = "harmonic") -> DataFrame:
        """``p, e, ex, ey, ez, magn`` for every placement."""
        recovery.validate_mode(mode)
        solved, nodal, elements = self.potentials(placements, dipoles, rate, dealt=mode == "harmonic")
        if mode == "harmonic":
            v = solved.select("p", "node", "v")  # the ground's potential is zero: it adds nothing to a gradient
            slot_field = recovery.harmonic_field(self._held(self.harmonic_weights()), self.slots, v, nodal, ("p",))
            return recovery.recover_elements(self.corners, self.slots, slot_field, ("p",))
        raw = self.raw_field(placements, solved, nodal, elements)
        if mode == "raw":
            return raw
        slot_field = recovery.recover_nodes(self._held(self.spr_weights(mode)), raw, ("p",))
        return recovery.recover_elements(self.corners, self.slots, slot_field, ("p",))

    def harmonic_weights(self) -> DataFrame:
        return self._table("harmonic", lambda: recovery.harmonic_weights(recovery.node_patches(self.corners, self.slots), self.slots, self.nodes))

    def spr_weights(self, mode: str = "spr_tissue") -> DataFrame:
        edge = mesh.tissue_boundary(self.tets) if mode == "spr_tissue" else mesh.outer_boundary(self.tets)
        return self._table(mode, lambda: recovery.spr_weights(self.corners, self.slots, self.nodes, self.elements.select("e", "bx", "by", "bz"), edge))

    def summarize(self, field: DataFrame, region: str = "all") -> DataFrame:
        """Metrics of each placement's field in a region."""
        if region != "all":
            region_tag(region)
        rows = field.join(self._held(self.elements.where(region_filter(region))), "e")
        return metrics.region_summary(rows, ELEMENT_FIELD)

    def result(self, field: DataFrame, mode: str = "raw", slot_field: DataFrame | None = None) -> FieldResult:
        """Accessors of a field of ``simulate``; all regions are summarised from one sort."""
        return FieldResult(field, labelled(self.elements), mode, slots=self.slots if slot_field is not None else None, slot_field=slot_field)

    def iter_simulate(self, placements: DataFrame, dipoles: DataFrame, rate: float, mode: str = "harmonic", region: str = "all") -> Iterator[Row]:
        """Summaries in placement order, a partition at a time; arguments are checked before the first is asked for."""
        plan = self.summarize(self.simulate(placements, dipoles, rate, mode), region).orderBy("p")
        return plan.toLocalIterator()

    # ---- regions ------------------------------------------------------------------------------------------------

    def roi(self, targets: DataFrame, region: str = "all") -> DataFrame:
        return metrics.resolve_targets(self.elements.where(region_filter(region)), targets)

    # ---- uncertainty --------------------------------------------------------------------------------------------

    def simulate_conductivity_uq(self, placements: DataFrame, dipoles: DataFrame, rate: float, n: int = 500, seed: int = 0, kind: str = "lognormal", overrides: DataFrame | None = None, warm_start: bool = False) -> DataFrame:
        """``p, k, e, magn`` of every placement and draw. A draw depends on (seed, k, tag) only, so more draws change none.

        With ``warm_start`` draws begin from their Galerkin projection: worth it where iterations cost more than one
        more solve for each placement and tissue.
        """
        sigmas = self.drawn_conductivities(n, seed, kind, overrides)
        maps = sigmas.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "sigma")))).alias("sigmas"))
        nodal = self.nodal_source(self.placed(self.frames(placements), dipoles, n), rate)
        elements = sparse.element_means(nodal, self.corners, ["ax", "ay", "az"], ("p",))
        unit = sparse.rhs(self.corners.withColumn("sigma", F.lit(1.0)), elements, ("p", "tag"))
        if warm_start:
            unit = written(unit, "unit")
        b = ensemble.combine(unit, sigmas, ("p", "node"), "b").join(F.broadcast(maps), "k")
        if warm_start:
            b = b.join(self.draw_starts(unit, sigmas), ["p", "k", "node"], "left")
        solved = solve.solve(self.csr(by_tag=True), b, ["p", "k"], sigmas="sigmas", start="x0" if warm_start else None)
        return self.raw_field(placements, solved, nodal, elements, n)

    def drawn_conductivities(self, n: int, seed: int = 0, kind: str = "lognormal", overrides: DataFrame | None = None) -> DataFrame:
        """``k, tag, sigma`` of every draw and tissue of the mesh."""
        if n < 1:
            raise ValueError("at least one draw is needed")
        present = self.tets.select("tag").distinct()
        return ensemble.draws(ensemble.with_cov(self.tissues, overrides).join(present, "tag", "left_semi"), n, seed, kind)

    def conductivity_uq_result(self, placements: DataFrame, dipoles: DataFrame, rate: float, n: int = 500, seed: int = 0, kind: str = "lognormal", overrides: DataFrame | None = None, rois: DataFrame | None = None, warm_start: bool = False) -> EnsembleResult:
        """Accessors of an ensemble: the draws are solved once, when the first is asked for."""
        samples = self.simulate_conductivity_uq(placements, dipoles, rate, n, seed, kind, overrides, warm_start)
        return EnsembleResult(samples, labelled(self.elements), self.drawn_conductivities(n, seed, kind, overrides), rois=rois)

    def iter_simulate_conductivity_uq(self, placements: DataFrame, dipoles: DataFrame, rate: float, n: int = 500, seed: int = 0, region: str = "gray_matter", **kwargs) -> Iterator[Row]:
        """Summaries of the mean field in placement order, a partition at a time; arguments are checked before the first."""
        if region != "all":
            region_tag(region)
        result = self.conductivity_uq_result(placements, dipoles, rate, n, seed, **kwargs)
        return result.summary_for(region).orderBy("p").toLocalIterator()

    def draw_starts(self, unit_rhs: DataFrame, sigmas: DataFrame) -> DataFrame:
        """``p, k, node, x0`` of every draw ``sigmas(k, tag, sigma)`` from the parts ``unit_rhs(p, tag, node, b)`` of the right-hand side."""
        parts_k = written(sparse.reduce_matrix(sparse.stiffness(self.corners.withColumn("sigma", F.lit(1.0)), by=("tag",)), self.ground), "parts")
        tags = sorted(r.tag for r in self.tets.select("tag").distinct().collect())
        b = unit_rhs.join(F.broadcast(self.tissues.select("tag", "sigma")), "tag").groupBy("p", "node").agg(F.sum(F.col("sigma") * F.col("b")).alias("b"))
        nominal = written(solve.solve(self.csr(), b, ["p"]).select("p", "node", "v"), "nominal")
        residuals = written(warm.residual_parts(parts_k, unit_rhs, nominal), "residuals")
        sensitivities = solve.solve(self.csr(), residuals, ["p", "tag"], warm.TOLERANCE).select("p", "tag", "node", "v")
        basis = written(warm.orthonormal(written(sensitivities, "sensitivities"), tags), "basis")
        e, g = (written(df, "projections") for df in warm.projections(basis, parts_k, self.tissues, residuals))
        return warm.starts(nominal, basis, written(warm.corrections(e, g, sigmas), "corrections"), sigmas)

    # ---- search -------------------------------------------------------------------------------------------------

    def adjoint(self, roi: DataFrame, directions: DataFrame) -> DataFrame:
        """``d, node, wx, wy, wz``: node weights whose sum against any nodal dA/dt is the region's mean field along d."""
        target = roi.crossJoin(F.broadcast(directions))
        pull = self.corners.join(target, "e").groupBy("d", "node").agg(F.sum(F.col("w") * (F.col("dx") * F.col("gx") + F.col("dy") * F.col("gy") + F.col("dz") * F.col("gz"))).alias("b"))
        solved = solve.solve(self.csr(), pull, ["d"], solve.ADJOINT_TOLERANCE, solve.ADJOINT_ITERATIONS)
        lam = solve.with_ground(solved, self.ground, ["d"])
        s = F.col("v") * F.col("vol") * F.col("sigma")
        we = self.corners.join(lam, "node").groupBy("d", "e").agg(*[F.sum(s * F.col(f"g{a}")).alias(f"w{a}") for a in "xyz"])
        own = target.select("d", "e", *[(-F.col("w") * F.col(f"d{a}")).alias(f"w{a}") for a in "xyz"])
        both = we.unionByName(own).groupBy("d", "e").agg(*[F.sum(f"w{a}").alias(f"w{a}") for a in "xyz"])
        return self.corners.select("e", "node").join(both, "e").groupBy("d", "node").agg(*[(0.25 * F.sum(f"w{a}")).alias(f"w{a}") for a in "xyz"])

    def exact_functional(self, weights: DataFrame, nodal: DataFrame, by: tuple[str, ...] = ("p",)) -> DataFrame:
        """``by, d, e``: the region's mean field along each direction, without a grid."""
        return self._held(weights).join(nodal, "node").groupBy(*by, "d").agg(F.sum(dot(vec("w"), vec("a"))).alias("e"))

    def sample_qfield(self, weights: DataFrame, grid: dict) -> DataFrame:
        """``d, ix, iy, iz, qx, qy, qz``: the dipole kernel with nodes as sources, at every grid point."""
        points = search.grid_points(self.spark, grid).withColumn("g", F.struct("ix", "iy", "iz"))
        sources = weights.join(self.nodes, "node").select("d", *[(F.col(a) * 1e-3).alias(f"s{a}") for a in "xyz"], *[F.col(f"w{a}").alias(f"m{a}") for a in "xyz"])
        q = source.dipole_field(points, sources, 1.0, ("d",), "g")
        return q.select("d", "g.ix", "g.iy", "g.iz", *[F.col(f"a{a}").alias(f"q{a}") for a in "xyz"])

    def coverage_grid(self, placements: DataFrame, dipoles: DataFrame, spacing: float = 3.0, margin: float = 8.0) -> dict:
        """The grid that covers every dipole of every placement with a margin, in mm."""
        placed = source.place_dipoles(self.frames(placements), dipoles)
        return search.grid_shape(placed.select(*[(F.col(f"s{a}") * 1e3).alias(a) for a in "xyz"]), spacing, margin)

    def optimize_placement(self, placements: DataFrame, dipoles: DataFrame, rate: float, roi: DataFrame, directions: DataFrame, angles: int = 9, fine: int = 512, spacing: float = 3.0) -> DataFrame:
        """``p, theta, objective`` of each centre at its best coil angle: samples on a grid, interpolated over angles.

        No field is solved for a candidate: the adjoint is solved once, and candidates are joins against its grid.
        """
        weights = self.adjoint(roi, directions)
        frames = self.frames(placements)
        turns = self.spark.range(angles).select(F.col("id").cast("int").alias("s"))
        a = F.col("s") * (2 * math.pi / angles)
        spun = frames.crossJoin(F.broadcast(turns))
        spun = spun.select("p", "s", *[(F.cos(a) * F.col(f"r{i}0") + F.sin(a) * F.col(f"r{i}1")).alias(f"r{i}0") for i in range(3)], *[(F.cos(a) * F.col(f"r{i}1") - F.sin(a) * F.col(f"r{i}0")).alias(f"r{i}1") for i in range(3)], *[f"r{i}2" for i in range(3)], "ox", "oy", "oz")
        placed = source.place_dipoles(spun.withColumn("p", F.struct("p", "s")), dipoles)
        placed = placed.select(F.col("p.p").alias("p"), F.col("p.s").alias("s"), "j", *[(F.col(f"s{x}") * 1e3).alias(x) for x in "xyz"], "mx", "my", "mz")
        placed = written(placed, "placed")
        grid = search.grid_shape(placed, spacing, spacing)
        e = search.reciprocity(placed, grid, self.sample_qfield(weights, grid), rate, ("p", "s"))
        profile = search.dirichlet(e, ["p", "d"], angles, fine)
        free = directions.count() > 1
        total = search.magnitude_or_component(profile, ("p", "a"), free).withColumnRenamed("objective", "e")
        return search.best_angle(total, ["p"], fine).select("p", "theta", F.col("f0").alias("objective"))
