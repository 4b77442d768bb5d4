"""Sparse matrices as (r, c, v) rows: assembly and products are joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmesh.functions.vectors import dot, vec


def conductivity(rows: DataFrame, tissues: DataFrame) -> DataFrame:
    """``rows`` with ``sigma`` of their tag; a tag without one raises when the row is read."""
    joined = rows.join(F.broadcast(tissues.select(F.col("tag").alias("_tag"), "sigma")), F.col("tag") == F.col("_tag"), "left").drop("_tag")
    return joined.withColumn("sigma", F.coalesce("sigma", F.raise_error(F.concat(F.lit("no conductivity for tag "), F.col("tag").cast("string"))).cast("double")))


def stiffness(corners: DataFrame, by: tuple[str, ...] = (), deterministic: bool = False) -> DataFrame:
    """``r, c, v``: sums of ``vol * sigma * (grad i . grad j)``; ``by`` adds group columns such as the tag.

    ``corners`` needs ``sigma`` (1 for unit matrices). With ``deterministic`` the terms of an entry are added in element
    order, so a result does not depend on the partitioning; an entry has as many terms as elements share its edge.
    """
    a = corners.select("e", F.col("node").alias("r"), *[F.col(f"g{x}").alias(f"a{x}") for x in "xyz"], (F.col("vol") * F.col("sigma")).alias("s"), *by)
    b = corners.select("e", F.col("node").alias("c"), *[F.col(f"g{x}").alias(f"b{x}") for x in "xyz"])
    terms = a.join(b, "e").select(*by, "r", "c", "e", (F.col("s") * dot(vec("a"), vec("b"))).alias("v"))
    if deterministic:
        ordered = F.array_sort(F.collect_list(F.struct("e", "v")))
        return terms.groupBy(*by, "r", "c").agg(F.aggregate(ordered, F.lit(0.0), lambda t, x: t + x["v"]).alias("v"))
    return terms.groupBy(*by, "r", "c").agg(F.sum("v").alias("v"))


def unit_parts(grads: DataFrame, tags: list[int]) -> DataFrame:
    """``r, c, v<tag>...``: the unit stiffness of each of ``tags`` as columns, null where no such element has the entry.

    An element's sixteen terms come from its own row of ``grads``, without a join; sums combine before they are shuffled.
    """
    terms = F.array(*[F.struct(F.col(f"n{i}").alias("r"), F.col(f"n{j}").alias("c"), (F.col("vol") * dot(vec(f"g{i}"), vec(f"g{j}"))).alias("v")) for i in range(4) for j in range(4)])
    rows = grads.where(F.col("tag").isin(tags)).select("tag", F.explode(terms).alias("q")).select("tag", "q.r", "q.c", "q.v")
    return rows.groupBy("r", "c").agg(*[F.sum(F.when(F.col("tag") == t, F.col("v"))).alias(f"v{t}") for t in tags])


def incident_nodes(corners: DataFrame) -> DataFrame:
    """``node, other``: the pattern, distinct nodes that share an element."""
    a = corners.select("e", "node")
    return a.join(a.select("e", F.col("node").alias("other")), "e").select("node", "other").distinct()


def ground_node(nodes: DataFrame) -> DataFrame:
    """One row: the lowest node, the first of equals."""
    return nodes.agg(F.min(F.struct("z", "node")).alias("g")).select(F.col("g.node").alias("ground"))


def reduce_matrix(k: DataFrame, ground: DataFrame) -> DataFrame:
    """The matrix without the ground row and column."""
    columns = k.columns
    for axis in ("r", "c"):
        k = k.join(F.broadcast(ground.select(F.col("ground").alias(axis))), axis, "left_anti")  # one row
    return k.select(columns)


def l1_inverse(k: DataFrame) -> DataFrame:
    """``r, d``: one over the row's absolute sum, with the diagonal's sign; 0 counts as 1."""
    rows = k.groupBy("r").agg(F.sum(F.abs("v")).alias("s"), F.max(F.when(F.col("r") == F.col("c"), F.col("v"))).alias("diag"))
    signed = F.when(F.coalesce("diag", F.lit(0.0)) < 0, -F.col("s")).otherwise(F.col("s"))
    return rows.select("r", (1.0 / F.when(signed == 0, F.lit(1.0)).otherwise(signed)).alias("d"))


def spmv(k: DataFrame, x: DataFrame) -> DataFrame:
    """``r, y``: matrix times ``x(node, v)``."""
    return k.join(x.select(F.col("node").alias("c"), F.col("v").alias("xv")), "c").groupBy("r").agg(F.sum(F.col("v") * F.col("xv")).alias("y"))


def inner(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: the dot product of two node vectors."""
    return x.select("node", F.col("v").alias("xv")).join(y.select("node", F.col("v").alias("yv")), "node").agg(F.sum(F.col("xv") * F.col("yv")).alias("dot"))


def axpy(a, x: DataFrame, y: DataFrame) -> DataFrame:
    """``a * x + y``; nodes absent from one side count as zero there."""
    j = x.select("node", F.col("v").alias("xv")).join(y.select("node", F.col("v").alias("yv")), "node", "full")
    return j.select("node", (F.lit(a) * F.coalesce("xv", F.lit(0.0)) + F.coalesce("yv", F.lit(0.0))).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """``r, c, v``: product of two sparse matrices."""
    return a.select("r", F.col("c").alias("k"), F.col("v").alias("av")).join(b.select(F.col("r").alias("k"), "c", F.col("v").alias("bv")), "k").groupBy("r", "c").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def tentative_prolongator(aggregates: DataFrame) -> DataFrame:
    """``r, c, v`` of ``aggregates(node, agg)``: one column for each aggregate, of unit length."""
    size = aggregates.groupBy("agg").agg(F.count("*").alias("n"))
    return aggregates.join(size, "agg").select(F.col("node").alias("r"), F.col("agg").alias("c"), (1.0 / F.sqrt(F.col("n").cast("double"))).alias("v"))


def smooth_prolongator(k: DataFrame, p0: DataFrame, omega: float = 4.0 / 3.0) -> DataFrame:
    """``(I - omega * L1^-1 * K) * P0``."""
    scaled = k.join(l1_inverse(k), "r").select("r", "c", (F.lit(-omega) * F.col("d") * F.col("v")).alias("v"))
    return p0.select("r", "c", "v").unionByName(matmul(scaled, p0)).groupBy("r", "c").agg(F.sum("v").alias("v"))


def galerkin(k: DataFrame, p: DataFrame) -> DataFrame:
    """``P' K P``."""
    return matmul(transpose(p), matmul(k, p))


# ---- element and node sums --------------------------------------------------------------------------------------


def element_means(nodal: DataFrame, corners: DataFrame, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Means of nodal values over the four corners of each element."""
    return corners.select("e", "node").join(nodal, "node").groupBy(*by, "e").agg(*[(F.sum(v) / 4).alias(v) for v in values])


def rhs(corners: DataFrame, dadt: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``node, b``: ``sum of -vol * sigma * (dA/dt . grad)``; ``by`` holds group columns of either side."""
    j = corners.join(dadt.select(*[c for c in by if c in dadt.columns], "e", "ax", "ay", "az"), "e")
    return j.groupBy(*by, "node").agg(F.sum(-F.col("vol") * F.col("sigma") * dot(vec("a"), vec("g"))).alias("b"))


def reconstruct(corners: DataFrame, potential: DataFrame, dadt: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``e, ex, ey, ez, magn``: minus the gradient of the potential, minus dA/dt."""
    g = corners.join(potential, "node").groupBy(*by, "e").agg(*[F.sum(-F.col("v") * F.col(f"g{a}")).alias(f"e{a}") for a in "xyz"])
    if dadt is not None:
        g = g.join(dadt, [*by, "e"]).select(*by, "e", *[(F.col(f"e{a}") - F.col(f"a{a}")).alias(f"e{a}") for a in "xyz"])
    return g.withColumn("magn", F.sqrt(dot(vec("e"), vec("e"))))


def element_weight(corners: DataFrame, potential: DataFrame) -> DataFrame:
    """``e, wx, wy, wz``: ``vol * sigma * sum of v * grad``."""
    s = F.col("v") * F.col("vol") * F.col("sigma")
    return corners.join(potential, "node").groupBy("e").agg(*[F.sum(s * F.col(f"g{a}")).alias(f"w{a}") for a in "xyz"])


def node_gather(corner_values: DataFrame) -> DataFrame:
    """``node, v``: sums of the values at each node's corners."""
    return corner_values.groupBy("node").agg(F.sum("v").alias("v"))


def node_scatter(corners: DataFrame, elements: DataFrame) -> DataFrame:
    """``node, wx, wy, wz``: a quarter of the vectors of the elements at each node."""
    return corners.select("e", "node").join(elements, "e").groupBy("node").agg(*[(F.sum(f"w{a}") * 0.25).alias(f"w{a}") for a in "xyz"])
