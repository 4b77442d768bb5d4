"""A mesh on disk by place: rows along the Morton curve, a folder for each stretch of it, and the bounds of each folder.

``nodes`` and ``tets`` are partitioned by ``block``, a stretch of equally many nodes; ``bounds`` has a row a block. A read
looks up the blocks that a request can touch and names them in the filter, so folders of other places are not listed,
opened or read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmesh.operators import mesh, spatial
from fluxmesh.sources.scratch import written

#: Nodes of a block: some six times as many elements, 400 bytes a node altogether.
BLOCK_NODES = 1 << 18
#: Blocks that a filter names; a request that touches more joins them instead.
NAMED_BLOCKS = 10_000
#: Folders of a table: the driver lists them all, so a mesh of more blocks takes larger ones.
MOST_BLOCKS = 2048


def write_layout(nodes: DataFrame, tets: DataFrame, tris: DataFrame | None, path: str, block_nodes: int = BLOCK_NODES) -> None:
    """Write the reordered mesh below ``path``: ``nodes``, ``tets`` (with barycentres), ``tris`` and ``bounds``.

    A block has ``block_nodes`` nodes, or as many more as keep the folders at ``MOST_BLOCKS``.
    """
    # Written, not cached: a cached table's plan stands in every plan that reads it, and would fill the driver.
    ids = written(mesh.curve_order(nodes), "curve")
    block_nodes = max(block_nodes, -(-ids.count() // MOST_BLOCKS))
    nodes, tets, tris = mesh.reordered(nodes, tets, tris, ids)
    tets = written(tets, "moved")

    def put(rows: DataFrame, place, order: str, name: str) -> None:
        rows = rows.withColumn("block", F.floor(place / block_nodes).cast("int"))
        rows.repartition("block").sortWithinPartitions("block", order).write.partitionBy("block").parquet(f"{path}/{name}")

    put(nodes, F.col("node"), "node", "nodes")
    nodes = nodes.sparkSession.read.parquet(f"{path}/nodes")
    put(tets.join(mesh.barycentres(nodes, tets), "e"), F.least(*mesh.LOCAL), "e", "tets")
    if tris is not None:
        put(tris, F.least("a", "b", "c"), "t", "tris")
    found = nodes.sparkSession.read.parquet(f"{path}/tets").groupBy("block")
    found.agg(F.count("*").alias("n"), *[f(f"b{a}").alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).coalesce(1).write.parquet(f"{path}/bounds")


def _blocks(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``elements`` in ``blocks``, which prune folders."""
    named = [r.block for r in blocks.limit(NAMED_BLOCKS + 1).collect()]
    if len(named) <= NAMED_BLOCKS:
        return elements.where(F.col("block").isin(named))
    return elements.join(blocks, "block", "left_semi")


def read_region(spark: SparkSession, path: str, low: tuple[float, float, float], high: tuple[float, float, float], name: str = "tets") -> DataFrame:
    """Elements whose barycentre lies in the box; only the folders whose bounds meet it are read."""
    meets, inside = F.lit(True), F.lit(True)
    for a, lo, hi in zip("xyz", low, high, strict=True):
        meets = meets & (F.col(f"lo{a}") <= F.lit(float(hi))) & (F.col(f"hi{a}") >= F.lit(float(lo)))
        inside = inside & F.col(f"b{a}").between(F.lit(float(lo)), F.lit(float(hi)))
    blocks = spark.read.parquet(f"{path}/bounds").where(meets).select("block")
    return _blocks(spark.read.parquet(f"{path}/{name}"), blocks).where(inside)


def elements_near(spark: SparkSession, path: str, points: DataFrame, radius: float) -> DataFrame:
    """``points(p, cx, cy, cz)`` with the elements whose barycentre lies within ``radius``, and ``d2``.

    Points meet the blocks' bounds first; folders that no point's ball meets are not read.
    """
    points = points.withColumn("reach", F.lit(float(radius)))
    bounds = spark.read.parquet(f"{path}/bounds")
    corners = bounds.select(*[F.col(f"lo{a}").alias(a) for a in "xyz"], F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"]).alias("extent"))
    coarse = spatial.Pyramid.over(corners, F.avg("extent"))
    elements = spark.read.parquet(f"{path}/tets")
    if coarse is None:
        return points.limit(0).crossJoin(elements.limit(0)).withColumn("d2", F.lit(0.0))
    touched = spatial.ball_pairs(points, bounds, coarse).select("block").distinct()
    near = _blocks(elements, touched)
    fine = spatial.Pyramid(coarse.low, coarse.high, 2.0 * max(radius, 1e-9), 0)
    boxes = near.select("*", *[F.col(f"b{a}").alias(f"{n}{a}") for a in "xyz" for n in ("lo", "hi")])
    off = [F.col(f"b{a}") - F.col(f"c{a}") for a in "xyz"]
    pairs = spatial.ball_pairs(points, boxes, fine).withColumn("d2", off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    return pairs.where(F.col("d2") <= radius * radius).drop("reach", *[f"{n}{a}" for a in "xyz" for n in ("lo", "hi")])
