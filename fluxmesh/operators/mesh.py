"""Geometry of tetrahedral meshes as tables: ``nodes(node,x,y,z)`` in mm, ``tets(e,n0..n3,tag)``, ``tris(t,a,b,c,tag)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxmesh.functions.vectors import add, cross, dot, named, norm, scale, sub, vec
from fluxmesh.model import SKIN_TAG, SURFACE_TAGS, TISSUES

LOCAL = [f"n{i}" for i in range(4)]
#: Ids of one task when rows are numbered in the order of an id.
BLOCK = 1 << 20


def numbered(rows: DataFrame, block: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 in ``order`` as the int column ``name``.

    ``block`` must never fall along that order. Blocks are numbered apart, only their counts meet in one task.
    """
    rows = rows.withColumn("_block", block)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    out = rows.withColumn("_place", place).join(before, "_block")
    return out.withColumn(name, (F.col("_place") + F.col("_before")).cast("int")).drop("_block", "_place", "_before")


def id_block(column: str) -> Column:
    return F.floor(F.col(column) / BLOCK)


def with_nodes(rows: DataFrame, nodes: DataFrame, ids: list[str]) -> DataFrame:
    """``rows`` with the coordinates of each id column, as ``<id>x, <id>y, <id>z``."""
    for n in ids:
        rows = rows.join(nodes.select(F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("z").alias(f"{n}z")), n)
    return rows


def gradients(nodes: DataFrame, tets: DataFrame) -> DataFrame:
    """``e, tag, n0..n3, g0x..g3z`` (1/m), ``vol`` (m3): gradients of the linear shape functions."""
    r = with_nodes(tets, nodes, LOCAL)
    t1, t2, t3 = (sub(vec(f"n{i}"), vec("n0")) for i in (1, 2, 3))
    faces = cross(t2, t3), cross(t3, t1), cross(t1, t2)
    det = dot(t1, faces[0])
    r = r.select("e", "tag", *LOCAL, det.alias("_det"), *[c for i, f in enumerate(faces, 1) for c in named(f, f"_f{i}")])
    g = [scale(tuple(c / F.col("_det") for c in vec(f"_f{i}")), F.lit(1e3)) for i in (1, 2, 3)]
    g0 = scale(add(add(g[0], g[1]), g[2]), F.lit(-1.0))
    return r.select("e", "tag", *LOCAL, *[c for i, v in enumerate([g0, *g]) for c in named(v, f"g{i}")], (F.abs("_det") * 1e-9 / 6).alias("vol"))


def corners(grads: DataFrame) -> DataFrame:
    """``c = 4e + i, e, i, node, tag, gx, gy, gz, vol``: a row for each corner of each element."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("node"), *[F.col(f"g{i}{a}").alias(f"g{a}") for a in "xyz"]) for i in range(4)])).alias("q")
    return grads.select("e", "tag", "vol", each).select((F.col("e") * 4 + F.col("q.i")).cast("long").alias("c"), "e", "q.i", "q.node", "tag", "q.gx", "q.gy", "q.gz", "vol")


def node_corners(elements: DataFrame, ids: list[str], key: str = "e") -> DataFrame:
    """``node, c``: the corners at each node, numbered ``k * key + position``."""
    return elements.select(key, F.posexplode(F.array(*ids)).alias("i", "node")).select("node", (F.col(key) * len(ids) + F.col("i")).cast("long").alias("c"))


def barycentres(nodes: DataFrame, tets: DataFrame) -> DataFrame:
    """``e, bx, by, bz``."""
    r = with_nodes(tets.select("e", *LOCAL), nodes, LOCAL)
    return r.select("e", *[((F.col(f"n0{a}") + F.col(f"n1{a}") + F.col(f"n2{a}") + F.col(f"n3{a}")) / 4).alias(f"b{a}") for a in "xyz"])


# Shifts and masks that spread 21 bits to every third place.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def morton_keys(nodes: DataFrame) -> DataFrame:
    """``node, key``: bits of the coordinates in the bounding box, interleaved."""
    box = nodes.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    key = F.lit(0).cast("long")
    for shift, a in enumerate("xyz"):
        span = F.greatest(F.col(f"hi{a}") - F.col(f"lo{a}"), F.lit(1e-12))
        q = F.floor((F.col(a) - F.col(f"lo{a}")) / span * F.lit(float(2**21 - 1))).cast("long")
        for by, mask in SPREAD:
            q = q.bitwiseOR(F.shiftleft(q, by)).bitwiseAND(F.lit(mask))
        key = key.bitwiseOR(F.shiftleft(q, shift))
    return nodes.crossJoin(F.broadcast(box)).select("node", key.alias("key"))


def renamed(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` whose id ``columns`` are looked up in ``ids(node, new_node)``, in their old places."""
    names = rows.columns
    for n in columns:
        rows = rows.join(ids.select(F.col("node").alias(n), F.col("new_node").alias(f"_{n}")), n).drop(n).withColumnRenamed(f"_{n}", n)
    return rows.select(names)


def curve_order(nodes: DataFrame) -> DataFrame:
    """``node, new_node``: nodes along the Morton curve."""
    # The upper third of the key's 63 bits: at most 2^20 blocks, neighbours in space.
    return numbered(morton_keys(nodes), F.shiftright("key", 43), ["key", "node"], "new_node").select("node", "new_node")


def _by_lowest(tets: DataFrame) -> DataFrame:
    """``tets`` with ``new_e``: their place by lowest node, then element."""
    low = tets.withColumn("low", F.least(*LOCAL))
    return numbered(low, id_block("low"), ["low", "e"], "new_e").drop("low")


def spatial_order(nodes: DataFrame, tets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, new_node``, ``e, new_e``): nodes along the Morton curve, elements by their lowest new node."""
    ids = curve_order(nodes)
    return ids, _by_lowest(renamed(tets.select("e", *LOCAL), ids, LOCAL)).select("e", "new_e")


def reordered(nodes: DataFrame, tets: DataFrame, tris: DataFrame | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, tets, tris) numbered along the Morton curve: nodes by their place on it, elements by their lowest node.

    A row's own nodes keep their order, and so its orientation; triangles keep their numbers. Nodes that no element
    uses take part as well. ``ids`` is ``curve_order(nodes)``, which is looked up for every column: keep it where the
    results are used more than once.
    """
    ids = curve_order(nodes) if ids is None else ids
    moved = nodes.join(ids, "node").select(F.col("new_node").alias("node"), "x", "y", "z")
    elements = _by_lowest(renamed(tets.select("e", *LOCAL, "tag"), ids, LOCAL)).select(F.col("new_e").alias("e"), *LOCAL, "tag")
    return moved, elements, renamed(tris, ids, ["a", "b", "c"]) if tris is not None else None


def faces(tets: DataFrame) -> DataFrame:
    """``e, opposite, a, b, c``: the four faces of every element with sorted node ids."""
    parts = []
    for k in range(4):
        three = F.array_sort(F.array(*[n for i, n in enumerate(LOCAL) if i != k]))
        parts.append(F.struct(F.col(f"n{k}").alias("opposite"), three[0].alias("a"), three[1].alias("b"), three[2].alias("c")))
    return tets.select("e", F.explode(F.array(*parts)).alias("f")).select("e", "f.*")


def outer_faces(tets: DataFrame) -> DataFrame:
    """``a, b, c, opposite``: faces of exactly one element."""
    return faces(tets).groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.min("opposite").alias("opposite")).where("n = 1").drop("n")


def outer_boundary(tets: DataFrame) -> DataFrame:
    return outer_faces(tets).select(F.explode(F.array("a", "b", "c")).alias("node")).distinct()


def skin_triangles(nodes: DataFrame, tets: DataFrame, tag: int = 1005) -> DataFrame:
    """``t, a, b, c, tag``: the outer faces, wound so that their normals point away from the element."""
    r = with_nodes(outer_faces(tets), nodes, ["a", "b", "c", "opposite"])
    n = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    inward = dot(n, sub(vec("opposite"), vec("a"))) > 0
    return numbered(r, id_block("a"), ["a", "b", "c"], "t").select("t", "a", F.when(inward, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(inward, F.col("b")).otherwise(F.col("c")).alias("c"), F.lit(tag).alias("tag"))


def tissue_boundary(tets: DataFrame) -> DataFrame:
    """Outer nodes, and nodes of elements of several tags."""
    mixed = tets.select("tag", F.explode(F.array(*LOCAL)).alias("node")).groupBy("node").agg(F.count_distinct("tag").alias("n")).where("n > 1").select("node")
    return outer_boundary(tets).union(mixed).distinct()


def tissue_slots(tets: DataFrame) -> DataFrame:
    """``slot, node, tag``: the distinct (node, tag), numbered in that order."""
    pairs = tets.select("tag", F.explode(F.array(*LOCAL)).alias("node")).distinct()
    return numbered(pairs, id_block("node"), ["node", "tag"], "slot").select("slot", "node", "tag")


def _normalised(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """``key`` and the vector ``s`` at length one, as ``prefix``; a zero vector stays zero."""
    r = rows.select(key, *named(vec("s"), "s"), norm(vec("s")).alias("long"))
    return r.select(key, *[F.when(F.col("long") > 0, c / F.col("long")).otherwise(0.0).alias(f"{prefix}{x}") for c, x in zip(vec("s"), "xyz", strict=True)])


def skin_normals(nodes: DataFrame, tris: DataFrame, rounds: int = 2) -> DataFrame:
    """``t, nx, ny, nz``: face normals, smoothed over the nodes and back ``rounds`` times.

    The first sums weigh faces by area, the later ones do not.
    """
    r = with_nodes(tris, nodes, ["a", "b", "c"])
    face = r.select("t", "a", "b", "c", *named(cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a"))), "f"))
    ids = face.select("t", F.explode(F.array("a", "b", "c")).alias("node"))
    cur = face.select("t", "fx", "fy", "fz")
    for k in range(rounds):
        at_nodes = ids.join(cur, "t").groupBy("node").agg(*[F.sum(f"f{a}").alias(f"s{a}") for a in "xyz"])
        if k:
            at_nodes = _normalised(at_nodes, "node", "s")
        summed = ids.join(at_nodes, "node").groupBy("t").agg(*[F.sum(f"s{a}").alias(f"s{a}") for a in "xyz"])
        cur = _normalised(summed, "t", "f")
    return cur.select("t", F.col("fx").alias("nx"), F.col("fy").alias("ny"), F.col("fz").alias("nz"))


# ---- validation and clean-up ------------------------------------------------------------------------------------


def known_surfaces(tris: DataFrame) -> DataFrame:
    """Triangles of known surface tags; others are dropped."""
    return tris.where(F.col("tag").isin(SURFACE_TAGS))


def skin_surface(tris: DataFrame) -> DataFrame:
    """The triangles on which coils are placed; surfaces inside the head are not."""
    return tris.where(F.col("tag") == SKIN_TAG)


def unknown_tags(tets: DataFrame) -> DataFrame:
    """``tag, n`` of elements whose tag is no tissue."""
    return tets.where(~F.col("tag").isin([t[0] for t in TISSUES])).groupBy("tag").agg(F.count("*").alias("n"))


def require_known_tags(tets: DataFrame) -> DataFrame:
    bad = unknown_tags(tets).orderBy("tag").limit(20).collect()
    if bad:
        raise ValueError("unknown volume tags: " + ", ".join(f"{r.tag} ({r.n})" for r in bad))
    return tets


def reindex(nodes: DataFrame, tets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes that no element uses and number the rest from 0 in their order; ids without a node raise."""
    used = tets.select(F.explode(F.array(*LOCAL)).alias("node")).distinct()
    if used.join(nodes, "node", "left_anti").limit(1).count():
        raise ValueError("an element refers to a node that is not there")
    kept = nodes.join(used, "node", "left_semi")
    ids = numbered(kept.select("node"), id_block("node"), ["node"], "new_node")
    new_nodes = kept.join(ids, "node").select(F.col("new_node").alias("node"), "x", "y", "z")
    for n in LOCAL:
        tets = tets.join(ids.select(F.col("node").alias(n), F.col("new_node").alias(f"_{n}")), n).drop(n).withColumnRenamed(f"_{n}", n)
    return new_nodes, tets.select("e", *LOCAL, "tag")


def used_nodes(nodes: DataFrame, tets: DataFrame) -> DataFrame:
    return nodes.join(tets.select(F.explode(F.array(*LOCAL)).alias("node")), "node", "left_semi")


def require_finite(nodes: DataFrame, tets: DataFrame) -> DataFrame:
    """Raise for a coordinate that is not finite, of a node that an element uses."""
    bad = [F.isnan(a) | (F.abs(a) == float("inf")) | F.col(a).isNull() for a in "xyz"]
    used = tets.select(F.explode(F.array(*LOCAL)).alias("node"))
    if nodes.where(bad[0] | bad[1] | bad[2]).join(used, "node", "left_semi").limit(1).count():
        raise ValueError("a node has a coordinate that is not finite")
    return nodes


def require_volumes(grads: DataFrame) -> DataFrame:
    if grads.where(F.isnan("vol") | (F.col("vol") <= 0) | F.col("vol").isNull() | (F.col("vol") == float("inf"))).limit(1).count():
        raise ValueError("an element has no volume")
    return grads


def crop(nodes: DataFrame, tets: DataFrame, tris: DataFrame, centre: tuple[float, float, float], radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The elements whose barycentre lies in a ball, their nodes renumbered, and the triangles wholly kept."""
    d2 = sum(((F.col(f"b{a}") - F.lit(float(v))) ** 2 for a, v in zip("xyz", centre, strict=True)), F.lit(0.0))
    kept = tets.join(barycentres(nodes, tets).where(d2 <= radius * radius).select("e"), "e", "left_semi")
    used = kept.select(F.explode(F.array(*LOCAL)).alias("node")).distinct()
    ids = numbered(used, id_block("node"), ["node"], "new_node")
    new_nodes, new_tets = reindex(nodes, kept)
    for n in ("a", "b", "c"):
        tris = tris.join(ids.select(F.col("node").alias(n), F.col("new_node").alias(f"_{n}")), n).drop(n).withColumnRenamed(f"_{n}", n)
    return new_nodes, new_tets, tris.select("t", "a", "b", "c", "tag")
