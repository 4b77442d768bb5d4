"""Mesh, sparse, coil, recovery and search queries over a mesh that grows with the tables: a layer for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxmesh.model import TISSUES, clean, clean_scaled, tissue_table
from fluxmesh.operators import ensemble, mesh, metrics, recovery, search, source, sparse
from fluxmesh.plans.registry import query
from fluxmesh.sources import synth
from fluxmesh.sources.scratch import written

# ---- SQL of the generated tables and of the shared steps --------------------------------------------------------

_JIT = "CASE WHEN iy BETWEEN 1 AND 3 AND iz IN (1, 3) THEN (((node::BIGINT*7919 + {a}*104729 + nk*31) % 1009)/1009e0 - 0.5e0)*0.5e0*25e0 ELSE 0e0 END"
MESH = (
    "i3 AS (SELECT (25*s_suppkey+q)::INT node, s_suppkey::BIGINT ix, q // 5 iy, q % 5 iz, s_nationkey::BIGINT nk FROM supplier, range(25) t(q)),"
    + f" nodes AS (SELECT node, ix*25e0 + {_JIT.format(a=1)} x, iy*25e0 + {_JIT.format(a=2)} y, iz*25e0 + {_JIT.format(a=3)} z FROM i3),"
    + """ paths(k, a, b) AS (VALUES (0,1,5),(1,1,25),(2,5,1),(3,5,25),(4,25,1),(5,25,5)),
 cells AS (SELECT 16*s_suppkey+q i, s_suppkey ix, q // 4 iy, q % 4 iz FROM supplier, range(16) t(q) WHERE s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)),
 tets AS (SELECT (i*6 + k)::INT e, (25*ix+5*iy+iz)::INT n0, (25*ix+5*iy+iz+a)::INT n1, (25*ix+5*iy+iz+a+b)::INT n2, (25*ix+5*iy+iz+31)::INT n3, CASE WHEN iz < 2 THEN 2 ELSE 3 END tag FROM cells, paths),
 ed AS (SELECT e, n0, n1, n2, n3, tag, p1.x-p0.x ax, p1.y-p0.y ay, p1.z-p0.z az, p2.x-p0.x bx, p2.y-p0.y by_, p2.z-p0.z bz, p3.x-p0.x cx, p3.y-p0.y cy, p3.z-p0.z cz
   FROM tets JOIN nodes p0 ON p0.node=n0 JOIN nodes p1 ON p1.node=n1 JOIN nodes p2 ON p2.node=n2 JOIN nodes p3 ON p3.node=n3),
 cr AS (SELECT *, by_*cz-bz*cy f1x, bz*cx-bx*cz f1y, bx*cy-by_*cx f1z, cy*az-cz*ay f2x, cz*ax-cx*az f2y, cx*ay-cy*ax f2z, ay*bz-az*by_ f3x, az*bx-ax*bz f3y, ax*by_-ay*bx f3z FROM ed),
 dt AS (SELECT *, ax*f1x+ay*f1y+az*f1z det FROM cr),
 gr AS (SELECT e, n0, n1, n2, n3, tag, f1x/det*1e3 g1x, f1y/det*1e3 g1y, f1z/det*1e3 g1z, f2x/det*1e3 g2x, f2y/det*1e3 g2y, f2z/det*1e3 g2z, f3x/det*1e3 g3x, f3y/det*1e3 g3y, f3z/det*1e3 g3z, abs(det)*1e-9/6e0 vol FROM dt),
 co AS (SELECT e, 0 i, n0 node, tag, -(g1x+g2x+g3x) gx, -(g1y+g2y+g3y) gy, -(g1z+g2z+g3z) gz, vol FROM gr UNION ALL SELECT e, 1, n1, tag, g1x, g1y, g1z, vol FROM gr
   UNION ALL SELECT e, 2, n2, tag, g2x, g2y, g2z, vol FROM gr UNION ALL SELECT e, 3, n3, tag, g3x, g3y, g3z, vol FROM gr),
 sg(tag, sigma) AS (VALUES """
    + ",".join(f"({tag},{sigma}e0)" for tag, _, sigma, _ in TISSUES)
    + """),
 cs AS (SELECT co.*, sigma FROM co JOIN sg ON co.tag = sg.tag),
 bary AS (SELECT e, (p0.x+p1.x+p2.x+p3.x)/4e0 bx, (p0.y+p1.y+p2.y+p3.y)/4e0 by_, (p0.z+p1.z+p2.z+p3.z)/4e0 bz FROM tets JOIN nodes p0 ON p0.node=n0 JOIN nodes p1 ON p1.node=n1 JOIN nodes p2 ON p2.node=n2 JOIN nodes p3 ON p3.node=n3),
 fc AS (SELECT e, list_sort([n1,n2,n3]) f, n0 o FROM tets UNION ALL SELECT e, list_sort([n0,n2,n3]), n1 FROM tets UNION ALL SELECT e, list_sort([n0,n1,n3]), n2 FROM tets UNION ALL SELECT e, list_sort([n0,n1,n2]), n3 FROM tets),
 outer_ AS (SELECT f[1] a, f[2] b, f[3] c, min(o) o FROM fc GROUP BY f HAVING count(*) = 1),
 ow AS (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) - 1 t, ((pb.y-pa.y)*(pc.z-pa.z)-(pb.z-pa.z)*(pc.y-pa.y))*(po.x-pa.x)+((pb.z-pa.z)*(pc.x-pa.x)-(pb.x-pa.x)*(pc.z-pa.z))*(po.y-pa.y)+((pb.x-pa.x)*(pc.y-pa.y)-(pb.y-pa.y)*(pc.x-pa.x))*(po.z-pa.z) s
   FROM outer_ JOIN nodes pa ON pa.node=a JOIN nodes pb ON pb.node=b JOIN nodes pc ON pc.node=c JOIN nodes po ON po.node=o),
 tris AS (SELECT t::INT t, a, CASE WHEN s > 0 THEN c ELSE b END b, CASE WHEN s > 0 THEN b ELSE c END c, 1005 tag FROM ow),
 corner_nodes AS (SELECT n0 node, tag FROM tets UNION ALL SELECT n1, tag FROM tets UNION ALL SELECT n2, tag FROM tets UNION ALL SELECT n3, tag FROM tets),
 slots AS (SELECT (row_number() OVER (ORDER BY node, tag) - 1)::INT slot, node, tag FROM (SELECT DISTINCT node, tag FROM corner_nodes)),
 pot AS (SELECT (25*s_suppkey+q)::INT node, s_acctbal*1e-3*sqrt(q+2e0) v FROM supplier, range(25) t(q)),
 dadt AS (SELECT e, 0.01e0*sqrt(by_+0.3e0) ax, -0.01e0*sqrt(bx+0.3e0) ay, 0.001e0*sqrt(bz+0.3e0) az FROM bary)"""
)
KM = "k AS (SELECT a.node r, b.node c, sum(a.vol*a.sigma*(a.gx*b.gx+a.gy*b.gy+a.gz*b.gz)) v FROM cs a JOIN cs b ON a.e = b.e GROUP BY 1, 2), g AS (SELECT node ground FROM nodes ORDER BY z, node LIMIT 1)"
PLACE = """pl AS (SELECT c_custkey::INT p, 25e0*(c_custkey//15)+25e0*((c_custkey*37)%100)/100e0 cx, 20e0+60e0*((c_custkey*53)%100)/100e0 cy, 101e0+c_acctbal*1e-4 cz FROM customer),
 placements AS (SELECT p, cx, cy, cz, cx hx, cy+50e0 hy, 100e0 hz, 4e0 dist FROM pl),
 dip AS (SELECT p_partkey::INT j, (p_partkey%6-2.5e0)*0.008e0 sx, (p_partkey//6%5-2e0)*0.008e0 sy, 0e0 sz, (p_partkey%3)*0.001e0 mx, 0e0 my, p_size*0.01e0 mz FROM part)"""


def sql(select: str, *more: str) -> str:
    return "WITH " + ", ".join([MESH, *more]) + " " + select


def R(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr},{digits})+0e0 AS {name}"


def out(df, keys, digits=6):
    return df.select(*keys, *[clean(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys])


# ---- the same tables in Spark -----------------------------------------------------------------------------------


class Tables:
    """The mesh and request tables of one call, all lazy but those named in ``kept``: these are written once, for queries
    that read them several times. Repeated, the plan of the mesh would fill the driver."""

    def __init__(self, spark, sf_dir, *kept):
        keep = lambda name, df: written(df, name) if name in kept else df
        self.spark = spark
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        customers = read("customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
        suppliers = read("supplier")
        self.nodes, self.tets = synth.bar_nodes(suppliers), synth.bar_tets(suppliers)
        self.grads = keep("grads", mesh.gradients(self.nodes, self.tets))
        self.corners = sparse.conductivity(mesh.corners(self.grads), tissue_table(spark))
        self.bary = keep("bary", mesh.barycentres(self.nodes, self.tets))
        self.slots = keep("slots", mesh.tissue_slots(self.tets).withColumn("slot", F.col("slot").cast("int")))
        self.potential = synth.bar_potential(suppliers)
        self.dadt = self.bary.select("e", *[(k * F.sqrt(F.col(f"b{b}") + 0.3)).alias(f"a{a}") for k, b, a in ((0.01, "y", "x"), (-0.01, "x", "y"), (0.001, "z", "z"))])
        self.placements = synth.bar_placements(customers)
        self.dipoles = synth.dipoles_of(read("part"), "p_partkey", "p_size")

    @property
    def tris(self):
        return mesh.skin_triangles(self.nodes, self.tets).withColumn("t", F.col("t").cast("int"))

    @property
    def k(self):
        return sparse.stiffness(self.corners)


# ---- geometry ---------------------------------------------------------------------------------------------------

G_COLS = [f"g{i}{a}" for i in range(4) for a in "xyz"]


@query(sql("SELECT e, tag, " + ", ".join([R(f"-(g1{a}+g2{a}+g3{a})", f"g0{a}") for a in "xyz"] + [R(c, c) for c in G_COLS[3:]]) + " FROM gr"))
def p1_gradients(spark, sf_dir):
    return out(Tables(spark, sf_dir).grads.select("e", "tag", *G_COLS), ["e", "tag"])


@query(sql(f"SELECT e, {R('vol*1e9', 'vol_mm3')} FROM gr"))
def tet_volumes(spark, sf_dir):
    return out(Tables(spark, sf_dir).grads.select("e", (F.col("vol") * 1e9).alias("vol_mm3")), ["e"])


@query(sql(f"SELECT e, {R('bx', 'bx', 9)}, {R('by_', 'by', 9)}, {R('bz', 'bz', 9)} FROM bary"))
def barycentres(spark, sf_dir):
    return out(Tables(spark, sf_dir).bary, ["e"], 9)


_MORTON = ", ".join(
    [f"s{k} AS (SELECT {'node, q0, q1, q2' if k == 0 else 'node'}, " + ", ".join(f"(({c}{i} | (({c}{i} & {(1 << (63 - s)) - 1}) << {s})) & {m}) y{i}" for i, c in ((0, "q" if k == 0 else "y"), (1, "q" if k == 0 else "y"), (2, "q" if k == 0 else "y"))) + f" FROM {'mq' if k == 0 else f's{k - 1}'})" for k, (s, m) in enumerate(mesh.SPREAD)]
)
_KEYS = (
    "mq AS (SELECT node, " + ", ".join(f"floor(({a}-(SELECT min({a}) FROM nodes))/greatest((SELECT max({a})-min({a}) FROM nodes),1e-12)*2097151e0)::BIGINT q{i}" for i, a in enumerate("xyz")) + " FROM nodes), "
    + _MORTON + ", mk AS (SELECT node, y0 | (y1 << 1) | (y2 << 2) key FROM s4)"
)


@query(sql("SELECT node, key FROM mk", _KEYS))
def morton_order(spark, sf_dir):
    return mesh.morton_keys(Tables(spark, sf_dir).nodes)


@query(
    sql(
        "SELECT e, (row_number() OVER (ORDER BY least(a.m,b.m,c.m,d.m), e) - 1)::INT AS new_e FROM tets JOIN nm a ON a.node=n0 JOIN nm b ON b.node=n1 JOIN nm c ON c.node=n2 JOIN nm d ON d.node=n3",
        _KEYS, "nm AS (SELECT node, row_number() OVER (ORDER BY key, node) - 1 m FROM mk)",
    )
)
def spatial_order(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mesh.spatial_order(t.nodes, t.tets)[1].select("e", F.col("new_e").cast("int"))


@query(sql("SELECT node, (4*e+i)::BIGINT AS c FROM co"))
def node_corners(spark, sf_dir):
    return mesh.node_corners(Tables(spark, sf_dir).tets, mesh.LOCAL)


@query(sql("SELECT DISTINCT unnest([a,b,c]) AS node FROM outer_"))
def outer_boundary(spark, sf_dir):
    return mesh.outer_boundary(Tables(spark, sf_dir).tets)


@query(sql("SELECT DISTINCT unnest([a,b,c]) AS node FROM outer_ UNION SELECT node FROM corner_nodes GROUP BY node HAVING count(DISTINCT tag) > 1"))
def tissue_boundary(spark, sf_dir):
    return mesh.tissue_boundary(Tables(spark, sf_dir).tets)


@query(sql("SELECT slot, node, tag FROM slots"))
def tissue_slots(spark, sf_dir):
    return Tables(spark, sf_dir).slots


_N1 = """fn AS (SELECT t, a, b, c, (pb.y-pa.y)*(pc.z-pa.z)-(pb.z-pa.z)*(pc.y-pa.y) fx, (pb.z-pa.z)*(pc.x-pa.x)-(pb.x-pa.x)*(pc.z-pa.z) fy, (pb.x-pa.x)*(pc.y-pa.y)-(pb.y-pa.y)*(pc.x-pa.x) fz
   FROM tris JOIN nodes pa ON pa.node=a JOIN nodes pb ON pb.node=b JOIN nodes pc ON pc.node=c),
 tn AS (SELECT t, unnest([a,b,c]) node FROM tris),
 s1 AS (SELECT node, sum(fx) x, sum(fy) y, sum(fz) z FROM tn JOIN fn ON tn.t = fn.t GROUP BY node),
 f1 AS (SELECT t, sum(x) x, sum(y) y, sum(z) z FROM tn JOIN s1 ON tn.node = s1.node GROUP BY t),
 f1u AS (SELECT t, x/sqrt(x*x+y*y+z*z) x, y/sqrt(x*x+y*y+z*z) y, z/sqrt(x*x+y*y+z*z) z FROM f1),
 s2 AS (SELECT node, sum(x) x, sum(y) y, sum(z) z FROM tn JOIN f1u ON tn.t = f1u.t GROUP BY node),
 s2u AS (SELECT node, x/sqrt(x*x+y*y+z*z) x, y/sqrt(x*x+y*y+z*z) y, z/sqrt(x*x+y*y+z*z) z FROM s2),
 f2 AS (SELECT t, sum(x) x, sum(y) y, sum(z) z FROM tn JOIN s2u ON tn.node = s2u.node GROUP BY t),
 normals AS (SELECT t, x/sqrt(x*x+y*y+z*z) nx, y/sqrt(x*x+y*y+z*z) ny, z/sqrt(x*x+y*y+z*z) nz FROM f2)"""


@query(sql(f"SELECT t, {R('nx', 'nx', 7)}, {R('ny', 'ny', 7)}, {R('nz', 'nz', 7)} FROM normals", _N1))
def skin_normals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(mesh.skin_normals(t.nodes, t.tris), ["t"], 7)


# ---- validation -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS t, (995 + p_size % 20)::INT AS tag FROM part WHERE (995 + p_size % 20) BETWEEN 1001 AND 1010 OR (995 + p_size % 20) = 1099")
def surface_tag_filter(spark, sf_dir):
    tris = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("t"), (995 + F.col("p_size") % 20).cast("int").alias("tag"))
    return mesh.known_surfaces(tris)


@query("SELECT l_orderkey AS o, l_linenumber AS t, (1001 + l_linenumber)::INT AS tag FROM lineitem WHERE l_linenumber = 4")
def skin_filter(spark, sf_dir):
    tris = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("t"), (1001 + F.col("l_linenumber")).cast("int").alias("tag"))
    return mesh.skin_surface(tris)


@query("SELECT (p_size % 17)::INT AS tag, count(*) AS n FROM part WHERE p_size % 17 NOT BETWEEN 1 AND 10 GROUP BY 1")
def unknown_tag_histogram(spark, sf_dir):
    tets = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") % 17).cast("int").alias("tag"))
    return mesh.unknown_tags(tets)


@query(sql("SELECT (row_number() OVER (ORDER BY node) - 1)::INT AS node, x, y, z FROM nodes WHERE node IN (SELECT node FROM corner_nodes WHERE tag = 3)"))
def reindex_nodes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return mesh.reindex(t.nodes, t.tets.where("tag = 3"))[0].select(F.col("node").cast("int"), "x", "y", "z")


@query(sql("SELECT e, tets.tag, sigma FROM tets JOIN sg ON tets.tag = sg.tag"))
def conductivity_lookup(spark, sf_dir):
    return sparse.conductivity(Tables(spark, sf_dir).tets.select("e", "tag"), tissue_table(spark))


# ---- sparse -----------------------------------------------------------------------------------------------------


@query(sql(f"SELECT r, c, {R('v', 'v', 8)} FROM k", KM))
def stiffness_coo(spark, sf_dir):
    return out(Tables(spark, sf_dir).k, ["r", "c"], 8)


@query(sql(f"SELECT a.tag, a.node r, b.node c, {R('sum(a.vol*(a.gx*b.gx+a.gy*b.gy+a.gz*b.gz))', 'v', 8)} FROM co a JOIN co b ON a.e = b.e GROUP BY 1, 2, 3"))
def stiffness_by_tissue(spark, sf_dir):
    return out(sparse.stiffness(Tables(spark, sf_dir).corners.withColumn("sigma", F.lit(1.0)), by=("tag",)), ["tag", "r", "c"], 8)


@query(sql(f"SELECT r, c, {R('v', 'v', 8)} FROM k, g WHERE r <> ground AND c <> ground", KM))
def grounded_reduce(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.reduce_matrix(t.k, sparse.ground_node(t.nodes)), ["r", "c"], 8)


L1 = "l1 AS (SELECT r, 1e0/CASE WHEN max(CASE WHEN r = c THEN v END) < 0 THEN -sum(abs(v)) WHEN sum(abs(v)) = 0 THEN 1e0 ELSE sum(abs(v)) END d FROM k GROUP BY r)"


@query(sql(f"SELECT r, {R('d', 'd')} FROM l1", KM, L1))
def l1_dinv(spark, sf_dir):
    return out(sparse.l1_inverse(Tables(spark, sf_dir).k), ["r"])


@query(sql(f"SELECT r, {R('sum(k.v*pot.v)', 'y', 8)} FROM k JOIN pot ON c = node GROUP BY r", KM))
def spmv(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.spmv(t.k, t.potential), ["r"], 8)


@query(sql("SELECT DISTINCT a.node AS node, b.node AS other FROM co a JOIN co b ON a.e = b.e"))
def incident_nodes(spark, sf_dir):
    return sparse.incident_nodes(Tables(spark, sf_dir).corners)


@query(sql(f"SELECT {R('sum(k.v*a.v*b.v)', 'energy', 3)} FROM k JOIN pot a ON r = a.node JOIN pot b ON c = b.node", KM))
def inner_product(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kx = sparse.spmv(t.k, t.potential).select(F.col("r").alias("node"), F.col("y").alias("v"))
    return out(sparse.inner(kx, t.potential).withColumnRenamed("dot", "energy"), [], 3)


_B = "sum(-vol*sigma*(ax*gx+ay*gy+az*gz))"


@query(sql(f"SELECT node, {R(_B, 'b', 9)} FROM cs JOIN dadt ON cs.e = dadt.e GROUP BY node"))
def rhs_assemble(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.rhs(t.corners, t.dadt), ["node"], 9)


@query(sql(f"SELECT tag, node, {R('sum(-vol*(ax*gx+ay*gy+az*gz))', 'b', 9)} FROM co JOIN dadt ON co.e = dadt.e GROUP BY 1, 2"))
def rhs_by_tissue(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.rhs(t.corners.withColumn("sigma", F.lit(1.0)), t.dadt, by=("tag",)), ["tag", "node"], 9)


EW = "ew AS (SELECT e, sum(v*vol*sigma*gx) wx, sum(v*vol*sigma*gy) wy, sum(v*vol*sigma*gz) wz FROM cs JOIN pot ON cs.node = pot.node GROUP BY e)"


@query(sql(f"SELECT e, {R('wx*1e6', 'wx', 3)}, {R('wy*1e6', 'wy', 3)}, {R('wz*1e6', 'wz', 3)} FROM ew", EW))
def element_weight(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = sparse.element_weight(t.corners, t.potential)
    return out(w.select("e", *[(F.col(c) * 1e6).alias(c) for c in ("wx", "wy", "wz")]), ["e"], 3)


@query(sql(f"SELECT node, {R('sum(vol*sigma)*1e6', 'v', 5)} FROM cs GROUP BY node"))
def node_gather(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.node_gather(t.corners.select("node", (F.col("vol") * F.col("sigma") * 1e6).alias("v"))), ["node"], 5)


@query(sql(f"SELECT node, {R('sum(wx)', 'wx', 9)}, {R('sum(wy)', 'wy', 9)}, {R('sum(wz)', 'wz', 9)} FROM co JOIN ew ON co.e = ew.e GROUP BY node", EW))
def node_scatter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = sparse.node_scatter(t.corners, sparse.element_weight(t.corners, t.potential))
    return out(w.select("node", *[(4 * F.col(c)).alias(c) for c in ("wx", "wy", "wz")]), ["node"], 9)


AGG = "ag AS (SELECT node, node // 4 agg FROM nodes), p0 AS (SELECT node r, ag.agg c, 1e0/sqrt(n::DOUBLE) v FROM ag JOIN (SELECT agg, count(*) n FROM ag GROUP BY agg) s ON ag.agg = s.agg)"
SMOOTH = "p1 AS (SELECT r, c, sum(v) v FROM (SELECT * FROM p0 UNION ALL SELECT k.r, p0.c, -(4e0/3e0)*d*k.v*p0.v FROM k JOIN l1 ON k.r = l1.r JOIN p0 ON k.c = p0.r) GROUP BY r, c)"


def _aggregates(t):
    return t.nodes.select("node", F.floor(F.col("node") / 4).cast("int").alias("agg"))


@query(sql(f"SELECT r, c, {R('v', 'v', 9)} FROM p0", AGG))
def tentative_prolongator(spark, sf_dir):
    return out(sparse.tentative_prolongator(_aggregates(Tables(spark, sf_dir))), ["r", "c"], 9)


@query(sql(f"SELECT r, c, {R('v', 'v', 6)} FROM p1", KM, L1, AGG, SMOOTH))
def smooth_prolongator(spark, sf_dir):
    t = Tables(spark, sf_dir, "grads")
    return out(sparse.smooth_prolongator(written(t.k, "stiffness"), sparse.tentative_prolongator(_aggregates(t))), ["r", "c"], 6)


@query(sql(f"SELECT a.c r, b.c c, {R('sum(a.v*k.v*b.v)', 'v', 6)} FROM p1 a JOIN k ON a.r = k.r JOIN p1 b ON k.c = b.r GROUP BY 1, 2", KM, L1, AGG, SMOOTH))
def galerkin_product(spark, sf_dir):
    t = Tables(spark, sf_dir, "grads")
    k = written(t.k, "stiffness")
    return out(sparse.galerkin(k, written(sparse.smooth_prolongator(k, sparse.tentative_prolongator(_aggregates(t))), "prolongator")), ["r", "c"], 6)


RE = "re AS (SELECT e, sum(-v*gx) x, sum(-v*gy) y, sum(-v*gz) z FROM co JOIN pot ON co.node = pot.node GROUP BY e), fld AS (SELECT re.e, x-ax ex, y-ay ey, z-az ez FROM re JOIN dadt ON re.e = dadt.e)"


@query(sql(f"SELECT e, {R('ex', 'ex', 4)}, {R('ey', 'ey', 4)}, {R('ez', 'ez', 4)}, {R('sqrt(ex*ex+ey*ey+ez*ez)', 'magn', 4)} FROM fld", RE))
def reconstruct_field(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.reconstruct(t.corners, t.potential, t.dadt), ["e"], 4)


# ---- coils ------------------------------------------------------------------------------------------------------

DF = """mv AS (SELECT j, 0.025e0*(j//20)+sx sx, 0.05e0+sy sy, 0.11e0 sz, mx, my, mz FROM dip),
 pr AS (SELECT node, mx, my, mz, x*1e-3-sx dx, y*1e-3-sy dy, z*1e-3-sz dz FROM nodes, mv), pw AS (SELECT *, 1e0/((dx*dx+dy*dy+dz*dz)*sqrt(dx*dx+dy*dy+dz*dz)) w FROM pr),
 da AS (SELECT node, 1e6*1e-7*sum(w*(my*dz-mz*dy)) ax, 1e6*1e-7*sum(w*(mz*dx-mx*dz)) ay, 1e6*1e-7*sum(w*(mx*dy-my*dx)) az FROM pw GROUP BY node)"""


def _moved_dipoles(t):
    return t.dipoles.select("j", (0.025 * F.floor(F.col("j") / 20) + F.col("sx")).alias("sx"), (0.05 + F.col("sy")).alias("sy"), F.lit(0.11).alias("sz"), "mx", "my", "mz")


@query(sql(f"SELECT node, {R('ax', 'ax', 2)}, {R('ay', 'ay', 2)}, {R('az', 'az', 2)} FROM da", PLACE, DF))
def dipole_dadt(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(source.dipole_field(t.nodes, _moved_dipoles(t), 1e6), ["node"], 2)


@query(sql(f"SELECT e, {R('sum(ax)/4e0', 'ax', 2)}, {R('sum(ay)/4e0', 'ay', 2)}, {R('sum(az)/4e0', 'az', 2)} FROM co JOIN da ON co.node = da.node GROUP BY e", PLACE, DF))
def dadt_elements(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(sparse.element_means(source.dipole_field(t.nodes, _moved_dipoles(t), 1e6), t.corners, ["ax", "ay", "az"]), ["e"], 2)


CP = """tp AS (SELECT p, t, pl.cx px, pl.cy py, pl.cz pz, a.x ax, a.y ay, a.z az, b.x-a.x ux, b.y-a.y uy, b.z-a.z uz, c.x-a.x vx, c.y-a.y vy, c.z-a.z vz FROM pl, tris JOIN nodes a ON a.node=tris.a JOIN nodes b ON b.node=tris.b JOIN nodes c ON c.node=tris.c),
 dd AS (SELECT *, ux*(px-ax)+uy*(py-ay)+uz*(pz-az) d1, vx*(px-ax)+vy*(py-ay)+vz*(pz-az) d2, ux*(px-ax-ux)+uy*(py-ay-uy)+uz*(pz-az-uz) d3, vx*(px-ax-ux)+vy*(py-ay-uy)+vz*(pz-az-uz) d4, ux*(px-ax-vx)+uy*(py-ay-vy)+uz*(pz-az-vz) d5, vx*(px-ax-vx)+vy*(py-ay-vy)+vz*(pz-az-vz) d6 FROM tp),
 va AS (SELECT *, d1*d4-d3*d2 vc, d5*d2-d1*d6 vb, d3*d6-d5*d4 va FROM dd),
 bw AS (SELECT *, CASE WHEN d1<=0 AND d2<=0 THEN 0e0 WHEN d3>=0 AND d4<=d3 THEN 1e0 WHEN vc<=0 AND d1>=0 AND d3<=0 THEN d1/nullif(d1-d3,0) WHEN d6>=0 AND d5<=d6 THEN 0e0 WHEN vb<=0 AND d2>=0 AND d6<=0 THEN 0e0 WHEN va<=0 AND d4-d3>=0 AND d5-d6>=0 THEN 1e0-(d4-d3)/nullif((d4-d3)+(d5-d6),0) ELSE vb/nullif(va+vb+vc,0) END wb,
   CASE WHEN d1<=0 AND d2<=0 THEN 0e0 WHEN d3>=0 AND d4<=d3 THEN 0e0 WHEN vc<=0 AND d1>=0 AND d3<=0 THEN 0e0 WHEN d6>=0 AND d5<=d6 THEN 1e0 WHEN vb<=0 AND d2>=0 AND d6<=0 THEN d2/nullif(d2-d6,0) WHEN va<=0 AND d4-d3>=0 AND d5-d6>=0 THEN (d4-d3)/nullif((d4-d3)+(d5-d6),0) ELSE vc/nullif(va+vb+vc,0) END wc FROM va),
 qp AS (SELECT p, t, px, py, pz, ax+(ux*wb+vx*wc) qx, ay+(uy*wb+vy*wc) qy, az+(uz*wb+vz*wc) qz FROM bw),
 nq AS (SELECT p, t, qx, qy, qz, d2 FROM (SELECT *, (px-qx)*(px-qx)+(py-qy)*(py-qy)+(pz-qz)*(pz-qz) d2, row_number() OVER (PARTITION BY p ORDER BY (px-qx)*(px-qx)+(py-qy)*(py-qy)+(pz-qz)*(pz-qz), t) k FROM qp) WHERE k = 1)"""


@query(sql(f"SELECT p, t, {R('d2', 'd2', 5)}, {R('qx', 'qx', 5)}, {R('qy', 'qy', 5)}, {R('qz', 'qz', 5)} FROM nq", PLACE, CP))
def closest_surface_point(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(source.closest_points(t.placements, t.nodes, t.tris), ["p", "t"], 5)


FRAME = """fr AS (SELECT nq.p, nx, ny, nz, hx-qx yx, hy-qy yy, hz-qz yz, qx+nx*dist ox, qy+ny*dist oy, qz+nz*dist oz FROM nq JOIN normals ON nq.t = normals.t JOIN placements ON nq.p = placements.p),
 fl AS (SELECT *, yx-nx*(yx*nx+yy*ny+yz*nz) fx, yy-ny*(yx*nx+yy*ny+yz*nz) fy, yz-nz*(yx*nx+yy*ny+yz*nz) fz FROM fr),
 fu AS (SELECT p, ox, oy, oz, -nx zx, -ny zy, -nz zz, fx/sqrt(fx*fx+fy*fy+fz*fz) ux, fy/sqrt(fx*fx+fy*fy+fz*fz) uy, fz/sqrt(fx*fx+fy*fy+fz*fz) uz FROM fl),
 frames AS (SELECT p, uy*zz-uz*zy r00, uz*zx-ux*zz r10, ux*zy-uy*zx r20, ux r01, uy r11, uz r21, zx r02, zy r12, zz r22, ox, oy, oz FROM fu)"""
F_COLS = [f"r{i}{k}" for k in range(3) for i in range(3)] + ["ox", "oy", "oz"]


def _frames(t):
    return source.coil_frames(t.placements, t.nodes, t.tris, mesh.skin_normals(t.nodes, t.tris))


@query(sql("SELECT p, " + ", ".join(R(c, c, 5) for c in F_COLS) + " FROM frames", PLACE, CP, _N1, FRAME))
def coil_frames(spark, sf_dir):
    return out(_frames(Tables(spark, sf_dir)).select("p", *F_COLS), ["p"], 5)


PD = "pd AS (SELECT p, j, " + ", ".join([f"r{i}0*sx+r{i}1*sy+r{i}2*sz+o{a}*1e-3 s{a}" for i, a in enumerate("xyz")] + [f"r{i}0*mx+r{i}1*my+r{i}2*mz m{a}" for i, a in enumerate("xyz")]) + " FROM frames, dip)"


@query(sql("SELECT p, j, " + ", ".join(R(c, c, 7) for c in ("sx", "sy", "sz", "mx", "my", "mz")) + " FROM pd", PLACE, CP, _N1, FRAME, PD))
def place_dipoles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    placed = source.place_alike(_frames(t).select("p", *F_COLS), t.dipoles)
    # Rounded before the lists are spread: a row for each pair is only copied.
    placed = placed.select("p", "js", *[clean_scaled(F.col(c), 7).alias(c) for c in ("sx", "sy", "sz", "mx", "my", "mz")])
    return placed.select("p", F.explode("js").alias("q"), "sx", "sy", "sz", "mx", "my", "mz").select("p", "q.j", "sx", "sy", "sz", "mx", "my", "mz")


# ---- regions of interest ----------------------------------------------------------------------------------------

TG = "tg AS (SELECT c_custkey::VARCHAR name, 25e0*(c_custkey//15)+25e0*((c_custkey*29)%100)/100e0 tx, 10e0+80e0*((c_custkey*41)%100)/100e0 ty, 10e0+80e0*((c_custkey*67)%100)/100e0 tz, {r} radius FROM customer)"
ND = "nr AS (SELECT name, bary.e, vol, radius, (bx-tx)*(bx-tx)+(by_-ty)*(by_-ty)+(bz-tz)*(bz-tz) d2 FROM bary JOIN gr ON bary.e = gr.e, tg)"


def _targets(spark, sf_dir, radius):
    k = F.col("c_custkey")
    at = lambda m: 10 + 80 * ((k * m) % 100) / 100.0
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("name"), synth.along_bar(k, 29).alias("tx"), at(41).alias("ty"), at(67).alias("tz"), radius.alias("radius"), F.lit(0.0).alias("dx"), F.lit(0.6).alias("dy"), F.lit(-0.8).alias("dz"))


def _elements(t):
    return t.bary.join(t.grads.select("e", "vol"), "e")


@query(sql("SELECT name, e, 1e0 AS w FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d2, e) k FROM nr) WHERE k = 1", TG.format(r="0e0"), ND))
def roi_nearest(spark, sf_dir):
    return metrics.resolve_targets(_elements(Tables(spark, sf_dir)), _targets(spark, sf_dir, F.lit(0.0)))


NF = "nf AS (SELECT * FROM (SELECT *, min(d2) OVER (PARTITION BY name) m, count(*) FILTER (WHERE d2 <= radius*radius) OVER (PARTITION BY name) k FROM nr) WHERE CASE WHEN k > 0 THEN d2 <= radius*radius ELSE d2 = m END)"
BALL = "SELECT name, e, round(vol/sum(vol) OVER (PARTITION BY name),{d})+0e0 AS w FROM nf"


@query(sql(BALL.format(d=8), TG.format(r="22e0"), ND, NF))
def roi_ball(spark, sf_dir):
    return out(metrics.resolve_targets(_elements(Tables(spark, sf_dir)), _targets(spark, sf_dir, F.lit(22.0))), ["name", "e"], 8)


@query(sql(BALL.format(d=9), TG.format(r="1e-6"), ND, NF))
def roi_ball_fallback_ties(spark, sf_dir):
    return out(metrics.resolve_targets(_elements(Tables(spark, sf_dir)), _targets(spark, sf_dir, F.lit(1e-6))), ["name", "e"], 9)


@query("WITH " + TG.format(r="0e0") + ", d(depth) AS (VALUES (5e0),(10e0),(20e0)) SELECT name, depth, round(tx+depth*0e0,9)+0e0 AS tx, round(ty+depth*0.6e0,9)+0e0 AS ty, round(tz-depth*0.8e0,9)+0e0 AS tz FROM tg, d")
def depth_probes(spark, sf_dir):
    return out(metrics.depth_probes(_targets(spark, sf_dir, F.lit(0.0)), [5, 10, 20]), ["name", "depth"], 9)


@query(sql("SELECT (fld.e % 5)::INT AS k, name, round(sum(vol*sqrt(ex*ex+ey*ey+ez*ez))/max(tv),4)+0e0 AS mean FROM (SELECT *, sum(vol) OVER (PARTITION BY name) tv FROM nf) q JOIN fld ON q.e = fld.e GROUP BY 1, 2", TG.format(r="30e0"), ND, NF, RE))
def roi_draw_means(spark, sf_dir):
    t = Tables(spark, sf_dir)
    roi = metrics.resolve_targets(_elements(t), _targets(spark, sf_dir, F.lit(30.0)))
    field = sparse.reconstruct(t.corners, t.potential, t.dadt).select((F.col("e") % 5).cast("int").alias("k"), "e", "magn")
    return out(metrics.roi_means(field, roi, ["k"]), ["k", "name"], 4)


# ---- recovery ---------------------------------------------------------------------------------------------------

RING = "sc AS (SELECT slot, e, vol FROM co JOIN slots ON co.node = slots.node AND co.tag = slots.tag), ring AS (SELECT DISTINCT slot, co.node FROM sc JOIN co ON sc.e = co.e)"
PATCH = """few AS (SELECT slot FROM ring GROUP BY slot HAVING count(*) < 16),
 patch AS (SELECT slot, node FROM ring UNION SELECT few.slot, r2.node FROM few JOIN ring ON few.slot = ring.slot JOIN slots own ON own.slot = few.slot JOIN slots o ON o.node = ring.node AND o.tag = own.tag JOIN ring r2 ON r2.slot = o.slot)"""
VW = "vw AS (SELECT slot, e, vol/sum(vol) OVER (PARTITION BY slot) w FROM sc)"
SF = "sfld AS (SELECT slot, sum(w*ex) ex, sum(w*ey) ey, sum(w*ez) ez FROM vw JOIN fld ON vw.e = fld.e GROUP BY slot)"


@query(sql("SELECT slot, node FROM ring", RING))
def first_ring(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return recovery.first_ring(t.corners, t.slots)


@query(sql("SELECT slot, node FROM patch", RING, PATCH))
def node_patches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return recovery.node_patches(t.corners, t.slots)


@query(sql(f"SELECT slot, e, {R('w', 'w', 7)} FROM vw", RING, VW))
def spr_volume_average(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return out(recovery.volume_means(t.corners, t.slots), ["slot", "e"], 7)


#: Tables that a recovery reads several times.
_RECOVERY = ("grads", "bary", "slots")


def _slot_field(t):
    return recovery.recover_nodes(recovery.volume_means(t.corners, t.slots), sparse.reconstruct(t.corners, t.potential, t.dadt))


@query(sql(f"SELECT slot, {R('ex', 'ex', 4)}, {R('ey', 'ey', 4)}, {R('ez', 'ez', 4)} FROM sfld", RE, RING, VW, SF))
def recover_nodes(spark, sf_dir):
    return out(_slot_field(Tables(spark, sf_dir, *_RECOVERY)), ["slot"], 4)


@query(sql("SELECT e, " + ", ".join(R(f"e{a}", f"e{a}", 4) for a in "xyz") + ", round(sqrt(ex*ex+ey*ey+ez*ez),4)+0e0 AS magn FROM (SELECT sc.e, sum(ex)/4e0 ex, sum(ey)/4e0 ey, sum(ez)/4e0 ez FROM sc JOIN sfld ON sc.slot = sfld.slot GROUP BY sc.e)", RE, RING, VW, SF))
def recover_elements(spark, sf_dir):
    t = Tables(spark, sf_dir, *_RECOVERY)
    return out(recovery.recover_elements(t.corners, t.slots, _slot_field(t)), ["e"], 4)


@query(sql("SELECT nodes.node AS node, " + ", ".join(f"coalesce(round(e{a},4)+0e0, -1e300) AS e{a}" for a in "xyz") + " FROM nodes LEFT JOIN (SELECT node, ex, ey, ez FROM slots JOIN sfld ON slots.slot = sfld.slot WHERE tag = 3) q ON nodes.node = q.node", RE, RING, VW, SF))
def nodal_field(spark, sf_dir):
    """NaN, which engines compare differently, is shown as -1e300."""
    t = Tables(spark, sf_dir, *_RECOVERY)
    n = recovery.nodal_field(t.nodes, t.slots, _slot_field(t), 3)
    return n.select("node", *[F.when(F.isnan(f"e{a}"), F.lit(-1e300)).otherwise(clean(F.col(f"e{a}"), 4)).alias(f"e{a}") for a in "xyz"])


# ---- ensembles and search ---------------------------------------------------------------------------------------


@query(sql(f"SELECT d.k, a.node r, b.node c, {R('sum(d.sigma*a.vol*(a.gx*b.gx+a.gy*b.gy+a.gz*b.gz))', 'v', 8)} FROM co a JOIN co b ON a.e = b.e JOIN dr d ON d.tag = a.tag GROUP BY 1, 2, 3", "dr AS (SELECT n_nationkey::INT k, tag::INT tag, 0.1e0 + (n_nationkey*7 + tag*3 + n_regionkey) % 11*0.05e0 sigma FROM nation, (VALUES (2), (3)) v(tag))"))
def combine_matrix(spark, sf_dir):
    t, tags = Tables(spark, sf_dir), [2, 3]
    tag = F.explode(F.array(*[F.lit(i) for i in tags])).alias("tag")
    sigmas = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey", tag)
    sigmas = sigmas.select(F.col("n_nationkey").cast("int").alias("k"), "tag", (0.1 + (F.col("n_nationkey") * 7 + F.col("tag") * 3 + F.col("n_regionkey")) % 11 * 0.05).alias("sigma"))
    parts = written(sparse.unit_parts(t.grads, tags), "parts")
    return out(ensemble.combine_parts(parts, sigmas, tags), ["k", "r", "c"], 8)


SAMP = "sm AS (SELECT p_partkey::INT j, (p_partkey//25)::INT p, 1.1e0*p_partkey x, 5e0+90e0*((p_partkey*59)%101)/101e0 y, 95e0+60e0*((p_partkey*83)%101)/101e0 z, (p_partkey%3)*0.1e0 mx, 0.2e0 my, p_size*0.01e0 mz FROM part)"
GP = """sh AS (SELECT min(x)-10e0 ox, min(y)-10e0 oy, min(z)-10e0 oz, (ceil((max(x)+10e0-(min(x)-10e0))/20e0)+1)::BIGINT nx, (ceil((max(y)+10e0-(min(y)-10e0))/20e0)+1)::BIGINT ny, (ceil((max(z)+10e0-(min(z)-10e0))/20e0)+1)::BIGINT nz FROM sm),
 gp AS (SELECT ix::INT ix, iy::INT iy, iz::INT iz FROM (SELECT unnest(range(nx)) ix FROM sh), (SELECT unnest(range(ny)) iy FROM sh), (SELECT unnest(range(nz)) iz FROM sh)), gx AS (SELECT gp.*, ox+ix*20e0 x, oy+iy*20e0 y, oz+iz*20e0 z FROM gp, sh)"""
QF = "qf AS (SELECT d, ix, iy, iz, (d+1)*0.01e0*y qx, 0.02e0*x-d*0.01e0*z qy, 0.001e0*x*y+d qz FROM gx, (VALUES (0),(1),(2)) dd(d))"
TRI = """ui AS (SELECT sm.*, nx, ny, nz, (x-ox)/20e0 ux, (y-oy)/20e0 uy, (z-oz)/20e0 uz FROM sm, sh), ci AS (SELECT *, greatest(least(floor(ux),nx-2),0)::INT cx, greatest(least(floor(uy),ny-2),0)::INT cy, greatest(least(floor(uz),nz-2),0)::INT cz FROM ui),
 e8 AS (SELECT *, cx+dx ix, cy+dy iy, cz+dz iz, (CASE WHEN dx=1 THEN ux-cx ELSE 1e0-(ux-cx) END)*(CASE WHEN dy=1 THEN uy-cy ELSE 1e0-(uy-cy) END)*(CASE WHEN dz=1 THEN uz-cz ELSE 1e0-(uz-cz) END) w FROM ci, (VALUES (0),(1)) a(dx), (VALUES (0),(1)) b(dy), (VALUES (0),(1)) c(dz)),
 ti AS (SELECT p, j, mx, my, mz, d, sum(w*qx) qx, sum(w*qy) qy, sum(w*qz) qz FROM e8 JOIN qf ON e8.ix=qf.ix AND e8.iy=qf.iy AND e8.iz=qf.iz GROUP BY p, j, mx, my, mz, d)"""


def _grid(samples):
    return search.grid_shape(samples, 20.0, 10.0)


def _qfield(spark, grid):
    d = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("d")
    g = search.grid_points(spark, grid).select("*", d)
    return g.select("d", "ix", "iy", "iz", ((F.col("d") + 1) * 0.01 * F.col("y")).alias("qx"), (0.02 * F.col("x") - F.col("d") * 0.01 * F.col("z")).alias("qy"), (0.001 * F.col("x") * F.col("y") + F.col("d")).alias("qz"))


def _samples(spark, sf_dir):
    k = F.col("p_partkey")
    at = lambda m: ((k * m) % 101) / 101.0
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.cast("int").alias("j"), F.floor(k / 25).cast("int").alias("p"), (1.1 * k).alias("x"), (5 + 90 * at(59)).alias("y"), (95 + 60 * at(83)).alias("z"), (k % 3 * 0.1).alias("mx"), F.lit(0.2).alias("my"), (F.col("p_size") * 0.01).alias("mz"))


@query("WITH " + ", ".join([SAMP, GP]) + " SELECT ix, iy, iz, x, y, z FROM gx")
def grid_points(spark, sf_dir):
    return search.grid_points(spark, _grid(_samples(spark, sf_dir)))


@query("WITH " + ", ".join([SAMP, GP]) + " SELECT j, round((x-ox)/20e0,9)+0e0 AS ux, round((y-oy)/20e0,9)+0e0 AS uy, round((z-oz)/20e0,9)+0e0 AS uz FROM sm, sh")
def world_to_index(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    return out(search.world_to_index(samples, _grid(samples)).select("j", "ux", "uy", "uz"), ["j"], 9)


@query("WITH " + ", ".join([SAMP, GP, QF, TRI]) + f" SELECT j, d, {R('qx', 'qx', 4)}, {R('qy', 'qy', 4)}, {R('qz', 'qz', 4)} FROM ti")
def trilinear(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    grid = _grid(samples)
    return out(search.trilinear(samples, grid, _qfield(spark, grid), ["j"], ["qx", "qy", "qz"], ("d",)), ["j", "d"], 4)


@query("WITH " + ", ".join([SAMP, GP, QF, TRI]) + f" SELECT j, d, {R('qx', 'qx', 4)}, {R('qy', 'qy', 4)}, {R('qz', 'qz', 4)} FROM ti")
def trilinear_tiles(spark, sf_dir):
    """The same values from tiles of the grid."""
    samples = _samples(spark, sf_dir)
    grid, field = _grid(samples), ["qx", "qy", "qz"]
    return out(search.trilinear_tiled(samples, grid, search.tiled(_qfield(spark, grid), grid, field, ("d",)), ["j"], field, ("d",)), ["j", "d"], 4)


EV = "ev AS (SELECT p, d, 1e6*sum(mx*qx+my*qy+mz*qz) e FROM ti GROUP BY p, d)"


def _reciprocity(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    grid = _grid(samples)
    return search.reciprocity(samples, grid, _qfield(spark, grid), 1e6)


@query("WITH " + ", ".join([SAMP, GP, QF, TRI, EV]) + f" SELECT p, d, {R('e', 'e', 0)} FROM ev")
def reciprocity_evaluate(spark, sf_dir):
    return out(_reciprocity(spark, sf_dir), ["p", "d"], 0)


@query("WITH " + ", ".join([SAMP, GP, QF, TRI, EV]) + " SELECT p, round(sqrt(sum(e*e)),0)+0e0 AS objective FROM ev GROUP BY p ORDER BY sqrt(sum(e*e)) DESC, p LIMIT 1")
def best_placement(spark, sf_dir):
    return out(search.best_placement(search.magnitude_or_component(_reciprocity(spark, sf_dir), ("p",), True)), ["p"], 0)


ANG = "sa AS (SELECT c_custkey::INT // 9 center, c_custkey::INT % 9 s, c_acctbal*1e-3 e FROM customer)"
DIR = "an AS (SELECT i::INT a, i*(2e0*pi()/64e0) theta FROM range(64) t(i)), di AS (SELECT center, a, theta, sum(e*(1e0" + "".join(f"+2e0*cos({h}e0*(theta - s*(2e0*pi()/9e0)))" for h in range(1, 5)) + ")/9e0) e FROM sa, an GROUP BY 1, 2, 3)"


def _angles(spark, sf_dir):
    c = F.col("c_custkey")
    s = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(c / 9).cast("int").alias("center"), (c % 9).cast("int").alias("s"), (F.col("c_acctbal") * 1e-3).alias("e"))
    return search.dirichlet(s, ["center"], 9, 64)


@query("WITH " + ANG + ", " + DIR + f" SELECT center, a, {R('theta', 'theta', 9)}, {R('e', 'e', 9)} FROM di")
def dirichlet_angles(spark, sf_dir):
    return out(_angles(spark, sf_dir), ["center", "a"], 9)


@query(
    "WITH " + ANG + ", " + DIR + """, b AS (SELECT center, a, e FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY e DESC, a) k FROM di) WHERE k = 1),
 j AS (SELECT b.center, b.a, b.e f0, l.e fl, h.e fh FROM b JOIN di l ON l.center = b.center AND l.a = (b.a+63)%64 JOIN di h ON h.center = b.center AND h.a = (b.a+1)%64)
 SELECT center, a AS a0, round(f0,9)+0e0 AS f0, round((a + CASE WHEN fl-2e0*f0+fh < 0 THEN greatest(least(0.5e0*(fl-fh)/(fl-2e0*f0+fh),0.5e0),-0.5e0) ELSE 0e0 END)*(2e0*pi()/64e0),9)+0e0 AS theta FROM j"""
)
def parabolic_refine(spark, sf_dir):
    return out(search.best_angle(_angles(spark, sf_dir), ["center"], 64), ["center", "a0"], 9)
