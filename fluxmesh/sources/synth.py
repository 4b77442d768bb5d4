"""Generated meshes and request tables: reproducible from row numbers, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 100.0
#: Rows of a table that one task expands into a layer of the bar each.
TASK_LAYERS = 512


def cube_nodes(spark: SparkSession, n: int) -> DataFrame:
    """``node, x, y, z`` of a cube of ``n`` cells a side; inner nodes off the middle plane are moved by up to a quarter cell."""
    h, m = SIZE / n, n + 1
    i = F.col("id")
    ix, iy, iz = i % m, F.floor(i / m) % m, F.floor(i / (m * m))
    inner = F.lit(True)
    for a in (ix, iy, iz):
        inner = inner & a.between(1, n - 1)
    inner = inner & (iz != n // 2)

    def moved(a: Column, axis: int) -> Column:
        jitter = ((i * 7919 + axis * 104729) % 1009 / 1009.0 - 0.5) * 0.5 * h
        return a * h + F.when(inner, jitter).otherwise(0.0)

    return spark.range(m**3).select(i.cast("int").alias("node"), moved(ix, 1).alias("x"), moved(iy, 2).alias("y"), moved(iz, 3).alias("z"))


def cube_tets(spark: SparkSession, n: int, tags: tuple[int, int] = (2, 3)) -> DataFrame:
    """``e, n0..n3, tag``: six tetrahedra a cell around its diagonal; the first tag below the middle plane."""
    m = n + 1
    steps = (1, m, m * m)
    paths = [(a, b) for a in steps for b in steps if a != b]
    i = F.col("id")
    ix, iy, iz = i % n, F.floor(i / n) % n, F.floor(i / (n * n))
    base = (ix + m * iy + m * m * iz).cast("int")
    path = F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in paths])).alias("k", "s")
    rows = spark.range(n**3).select((i * 6).alias("first"), base.alias("base"), F.when(iz < n // 2, tags[0]).otherwise(tags[1]).alias("tag"), path)
    return rows.select((F.col("first") + F.col("k")).cast("int").alias("e"), F.col("base").alias("n0"), (F.col("base") + F.col("s.a")).alias("n1"), (F.col("base") + F.col("s.a") + F.col("s.b")).alias("n2"), (F.col("base") + sum(steps)).alias("n3"), "tag")


def dealt(rows: DataFrame, key: str, per_task: int = TASK_LAYERS) -> DataFrame:
    """``rows`` dealt by ``key`` to tasks of about ``per_task``: a small file is read by one task, which would hold all that
    its rows are expanded into."""
    tasks = -(-rows.count() // per_task)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def each(rows: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` once for each of ``n`` numbers. A join, since Spark takes an exploded table to be as small as its rows and
    would broadcast it whole."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(n).select(F.col("id").cast("int").alias(name))))


def bar_nodes(suppliers: DataFrame) -> DataFrame:
    """``node, x, y, z`` of a bar that grows with a table: a layer of 5 by 5 nodes for each supplier (keys from 0).

    Nodes inside a layer and off the middle plane are moved by up to a quarter cell, as the supplier's nation has it.
    """
    h = SIZE / 4
    rows = each(dealt(suppliers.select(F.col("s_suppkey").cast("long").alias("ix"), F.col("s_nationkey").cast("long").alias("nk")), "ix"), 25, "q")
    rows = rows.select("ix", "nk", (25 * F.col("ix") + F.col("q")).alias("i"), F.floor(F.col("q") / 5).alias("iy"), (F.col("q") % 5).alias("iz"))
    inner = F.col("iy").between(1, 3) & F.col("iz").isin(1, 3)

    def moved(a: str, axis: int) -> Column:
        jitter = ((F.col("i") * 7919 + axis * 104729 + F.col("nk") * 31) % 1009 / 1009.0 - 0.5) * 0.5 * h
        return F.col(a) * h + F.when(inner, jitter).otherwise(0.0)

    return rows.select(F.col("i").cast("int").alias("node"), moved("ix", 1).alias("x"), moved("iy", 2).alias("y"), moved("iz", 3).alias("z"))


def bar_tets(suppliers: DataFrame, tags: tuple[int, int] = (2, 3)) -> DataFrame:
    """``e, n0..n3, tag``: sixteen cells of six tetrahedra between a supplier's layer and the next one's."""
    keys = suppliers.select(F.col("s_suppkey").cast("long").alias("ix"))
    steps = (1, 5, 25)
    paths = [(a, b) for a in steps for b in steps if a != b]
    both = keys.join(keys.select((F.col("ix") - 1).alias("ix")), "ix", "left_semi")
    cells = each(dealt(both, "ix"), 16, "q").select("ix", "q", F.floor(F.col("q") / 4).alias("iy"), (F.col("q") % 4).alias("iz"))
    path = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in paths])[F.col("k")].alias("s")
    rows = each(cells, 6, "k").select((16 * F.col("ix") + F.col("q")).alias("i"), (25 * F.col("ix") + 5 * F.col("iy") + F.col("iz")).cast("int").alias("base"), F.when(F.col("iz") < 2, tags[0]).otherwise(tags[1]).alias("tag"), "k", path)
    return rows.select((6 * F.col("i") + F.col("k")).cast("int").alias("e"), F.col("base").alias("n0"), (F.col("base") + F.col("s.a")).alias("n1"), (F.col("base") + F.col("s.a") + F.col("s.b")).alias("n2"), (F.col("base") + sum(steps)).alias("n3"), "tag")


def along_bar(key: Column, m: int) -> Column:
    """A place along the bar for customers, of which there are fifteen for each supplier."""
    return 25.0 * F.floor(key / 15) + 25.0 * ((key * m) % 100) / 100.0


def bar_placements(customers: DataFrame) -> DataFrame:
    """Placements over the bar's upper side, one a customer."""
    k = F.col("c_custkey")
    cx, cy = along_bar(k, 37), 20 + 60 * ((k * 53) % 100) / 100.0
    return customers.select(k.cast("int").alias("p"), cx.alias("cx"), cy.alias("cy"), (F.lit(101.0) + F.col("c_acctbal").cast("double") * 1e-4).alias("cz"), cx.alias("hx"), (cy + 50.0).alias("hy"), F.lit(100.0).alias("hz"), F.lit(4.0).alias("dist"))


def bar_potential(suppliers: DataFrame) -> DataFrame:
    """``node, v``: a potential taken from suppliers' balances."""
    rows = each(dealt(suppliers.select(F.col("s_suppkey").alias("ix"), F.col("s_acctbal").cast("double").alias("b")), "ix"), 25, "q")
    return rows.select((25 * F.col("ix") + F.col("q")).cast("int").alias("node"), (F.col("b") * 1e-3 * F.sqrt(F.col("q") + 2.0)).alias("v"))


def placements_of(rows: DataFrame, key: str, balance: str) -> DataFrame:
    """Placements over the top face, one a row."""
    k = F.col(key)
    cx, cy = 20 + 60 * ((k * 37) % 100) / 100.0, 20 + 60 * ((k * 53) % 100) / 100.0
    return rows.select(k.cast("int").alias("p"), cx.alias("cx"), cy.alias("cy"), (F.lit(101.0) + F.col(balance).cast("double") * 1e-4).alias("cz"), cx.alias("hx"), (cy + 50.0).alias("hy"), F.lit(100.0).alias("hz"), F.lit(4.0).alias("dist"))


def dipoles_of(rows: DataFrame, key: str, size: str) -> DataFrame:
    """A flat coil's dipoles (m, A m2) in its own frame, one a row on a grid of 6 by 5 places."""
    k = F.col(key)
    return rows.select(
        k.cast("int").alias("j"), ((k % 6 - 2.5) * 0.008).alias("sx"), ((F.floor(k / 6) % 5 - 2.0) * 0.008).alias("sy"), F.lit(0.0).alias("sz"),
        (k % 3 * 0.001).alias("mx"), F.lit(0.0).alias("my"), (F.col(size) * 0.01).alias("mz"),
    )
