"""Binary Gmsh 2.2 meshes as a splittable source: a task for each stretch of a section's rows.

The driver steps over the file's headers and names byte ranges inside the sections; tasks read theirs and nothing else. Each
table is its own scan, so nodes are not read for elements. Files are opened by their URI's file system; a store that only
Spark opens is read by ``msh.read_msh``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fluxmesh.operators import mesh
from fluxmesh.sources import msh

#: Rows of a task's range.
SPLIT_ROWS = 2_000_000
BATCH_ROWS = 1 << 16
ELEMENT = {"tets": 4, "tris": 2}
#: Column names and their place in a row of the file.
COLUMNS = {"nodes": ("id", "x", "y", "z"), "tets": ("e", "n0", "n1", "n2", "n3", "tag"), "tris": ("t", "a", "b", "c", "tag")}


def open_file(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


@dataclass
class Rows(InputPartition):
    """``count`` rows at ``offset``, the first of which is the table's row ``first``."""

    offset: int
    count: int
    first: int


class MshReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], split_rows: int):
        self.path, self.table, self.columns, self.split_rows = path, table, columns, split_rows

    def partitions(self) -> list[Rows]:
        with open_file(self.path) as f:
            found = msh.sections(lambda at, n: f.read_at(n, at), f.size())
        stretches, width = ([(found.nodes_at, found.nodes)], msh.NODE.itemsize) if self.table == "nodes" else (found.of(ELEMENT[self.table]), msh.width(ELEMENT[self.table]))
        out, first = [], 0
        for at, count in stretches:
            for row in range(0, count, self.split_rows):
                n = min(self.split_rows, count - row)
                out.append(Rows(at + row * width, n, first + row))
            first += count
        return out or [Rows(0, 0, 0)]  # a section without rows

    def read(self, p: Rows):
        with open_file(self.path) as f:
            for row in range(0, max(p.count, 1), BATCH_ROWS):
                n, first = min(BATCH_ROWS, p.count - row), p.first + row
                if self.table == "nodes":
                    data = f.read_at(n * msh.NODE.itemsize, p.offset + row * msh.NODE.itemsize)
                    rows = np.frombuffer(data, msh.NODE)
                    made = {"id": rows["id"], **{a: rows["xyz"][:, i] for i, a in enumerate("xyz")}}
                else:
                    kind = ELEMENT[self.table]
                    rows = msh.elements(f.read_at(n * msh.width(kind), p.offset + row * msh.width(kind)), kind)
                    names = COLUMNS[self.table]
                    made = {names[0]: np.arange(first, first + n, dtype=np.int32), "tag": rows[:, 1], **{c: rows[:, 3 + i] for i, c in enumerate(names[1:-1])}}
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[c])) for c in self.columns], names=self.columns)


class MshSource(DataSource):
    """``format("msh")`` with the options ``path``, ``table`` (nodes, tets or tris), ``columns`` and ``splitRows``."""

    @classmethod
    def name(cls) -> str:
        return "msh"

    def _columns(self) -> list[str]:
        table = self.options.get("table", "tets")
        if table not in COLUMNS:
            raise ValueError(f"a mesh has no table {table!r}")
        asked = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS[table])).split(",")]
        if unknown := [c for c in asked if c not in COLUMNS[table]]:
            raise ValueError(f"{table} have no column {', '.join(unknown)}")
        return asked

    def schema(self) -> str:
        return ", ".join(f"{c} {'double' if c in 'xyz' else 'int'}" for c in self._columns())

    def reader(self, schema) -> MshReader:
        return MshReader(self.options["path"], self.options.get("table", "tets"), self._columns(), int(self.options.get("splitrows", SPLIT_ROWS)))


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """One section of a mesh file with the file's own node ids."""
    spark.dataSource.register(MshSource)
    return spark.read.format("msh").option("table", table).option("columns", ",".join(columns or COLUMNS[table])).option("splitRows", split_rows).load(path)


def read_msh_split(spark: SparkSession, path: str, split_rows: int = SPLIT_ROWS) -> dict[str, DataFrame]:
    """``nodes``, ``tets`` and ``tris`` with 0-based node ids in the order of the file's ids, as ``read_msh`` gives them.

    Ids without gaps are shifted; others are numbered and looked up, and an element's id without a node raises.
    """
    nodes, tets, tris = (read_table(spark, path, t, split_rows=split_rows) for t in ("nodes", "tets", "tris"))
    box = nodes.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if box.d != box.n:
        raise msh.MeshFormatError("a node's number stands twice")
    ends = [tets.select(F.explode(F.array("n0", "n1", "n2", "n3")).alias("node")), tris.select(F.explode(F.array("a", "b", "c")).alias("node"))]
    used = ends[0].unionByName(ends[1])
    if box.n and box.hi - box.lo + 1 == box.n:
        out = used.agg(F.min("node").alias("lo"), F.max("node").alias("hi")).first()
        if out.lo < box.lo or out.hi > box.hi:
            raise msh.MeshFormatError("an element refers to a node that is not there")
        shift = lambda rows, cols: rows.select(*[(F.col(c) - box.lo).alias(c) if c in cols else c for c in rows.columns])
        return {"nodes": shift(nodes, ("id",)).withColumnRenamed("id", "node"), "tets": shift(tets, mesh.LOCAL), "tris": shift(tris, ("a", "b", "c"))}
    if used.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").limit(1).count():
        raise msh.MeshFormatError("an element refers to a node that is not there")
    ids = mesh.numbered(nodes.select(F.col("id").alias("node")), mesh.id_block("node"), ["node"], "new_node")
    placed = nodes.join(ids, nodes["id"] == ids["node"]).select(F.col("new_node").alias("node"), "x", "y", "z")
    return {"nodes": placed, "tets": mesh.renamed(tets, ids, mesh.LOCAL), "tris": mesh.renamed(tris, ids, ["a", "b", "c"])}
