"""Shared storage, materialisation and connected components for the training-data operators.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` so that a lost executor costs only the
tasks it ran: nothing depends on blocks that live on one machine.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. It is chosen here only for a local master without a setting (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    root = "file://" + tempfile.mkdtemp(prefix="fluxmesh-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/fluxmesh-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and the plan runs once."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a materialised frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/fluxmesh-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove the shuffle files of finished jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_fs(uri: str):
    """(pyarrow file system, path) of a location in the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_memo: dict = {"owner": None, "drop": None, "given": 0.0}


def own_memory(owner: str, drop=None) -> None:
    """Called by a task before it fills a memo that outlives it: what another operator left in this worker is dropped,
    so a worker that serves many stages holds one memo at a time."""
    if _memo["owner"] != owner:
        if _memo["drop"]:
            _memo["drop"]()
        gc.collect()
        _memo.update(owner=owner, drop=drop)


def give_back() -> None:
    """Return freed memory to the system, once a second at most: a worker outlives its tasks, and what the allocators keep
    adds up over the stages of a pipeline."""
    import pyarrow as pa

    if time.monotonic() - _memo["given"] < 1:
        return
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim:
            trim(0)
    _memo["given"] = time.monotonic()


def lean(f):
    """``f`` of one group, after which the memory it took is given back."""

    @functools.wraps(f)
    def run(t):
        try:
            return f(t)
        finally:
            give_back()

    return run


def slices(batch, rows: int = 256):
    """An Arrow batch a few rows at a time; afterwards the memory it took is given back."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    give_back()


def components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns ``(node, comp)`` with the smallest node id of each component, for nodes that have an edge. Each step is
    a grouped minimum and a join, so a component of any size is spread over tasks; the number of rounds grows with
    the logarithm of the component's diameter.
    """
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    state = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(small_low, "u")
        small = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where("u <> v").distinct(), label)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(cur)
        cur = nxt
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
