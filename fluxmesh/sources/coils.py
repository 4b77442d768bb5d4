"""Coils: the text format of dipole lists, and a catalog of coils as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_MICROSECOND = 1e6


def read_ccd(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(``coils(coil, didt_max, metadata)``, ``dipoles(coil, j, sx..mz)``) of one or many text files.

    A file has a ``#`` line of ``key=value`` pairs, a count, one line that is skipped, and rows of six numbers. A coil is
    named by ``coilname``, else by its file; a rate is given per microsecond. A wrong count raises when rows are read.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("body"), F.input_file_name().alias("file"))
    lines = F.filter(F.transform(F.split("body", "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    split = text.select("file", lines.alias("lines"))
    meta = F.filter(F.transform(F.split(F.regexp_replace(F.get("lines", F.lit(0)), "^#\\s*", ""), ";"), lambda s: F.split(s, "=", 2)), lambda kv: F.size(kv) == 2)
    pairs = F.map_from_entries(F.transform(meta, lambda kv: F.struct(F.trim(kv[0]), F.trim(kv[1]))))
    stem = F.regexp_extract("file", "([^/]+?)(\\.[^./]*)?$", 1)
    known = split.select("lines", pairs.alias("metadata"), stem.alias("stem"))
    known = known.withColumn("coil", F.coalesce(F.try_element_at("metadata", F.lit("coilname")), "stem"))
    coils = known.select("coil", (F.try_element_at("metadata", F.lit("dIdtmax")).cast("double") * PER_MICROSECOND).alias("didt_max"), "metadata")
    rows = known.select("coil", F.get("lines", F.lit(1)).cast("int").alias("n"), F.slice("lines", F.lit(4), F.greatest(F.size("lines") - 3, F.lit(0))).alias("rows"))
    rows = rows.withColumn("rows", F.when(F.size("rows") == F.col("n"), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("wrong number of dipoles in coil "), F.col("coil"))).cast("array<string>")))
    numbers = rows.select("coil", F.posexplode("rows").alias("j", "row")).select("coil", "j", F.split("row", "\\s+").alias("v"))
    return coils, numbers.select("coil", "j", *[F.col("v")[i].cast("double").alias(c) for i, c in enumerate(("sx", "sy", "sz", "mx", "my", "mz"))])


def save_coils(coils: DataFrame, dipoles: DataFrame, path: str) -> None:
    coils.write.mode("overwrite").parquet(f"{path}/coils")
    dipoles.write.mode("overwrite").partitionBy("coil").parquet(f"{path}/dipoles")


def load_coil(spark: SparkSession, path: str, coil: str) -> tuple[DataFrame, DataFrame]:
    """One coil of a saved catalog; only its partition is read."""
    found = spark.read.parquet(f"{path}/coils").where(F.col("coil") == coil)
    if not found.limit(1).count():
        raise ValueError(f"no coil {coil!r}")
    return found, spark.read.parquet(f"{path}/dipoles").where(F.col("coil") == coil)
