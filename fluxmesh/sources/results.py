"""Results as Parquet folders with a format version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1
PARTS = ("metrics", "magnitude", "vectors", "potential", "nodal", "moments", "draw_metrics", "roi")


def save_result(path: str, tables: dict[str, DataFrame], partition_by: str | None = "p") -> None:
    """Write the given parts; the version goes last, so a folder with a version is whole."""
    unknown = set(tables) - set(PARTS)
    if unknown or not tables:
        raise ValueError(f"unknown or no parts: {sorted(unknown)}")
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by in df.columns else writer).parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(FORMAT_VERSION, sorted(tables))], "format_version int, parts array<string>").write.mode("overwrite").parquet(f"{path}/_format")


def load_result(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """Every known part, None where it was not saved; another version raises."""
    head = spark.read.parquet(f"{path}/_format").first()
    if head.format_version != FORMAT_VERSION:
        raise ValueError(f"format version {head.format_version} is not {FORMAT_VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") if name in head.parts else None for name in PARTS}


def retain(field: DataFrame, magnitude: bool = True, vectors: bool = False) -> dict[str, DataFrame]:
    """The parts of a field to keep: columns that are not kept are never computed."""
    keys = [c for c in ("p", "k", "e") if c in field.columns]
    out = {}
    if magnitude:
        out["magnitude"] = field.select(*keys, F.col("magn").cast("float").alias("magn"))
    if vectors:
        out["vectors"] = field.select(*keys, *[F.col(c).cast("float").alias(c) for c in ("ex", "ey", "ez")])
    return out
