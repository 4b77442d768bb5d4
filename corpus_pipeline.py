"""A corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Each stage reads what its predecessor kept and returns the columns of ``documents``, the last one the packed pieces.
Between stages the rows are written as Parquet to the shared folder and read again, so a lost executor repeats tasks
of one stage only. Rows with nulls pass where a stage has nothing to decide on: a document without an id is never a
duplicate, one without a text fails the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxmesh.llm.common import materialize
from fluxmesh.llm.line_dedup import dedup_lines
from fluxmesh.llm.ngram_join import BROADCAST_ROWS, link_components
from fluxmesh.llm.packing import pack
from fluxmesh.llm.pii import detect, redact
from fluxmesh.llm.quality import judge

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the trained classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return judge(docs, COLUMNS).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that consist of nothing else."""
    cleaned = dedup_lines(docs, COLUMNS).where("n_removed = 0 or n_removed < n_lines")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays."""
    linked = materialize(link_components(docs, n=5, percent=80).where("doc_id is not null"), "linked")
    removed = materialize(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "removed")
    side = F.broadcast(removed) if removed.count() <= BROADCAST_ROWS else removed
    kept = docs.join(side, F.col("doc_id") == F.col("gone"), "left_anti")
    repeated = materialize(linked.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again"), "repeated")
    if repeated.count():
        own = kept.join(repeated, F.col("doc_id") == F.col("again"), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, F.col("doc_id") == F.col("again"), "left_anti").unionByName(own)
    return kept.select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind."""
    some = F.size("found") > 0
    out = detect(docs, COLUMNS).withColumn("text", F.when(some, redact(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(some, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of token sequences."""
    return pack(docs, "word_bpe_49k.json", end_id=1, capacity=4096)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
