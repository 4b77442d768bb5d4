"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose copy is it? The tables hold no images: every row of ``embeddings`` is drawn and indexed, and edited copies
    of the rows divisible by 20 are the queries. A row a query and class of pictures found, one without a class if none.
    """
    from .images import EDITS, edited_images, embedding_images, search_copies

    vectors = _table(spark, sf_dir, "embeddings")
    found, members = search_copies(edited_images(vectors), embedding_images(vectors))
    own = members.select(F.col("image_id").alias("own_id"), F.col("class_id").alias("own_class"))
    sizes = members.groupBy(F.col("class_id").alias("s_id")).agg(F.count("*").alias("n_images"))
    asked = vectors.where("vec_id % 20 = 0").select("vec_id").join(own, F.col("vec_id") == F.col("own_id"), "left")
    out = asked.join(found, F.col("vec_id") == F.col("query_id"), "left").join(sizes, F.col("class_id") == F.col("s_id"), "left")
    kind = F.get(F.array(*[F.lit(e) for e in EDITS]), F.pmod(F.floor(F.col("vec_id") / 20), F.lit(len(EDITS))).cast("int"))
    mine = F.col("class_id") == F.coalesce("own_class", "vec_id")
    return out.select("vec_id", kind.alias("edited_by"), "class_id", F.when(F.col("class_id").isNotNull(), F.coalesce("n_images", F.lit(1).cast("long"))).alias("n_images"), "votes", "turn", "scale", F.coalesce(mine, F.lit(False)).alias("is_original"))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, span_string

    found = detect(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(span_string("base"), 256).alias("base_sha256"), span_string("found").alias("spans"), "n_secret")


def op3_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    return read_warc(spark, write_warc(_table(spark, sf_dir, "pages"))).drop("url")


def op4_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import build_lexicon, encode_documents

    docs = _table(spark, sf_dir, "documents")
    return encode_documents(docs, "byte_bpe_50k.json", build_lexicon(docs, "byte_bpe_50k.json"))


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    judged = judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_flagged", F.round("shrunk_rate", 9).alias("host_rate"))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link_components

    return link_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1, capacity=4096)


def op10_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), ["doc_id", "text"])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infill, restored

    out = infill(_table(spark, sf_dir, "documents"), ["doc_id"], seed=42)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import find_runs

    out = find_runs(_table(spark, sf_dir, "documents"), ["doc_id"], planted=True)
    best = F.get("runs", "best")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    exponent = F.expr("1000 * runs[best].length div runs[best].period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), exponent.alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_image_copies, op2_weak_supervision_pii, op3_splittable_warc, op4_transducer_bpe, op5_host_quality_rules, op6_noisy_or_toxicity, op7_ngram_jaccard_join, op8_arrow_token_files, op9_best_fit_packing, op10_winnowed_line_dedup, op11_fill_in_middle, op12_tag_path_text, op13_periodic_runs)}
