import zlib

import numpy as np
from fluxmesh.llm.pii import PATTERNS
from fluxmesh.llm.wordtokens import word_encoder
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES

from .helpers import HARD, SF, empty_docs
from .test_line_dedup import check_between
from .test_ngram_join import brute as brute_pairs
from .test_quality import brute as brute_quality


def hard(spark):
    docs = spark.createDataFrame([(i, t, None, s, n) for i, t, s, n in HARD], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet"))


def test_each_stage_against_brute_force(spark):
    docs = hard(spark)
    stages = dict(STAGES)
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == COLUMNS
    rows = {r.doc_id for r in kept.collect()}
    base = {r.doc_id: brute_quality(r.text) for r in docs.collect()}
    passed = {i for i, m in base.items() if not m[5]}
    assert rows <= passed
    assert all(100 * m[2] > 10 * m[0] or 5 * m[3] > 1 for i, m in base.items() if i in passed - rows)

    cleaned = {r.doc_id: r.text for r in stages["line_dedup"](spark, kept, SF).collect()}
    check_between(sorted((r.doc_id, r.text) for r in kept.collect()), cleaned)

    docs3 = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in sorted(cleaned.items())] + [(99999, sorted(cleaned.items())[0][1] + " end", "en", "s", 1), (99999, "other", "en", "s", 1), (99999, "other", "en", "s", 1), (None, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    left = stages["near_duplicates"](spark, docs3, SF)
    plain = [(r.doc_id, r.text) for r in docs3.collect() if r.doc_id != 99999]
    lone = {i for i, _, c in brute_pairs(plain, 5, 80) if i == c}
    assert {str(r.doc_id) for r in left.collect()} - {"99999"} == lone
    assert left.where("doc_id is null").count() == 1

    clear = stages["personal_data"](spark, kept, SF)
    assert clear.columns == COLUMNS and clear.where(F.col("text").rlike(PATTERNS["email"])).count() == 0
    assert kept.where(F.col("text").rlike(PATTERNS["email"])).count() == clear.where(F.col("text").contains("[EMAIL]")).count() > 0

    packed = stages["packing"](spark, clear, SF).collect()
    enc = word_encoder("word_bpe_49k.json")
    end = np.array([1], "<u4").tobytes()
    pieces = {(r.doc_id, r.piece): r.ids_crc32 for r in packed}
    assert all(pieces[r.doc_id, 0] == zlib.crc32((enc.encode([r.text])[0] + end)[: 4 * 4096]) for r in clear.collect())


def test_whole_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    empty_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
