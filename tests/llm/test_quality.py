import re
from collections import Counter

from fluxmesh.llm.quality import judge
from pyspark.sql import functions as F

from .helpers import empty_docs, hard_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spans = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if spans[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_counts_match_brute_force(spark):
    docs = hard_docs(spark)
    extra = spark.createDataFrame([(7, "a b c d e f g h a b c d e f g h a b c d e f g h", "s", 1), (8, "x " * 9, "s", 1), (9, "\n".join(["one two", "", "one two", " "] * 3), "t", 1)], docs.select("doc_id", "text", "source", "g").schema)
    docs = docs.unionByName(extra)
    got = Counter(tuple(r) for r in judge(docs, ["doc_id", "text"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert got == want


def test_host_verdicts_shrink_and_spare_clean_documents(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    noisy = clean + " " + " ".join(f"|{i}" for i in range(30))
    rows = [(i, clean, "good") for i in range(60)] + [(100 + i, noisy, "bad") for i in range(60)] + [(200, clean, "bad"), (300, noisy, "tiny"), (301, noisy, None)]
    out = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert all(out[i].kept for i in range(60)) and not any(out[100 + i].kept for i in range(60))
    assert out[200].kept and out[200].host_flagged and out[301].kept
    assert out[300].shrunk_rate < 1.0


def test_empty_table(spark):
    assert judge(empty_docs(spark), ["doc_id"]).count() == 0


def test_no_python_in_the_plan(spark):
    plan = judge(hard_docs(spark, False).withColumn("doc_id", F.col("doc_id")), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
