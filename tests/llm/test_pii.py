import hashlib
import re

from fluxmesh.llm import pii
from fluxmesh.llm.pii import detect, redact, span_string
from pyspark.sql import functions as F

from .helpers import empty_docs, hard_docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    text = (text or "").replace("1" * 5000, "")
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if valid(k, m.group())] for k, p in PATTERNS.items()}


TRICKY = [
    "a@b.com_x@y.com aaa@bbb@ccc.com .a@b.c.d. a@b",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.2.3 1.2.3 12.34.56.78.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 1 4111111111111111 4111111111111111 1",
    "+1 (217) 555-7713 +12 +1 555 1234567890123456 +49.30.123456) x+33 1 22 33 44 55-",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é mail zoë.x@y.example.com 10.0.0.1',
    "é" * 30 + "+44 20 7946 0958" + "ü" * 3,
]


def test_base_spans_match_brute_force(spark):
    docs = hard_docs(spark).select("doc_id", F.col("text"))
    docs = docs.unionByName(spark.createDataFrame([(700 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string"))
    docs = docs.where("doc_id is null or doc_id <> 900006")
    got = {(r.doc_id, r.text): r for r in detect(docs, ["doc_id", "text"]).withColumn("b", span_string("base")).withColumn("s", span_string("found")).collect()}
    for (_, text), r in got.items():
        want = brute(text)
        assert r.b == ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k]), text[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PATTERNS]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert "secret" in got[704, TRICKY[4]].s


def test_long_runs_do_not_overflow(spark):
    docs = hard_docs(spark, False).where("doc_id = 900006")
    assert detect(docs, ["doc_id"]).first().n_card == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail zoë a@b.example.com, ring +1 (217) 555-7713 now"), (2, None), (3, "plain")], "doc_id long, text string")
    out = {r.doc_id: r.t for r in detect(docs, ["doc_id", "text"]).withColumn("t", redact(F.col("text"), F.col("found"))).collect()}
    assert out == {1: "mail zoë [EMAIL], ring [PHONE] now", 2: None, 3: "plain"}


def test_empty_table_and_digest(spark):
    assert detect(empty_docs(spark), ["doc_id"]).count() == 0
    r = detect(spark.createDataFrame([(1, "x")], "doc_id long, text string"), ["doc_id"]).select(F.sha2(span_string("base"), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"").hexdigest()


def test_em_finds_the_poor_labeler():
    patterns = [("email", (1, 1, 0, 1, 1), 80), ("email", (-1, -1, 0, -1, -1), 60), ("email", (1, 1, 1, 1, -1), 10), ("email", (-1, -1, 1, -1, 1), 12)]
    post = pii.reliabilities(patterns)
    assert post[0] > 0.9 > 0.1 > post[1] and post[2] > 0.5 > post[3]
