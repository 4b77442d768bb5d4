import hashlib
import random
import re

import pytest
from fluxmesh.llm.infill import class_runs, cut_place, infill, restored
from pyspark.sql import functions as F

from .helpers import empty_docs, hard_docs

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h4 % 100 < 80 else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    odd = ["", " ", "\n\n", "a", " a ", "a b c", "é\x0b\x0cx\t", "<P> in a text", "two <S>", "three <M>", "<p> small", "\U0001f600 wide \U0001f600\U0001f600", "\x1c x", None]
    rows = [(None, "no id at all here")] + [(i, rng.choice(odd)) for i in range(200)] + [(i, "".join(rng.choice("ab \n\té") for _ in range(rng.randrange(80)))) for i in range(200, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("mine")).withColumn("output", F.lit(1))
    got = infill(docs, ["doc_id", "text"]).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = infill(docs, ["doc_id", "text", "g"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute(r.doc_id, r.text)
    assert infill(empty_docs(spark), ["doc_id"]).count() == 0


@pytest.mark.parametrize("unit", ["word", "char"])
def test_every_cut(unit):
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randrange(1, 40)))
        units = UNIT.findall(text) if unit == "word" else list(text)
        ends, done = class_runs(text, unit)
        assert done[-1] == len(units)
        assert [cut_place(ends, done, k, unit) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_rate_seed_and_units(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(300)], "doc_id long, text string")
    assert infill(docs, [], rate=0).where("form <> 'plain'").count() == 0
    assert infill(docs, [], rate=100, spm_rate=0).where("form <> 'psm'").count() == 0
    one, two = (infill(docs, ["doc_id"], seed=s, unit="char").where("form <> 'plain'").count() for s in (1, 2))
    assert 100 < one < 200 and 100 < two < 200
    out = infill(docs, ["text"], rate=100, unit="char").withColumn("back", restored(F.col("output"), F.col("form")))
    assert out.where("back <> text").count() == 0
    with pytest.raises(ValueError):
        infill(docs, [], unit="line")
