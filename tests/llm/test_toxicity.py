import random
import zlib

from fluxmesh.llm.toxicity import START_BIAS, score_documents, toxicity, train

from .helpers import empty_docs, hard_docs


def corpus():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(f"w{rng.randrange(60)}" for _ in range(8)) + "." for _ in range(rng.randrange(2, 9))]
        bad = rng.random() < 0.3
        if bad:
            sentences[rng.randrange(len(sentences))] = f"you are vile{rng.choice(['', 'ness', 'ly'])} w{rng.randrange(60)}."
        rows.append((i, " ".join(sentences)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_documents_and_their_sentences(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i, r in sorted(out.items()) if r.held_out] == held
    right = [out[i].predicted == labels[i][2] for i in held]
    assert sum(right) >= 0.95 * len(right)
    for i in held:
        if out[i].predicted:
            text = rows[i][1]
            assert any("vile" in text[a:b] for a, b in (map(int, s.split(":")) for s in out[i].offending.split(",")))


def test_case_of_a_text_whose_lower_case_is_longer(spark):
    """An upper-case toxic sentence weighs the same beside a letter that grows, and its place is that of the text."""
    texts = ["Quiet words. You are VILE. More.", "Quiet words İİ. You are VILE. More."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in score_documents(docs, {"vile": 9.0}, START_BIAS).collect()}
    assert out[0].predicted == out[1].predicted == 1 and out[0].score == out[1].score
    for i, text in enumerate(texts):
        a, b = map(int, out[i].offending.split(":"))
        assert text[a:b] == " You are VILE."


def test_hard_rows(spark):
    labels = spark.createDataFrame([(900004, 1, 1), (900004, 0, None), (None, 1, 1), (123456, 1, 0)], "doc_id long, quality int, toxic int")
    docs = hard_docs(spark, False)
    out = toxicity(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (900001, 900002, 900003)} <= {0.0} | {r.score for r in out if r.doc_id == 900003}
    assert toxicity(empty_docs(spark), labels).count() == 0
    assert train([])[0] == {} and train([("a b", 1)])[0] == {}
