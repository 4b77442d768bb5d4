"""Toxicity by multiple-instance learning: documents are bags of sentences, and only documents carry labels.

A sentence's score is a logistic model of its distinct words and their first letters (so inflected forms of a stem
count together); a document's is the noisy-or of its sentences, so one
bad sentence suffices and the same model then points at it. Training maximises the document likelihood through the
noisy-or with a sparse penalty. It uses at most ``MAX_TRAIN`` labelled documents (those with the smallest hash of
their id), which bounds what the driver holds; scoring covers every sentence of every text.

Rows: a null or empty text has no sentence and scores 0; equal rows are scored each; a null id is never held out;
labels that are null are not used; without any usable label every word weighs nothing; an empty table gives no rows.
Labels, language, source and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 6000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")
#: A word or beginning is a feature if words that so many training documents hold, summed, have it.
MIN_DOCS = 6
STEPS, RATE, SPARSE = 250, 0.5, 2e-4
START_BIAS = -6.0
MEMO_WORDS = 300_000


def features(word: str) -> list[str]:
    """A word, and its beginnings marked with a caret."""
    return [word, *["^" + word[:k] for k in range(3, min(8, len(word)))]]


def held_out(doc_id: str = "doc_id"):
    """The fold whose labels are never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> list[tuple[str, int]]:
    """Up to ``limit`` labelled (text, toxic) outside the held-out fold."""
    usable = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    chosen = usable.where(~held_out("l_id")).orderBy(F.xxhash64("l_id"), "l_id").limit(limit)
    joined = docs.select(F.col("doc_id").cast("long").alias("d_id"), F.col("text").cast("string")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))
    rows = joined.groupBy("d_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("d_id", "text", "toxic").collect()
    return [(r.text or "", int(r.toxic)) for r in sorted(rows, key=lambda r: r.d_id)]


def train(rows: list[tuple[str, int]]) -> tuple[dict[str, float], float]:
    """(word weights that are not zero, bias) of the sentence model."""
    ids: dict[str, int] = {}
    word, size, doc = array("i"), array("i"), array("i")
    holders: list[int] = []  # documents that hold each word
    for d, (text, _) in enumerate(rows):
        inside = set()
        for sentence in SENTENCE.findall(text.lower()):
            own = {ids.setdefault(w, len(ids)) for w in WORD.findall(sentence)}
            word.extend(sorted(own))
            size.append(len(own))
            doc.append(d)
            inside |= own
        holders += [0] * (len(ids) - len(holders))
        for k in inside:
            holders[k] += 1
    seen: dict[str, int] = {}
    for w, n in zip(ids, holders, strict=True):
        for f in features(w):
            seen[f] = seen.get(f, 0) + n
    vocab = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_DOCS))}
    if not vocab or len({y for _, y in rows}) < 2:
        return {}, START_BIAS
    links = np.array([(k, vocab[f]) for k, w in enumerate(ids) for f in features(w) if f in vocab], np.int32)
    of_word, of_feature, n_words = links[:, 0], links[:, 1], len(ids)
    del ids, seen, links
    word, doc = np.frombuffer(word, np.int32), np.frombuffer(doc, np.int32)
    sent = np.repeat(np.arange(len(doc), dtype=np.int32), np.frombuffer(size, np.int32))
    y = np.array([y for _, y in rows], float)
    w, b, gw, gb = np.zeros(len(vocab)), START_BIAS, np.full(len(vocab), 1e-8), 1e-8
    for _ in range(STEPS):
        own = np.bincount(of_word, w[of_feature], n_words)
        z = np.bincount(sent, own[word], len(doc)) + b
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)))
        p = np.clip(1 - none, 1e-9, 1 - 1e-9)
        dz = s * np.where(y > 0, -(1 - p) / p, 1.0)[doc] / len(y)
        dw, db = np.bincount(of_feature, np.bincount(word, dz[sent], n_words)[of_word], len(vocab)), dz.sum()
        gw, gb = gw + dw * dw, gb + db * db
        step = RATE / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSE, 0)
        b = min(b - 0.1 * RATE / math.sqrt(gb) * db, START_BIAS + 2)
    return {k: float(w[i]) for k, i in vocab.items() if w[i]}, float(b)


def score_documents(docs: DataFrame, weights: dict[str, float], bias: float, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, offending``: ``offending`` lists start:end of sentences at
    0.5 or more, as code points."""
    quiet = math.log1p(-1 / (1 + math.exp(-bias)))

    def run(batches):
        memo: dict[str, float] = {}
        for batch in batches:
            scores, counts, places = [], [], []
            for text in batch.column(1).to_pylist():
                log_none, n, bad = 0.0, 0, []
                if text:
                    low = text.lower()
                    # A letter that grows never ends a sentence, so both cases have the same sentences, at other places.
                    spans = None if len(low) == len(text) else [m.span() for m in SENTENCE.finditer(text)]
                    words = set(WORD.findall(low))
                    if len(memo) > MEMO_WORDS:
                        memo.clear()
                    for w in words.difference(memo):
                        memo[w] = sum(weights.get(f, 0.0) for f in features(w))
                    hits = {w for w in words if memo[w]}
                    for m in SENTENCE.finditer(low):
                        n += 1
                        own = hits.intersection(WORD.findall(m[0])) if hits else hits
                        if own:
                            z = max(min(bias + sum(memo[w] for w in sorted(own)), 30), -30)
                            log_none -= math.log1p(math.exp(z))
                            if z >= 0:
                                start, end = spans[n - 1] if spans else m.span()
                                bad.append(f"{start}:{end}")
                        else:
                            log_none += quiet
                scores.append(min(max(-math.expm1(log_none), 0.0), 1.0))
                counts.append(n)
                places.append(",".join(bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(places, pa.string())], names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])

    schema = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``."""
    weights, bias = train(training_rows(docs, labels))
    return score_documents(docs, weights, bias, threshold)
