"""Personal data by weak supervision, in built-in functions only.

Patterns propose spans in each text; labelers vote on every span: a strict form, a gazetteer, a cue word before it,
its borders and its variety of characters. Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is; its posteriors train the final span classifier, a logistic model over votes and kind. The
base kinds (email, ip, card, phone) always keep their valid spans; other kinds are added where the classifier says so.

What reaches the driver is the table of vote patterns: at most ``5 kinds * 3 ** 5`` rows whatever the corpus.

Rows: a null text is empty and has no spans; equal rows are searched each; an empty table gives no rows; patterns are
possessive, so a run of digits or letters of any length is read once and needs no stack. Only ``doc_id`` and ``text``
are read. Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import let

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
# The base patterns, written so that a match can start only where the leftmost search would start one.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
VALID_IP = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$"
# Gazetteers.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|io|de|fr|es|it|uk|us|eu|ch|at|nl|be"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|6"
CUES = {"email": "mail|contact|write|reach", "ip": "ip|host|addr|server|login", "card": "card|visa|pay|credit", "phone": "tel|phone|call|fax|mobile", "secret": "token|key|secret|passw|auth|bearer"}
VOTERS = ("form", "gazetteer", "cue", "border", "variety")
ROUNDS = 40


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(VALID_IP)
    if kind == "card":
        return F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.char_length(_digits(s)).between(8, 15)
    return F.lit(True)


def _votes(kind: str, s: Column, left: Column, right: Column) -> list[Column]:
    """Each labeler's vote on the span ``s`` between ``left`` (up to 24 characters) and ``right`` (one)."""
    digits = F.char_length(_digits(s))
    form, known = {
        "email": (_vote(s.rlike(r"^[A-Za-z0-9]"), s.rlike(r"^[.%+-]|\.\.")), _vote(s.rlike(rf"(?i)\.({TOP_DOMAINS})$"), s.rlike(r"\.[0-9]+$"))),
        "ip": (_vote(s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), s.rlike(r"(^|\.)0[0-9]")), _vote(s.rlike(r"^([1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), s.rlike(r"^0"))),
        "card": (_vote(digits == 16, digits > 16), _vote(s.rlike(rf"^({ISSUERS})"), s.rlike("^[01]"))),
        "phone": (_vote(digits.between(10, 13), digits < 9), _vote(s.rlike(rf"^\+({CALLING_CODES})"), s.rlike(r"^\+0"))),
        "secret": (_vote(F.char_length(s).isin(32, 40, 64), F.lit(False)), _vote(s.rlike("[a-f]") & s.rlike("[0-9]"), ~(s.rlike("[a-f]") & s.rlike("[0-9]")))),
    }[kind]
    cue = _vote(left.rlike(rf"(?i)({CUES[kind]})"), F.lit(False))
    border = _vote(~left.rlike(r"[\p{L}\p{N}]$") & ~right.rlike(r"^[\p{L}\p{N}]"), left.rlike(r"[\p{L}\p{N}]$") & right.rlike(r"^[\p{L}\p{N}]"))
    kinds_of = F.size(F.array_distinct(F.split(s, "")))
    return [form, known, cue, border, _vote(kinds_of > 5, kinds_of < 4)]


def _spans(kind: str, text: Column) -> Column:
    """Candidates of a kind in one text: ``kind, start, end, valid, votes``; offsets are sums over the parts between."""

    def build(parts: Column) -> Column:
        gaps, hits, sizes = parts["gaps"], parts["hits"], parts["sizes"]

        def span(s: Column, i: Column) -> Column:
            start = F.aggregate(F.slice(sizes, 1, 2 * i + 1), F.lit(0), lambda a, x: a + x)
            left, right = F.right(F.get(gaps, i), F.lit(24)), F.left(F.get(gaps, i + 1), F.lit(1))
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(s)).alias("end"), _valid(kind, s).alias("valid"), *[v.alias(n) for n, v in zip(VOTERS, _votes(kind, s, left, right), strict=True)])

        return F.filter(F.transform(hits, span), lambda x: x["valid"])

    pattern = PATTERNS[kind]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = let(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda p: F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), F.flatten(F.transform(p["gaps"], lambda g, i: F.array(F.char_length(g), F.coalesce(F.char_length(F.get(p["hits"], i)), F.lit(0))))).alias("sizes")))
    found = let(sizes, build)
    some = text.contains(NEEDS[kind]) & text.rlike(pattern) if kind in NEEDS else text.rlike(pattern)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,valid:boolean," + ",".join(f"{v}:int" for v in VOTERS) + ">>")
    return F.when(some, found).otherwise(empty)


def candidates(docs: DataFrame, keep_columns: list[str]) -> DataFrame:
    """``keep_columns`` and ``spans``: the valid candidates of every whole text, by kind and start. Written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(*[F.col(c).alias(f"own_{c}") for c in keep_columns], F.concat(*[_spans(k, text) for k in KINDS]).alias("spans"))
    return materialize(found, "pii")


def fit(found: DataFrame) -> dict[str, float]:
    """Weights of the final classifier, from the counted vote patterns of all candidates."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{v}" for v in VOTERS]).count().collect()
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTERS), r["count"]) for r in rows)
    return train(patterns, reliabilities(patterns))


def reliabilities(patterns: list[tuple]) -> list[float]:
    """EM: the posterior that a pattern's spans are personal data, with a prior a kind and a table a labeler."""
    prior = {k: 0.5 for k, _, _ in patterns}
    given = [{(y, v): (0.7 if (v > 0) == (y == 1) else 0.3) if v else 0.5 for y in (0, 1) for v in (-1, 0, 1)} for _ in VOTERS]
    post: list[float] = []
    for _ in range(ROUNDS):
        post = []
        for k, votes, _ in patterns:
            z = math.log(prior[k] / (1 - prior[k])) + sum(math.log(g[1, v] / g[0, v]) for g, v in zip(given, votes, strict=True))
            post.append(1 / (1 + math.exp(-max(min(z, 30), -30))))
        for k in prior:
            own = [(p, n) for (kk, _, n), p in zip(patterns, post, strict=True) if kk == k]
            prior[k] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for j, g in enumerate(given):
            for y in (0, 1):
                mass = {v: 1.0 + (v > 0) * y + (v < 0) * (1 - y) for v in (-1, 0, 1)}
                for (_, votes, n), p in zip(patterns, post, strict=True):
                    mass[votes[j]] += n * (p if y else 1 - p)
                for v in mass:
                    g[y, v] = mass[v] / sum(mass.values())
    return post


def train(patterns: list[tuple], post: list[float], steps: int = 400) -> dict[str, float]:
    """Logistic regression on the posteriors, weighted by counts; features are the kind and the votes."""
    weights = {k: 0.0 for k in (*KINDS, *VOTERS)}
    total = sum(n for _, _, n in patterns) or 1
    for _ in range(steps):
        grad = dict.fromkeys(weights, 0.0)
        for (k, votes, n), p in zip(patterns, post, strict=True):
            z = weights[k] + sum(weights[v] * x for v, x in zip(VOTERS, votes, strict=True))
            err = n / total * (1 / (1 + math.exp(-max(min(z, 30), -30))) - p)
            grad[k] += err
            for v, x in zip(VOTERS, votes, strict=True):
                grad[v] += err * x
        for w in weights:
            weights[w] -= 2.0 * (grad[w] + 1e-4 * weights[w])
    return weights


def detect(docs: DataFrame, keep_columns: list[str]) -> DataFrame:
    """``keep_columns``, counts a kind, ``base`` and ``found``: arrays of spans (kind, start, end, score)."""
    found = candidates(docs, keep_columns)
    weights = fit(found)

    def scored(x: Column) -> Column:
        z = F.coalesce(*[F.when(x["kind"] == k, F.lit(weights[k])) for k in KINDS])
        for v in VOTERS:
            z = z + F.lit(weights[v]) * x[v]
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (1 / (1 + F.exp(-z))).alias("score"))

    spans = F.filter(F.transform("spans", scored), lambda x: x["kind"].isin(*BASE) | (x["score"] >= 0.5))
    out = found.select(*[F.col(f"own_{c}").alias(f"own_{c}") for c in keep_columns], spans.alias("found"))
    out = out.withColumn("base", F.filter("found", lambda x: x["kind"].isin(*BASE)))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(*[F.col(f"own_{c}").alias(c) for c in keep_columns], *counts, "base", "found")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def span_string(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, the one that starts first."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        taken = F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        return F.when(x["start"] >= a["at"], taken).otherwise(a)

    return F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
