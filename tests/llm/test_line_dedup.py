import random

import pytest
from fluxmesh.llm.line_dedup import dedup_lines, merge_runs

from .helpers import empty_docs, hard_docs


def repeated_lines(rows, least):
    """Per id the lines of every run of equal lines, ``least`` words or more in all, that begins anywhere earlier as well:
    all pairs of lines, along each diagonal; nothing of fingerprints."""
    lines, docs = [], []
    for d, (_, text) in enumerate(rows):
        lines += [x for x in (text or "").split("\n")]
        docs += [d] * (len(lines) - len(docs))
    first = {d: docs.index(d) for d in set(docs)}
    words, out = [len(x.split()) for x in lines], {i: set() for i, _ in rows}
    for off in range(1, len(lines)):
        run = []
        for y in range(off, len(lines) + 1):
            x = y - off
            goes_on = y < len(lines) and lines[x] == lines[y] and (not run or (docs[run[-1]] == docs[y] and docs[run[-1] - off] == docs[x]))
            if goes_on:
                run.append(y)
                continue
            while run and not words[run[0]]:
                del run[0]
            while run and not words[run[-1]]:
                del run[-1]
            if sum(words[k] for k in run) >= least:
                out[rows[docs[run[0]]][0]].update(k - first[docs[run[0]]] for k in run if words[k])
            run = [y] if y < len(lines) and lines[x] == lines[y] else []
    return out


def check_between(rows, cleaned, gram_words=40, run_words=50):
    """``cleaned`` (id to text) lacks all lines of repeated runs of ``run_words`` words, and no line but of repeated runs of
    ``gram_words`` words (lines without words aside)."""
    must, may = repeated_lines(rows, run_words), repeated_lines(rows, gram_words)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in (cleaned.get(i) or "").split("\n") if x.split()]
        most = iter([x for k, x in enumerate(lines) if x.split() and k not in must[i]])
        assert all(x in most for x in kept), i
        rest = iter(kept)
        assert all(x in rest for k, x in enumerate(lines) if x.split() and k not in may[i]), i


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 15, 60]))) for _ in range(30)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [" ".join(f"u{rng.randrange(9999)}" for _ in range(12))]
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    check_between(rows, got)


@pytest.mark.parametrize("tail", range(1, 13))
def test_tails_of_longer_runs(spark, tail):
    """A holds R, B and C hold R S, S a line of any length: S goes from C."""
    rng = random.Random(tail)
    rows = []
    for k in range(20):
        line = lambda n, k=k: " ".join(f"t{k}r{rng.randrange(10**6)}" for _ in range(n))
        r, s = [line(10) for _ in range(5)], line(tail)
        for lines in (r, [*r, s], [*r, s], [line(4), *r[2:], s, *r]):
            rows.append((len(rows), "\n".join([line(3), *lines, line(3)])))
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    check_between(rows, kept)
    assert all(len(kept[i].split("\n")) == 2 for i in range(len(rows)) if i % 4 == 2)


def test_many_line_widths(spark):
    rng = random.Random(11)
    pool = [" ".join(f"v{k}x{j}" for j in range(rng.randrange(4, 25))) for k in range(40)]
    rows = []
    for i in range(150):
        at = rng.randrange(30)
        rows.append((i, "\n".join([f"own {i}", *pool[at : at + rng.randrange(1, 11)], *([""] * rng.randrange(2)), *pool[at // 2 : at // 2 + rng.randrange(4)], f"end {i}"])))
    kept = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    check_between(rows, kept)


def test_runs_that_only_a_later_copy_extends(spark):
    """A holds R, B holds R S, later ones R, R S or S T: whatever an earlier text of any kind holds goes."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        line = lambda n, k=k: " ".join(f"k{k}r{rng.randrange(10**6)}" for _ in range(n))
        r, s, t = [line(10) for _ in range(5)], [line(10)], [line(9) for _ in range(5)]
        for lines in (r, r + s, r, r + s + t, r + s, s + t):
            rows.append((len(rows), "\n".join([line(3), *lines, line(3)])))
    kept = {r.doc_id: r.text.split("\n") for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    check_between(rows, {i: "\n".join(x) for i, x in kept.items()})
    assert all(len(kept[i]) == 2 for i in range(len(rows)) if i % 6 in (2, 4, 5))


def test_every_long_run_is_caught(spark):
    passage = "\n".join(" ".join(f"p{k}x{j}" for j in range(7)) for k in range(8))
    one_line = " ".join(f"q{k}" for k in range(51))
    rows = [(i, f"own {i} start\n{passage if i % 2 else one_line}\nown {i} end") for i in range(40)]
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    assert out[0].n_removed == out[1].n_removed == 0
    assert all(out[i].text == f"own {i} start\nown {i} end" for i in range(2, 40))


def test_hard_rows(spark):
    docs = hard_docs(spark)
    out = dedup_lines(docs, ["doc_id", "text", "g"]).collect()
    assert len(out) == docs.count()
    by = {(r.doc_id, r.g): r for r in out}
    assert by[900001, 2].text is None and by[900001, 2].n_lines == 0 and by[900002, None].text == ""
    assert by[900005, 5].n_removed == 0
    assert dedup_lines(empty_docs(spark), ["doc_id", "text"]).count() == 0


def test_copies_keep_the_first(spark):
    text = "\n".join(" ".join(f"l{k}w{j}" for j in range(10)) for k in range(6))
    out = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(5, text), (3, text), (9, text + "\nmore")], "doc_id long, text string"), ["doc_id", "text"]).collect()}
    assert out[3].text == text and out[5].text == "" and out[9].text == "more"
    assert merge_runs([(4, 6), (0, 2), (2, 3), (5, 9)]) == [(0, 3), (4, 9)]
