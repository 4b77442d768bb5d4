import random
import zlib

import numpy as np
import pytest
from fluxmesh.llm.periodic import WORD, find_runs, periodic_runs, plant, strongest
from fluxmesh.llm.queries import op13_periodic_runs

from .helpers import SF, empty_docs, hard_docs


def brute(words, least=24):
    """Every maximal stretch of each period, without the ones of a smaller period."""
    n, out = len(words), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, 3 * p) and not any(all(words[k] == words[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j
    return sorted(out)


def test_matches_brute_force():
    rng = random.Random(3)
    for k in range(400):
        letters, words = rng.choice([1, 2, 3, 8]), []
        while len(words) < rng.randrange(1, 130):
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 14))]
            words += (unit * rng.randrange(1, 12))[: rng.randrange(1, 90)]
            words += [rng.randrange(letters) for _ in range(rng.choice([0, 0, 1, 9]))]
        assert periodic_runs(np.array(words)) == brute(words), k


def test_fibonacci_words_and_nested_periods():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic_runs(np.array(b[:700])) == brute(b[:700])
    nested = (([1] * 30 + [2]) * 4 + [3]) * 4
    assert periodic_runs(np.array(nested)) == brute(nested)


def test_long_constant_text_is_quick():
    assert periodic_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]


def test_rows_of_a_table(spark):
    docs = hard_docs(spark)
    rows = docs.collect()
    got = find_runs(docs, ["doc_id", "text", "g"], planted=True).collect()
    assert len(got) == len(rows)
    some = 0
    for r in got:
        words = WORD.findall(r.text or "")
        if r.doc_id is not None and (h := zlib.crc32(str(r.doc_id).encode())) % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [tuple(x) for x in r.runs]
        if len(words) < 1500:
            assert runs == brute(words)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert r.n_words == len(words) and r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.best == strongest(runs)
        some += len(runs)
    assert some > 10
    assert next(r for r in got if r.doc_id == 900005).runs == [(0, 30000, 1)]
    assert find_runs(empty_docs(spark), ["doc_id"]).count() == 0


def test_query_and_limits(spark):
    out = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    assert any(r.n_runs for r in out.values()) and all((r.n_runs == 0) == (r.start is None) for r in out.values())
    assert strongest([(5, 24, 8), (0, 30, 10), (0, 48, 16)]) == 1 and strongest([]) is None
    assert plant([], 3) == [] and plant(["a"], None) == ["a"]
    with pytest.raises(ValueError):
        find_runs(empty_docs(spark), [], min_repeats=2)
