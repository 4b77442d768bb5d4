import random

import numpy as np

from fluxmesh.llm import ngram_join
from fluxmesh.llm.ngram_join import link_components

from .helpers import empty_docs, hard_docs


def shingles(text, n):
    words = (text or "").encode().translate(ngram_join.LOWER).split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    """All pairs, then components; rows that share an id stay apart unless their texts link."""
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None and 100 * o >= percent * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(None if i is None else low[find(k)])) for k, (i, _) in enumerate(rows))


def got(spark, rows, n, percent):
    out = link_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out)


def corpus(seed, groups=14):
    rng = random.Random(seed)
    rows, at = [], 0
    common = " ".join(f"c{k}" for k in range(20))
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.randrange(1, 7)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            rows.append((at, " ".join(words) + (" " + common if rng.random() < 0.4 else "")))
            at += 1
    return rows


def test_matches_all_pairs(spark):
    rows = corpus(3) + [(500, "A b  C\td"), (501, "a B c D"), (502, ""), (503, None), (504, "one two"), (505, "one  two"), (None, "one two"), (504, "one two")]
    assert got(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_other_threshold_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 4)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(70):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(120)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    assert got(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_long_list_of_sets_that_do_not_link(spark, monkeypatch):
    """A common passage makes one long list, whose members mostly stay apart; blocks of a few classes decide them."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = random.Random(4)
    core = [f"c{k}" for k in range(90)]
    rows = []
    for i in range(90):
        own = [f"o{rng.randrange(12)}" for _ in range(rng.choice([3, 6, 8]))]
        at = rng.randrange(80)
        rows.append((i, " ".join(core[:at] + own[:3] + core[at:] + own[3:])))
    expected = brute(rows, 4, 85)
    assert 5 < len({c for _, _, c in expected}) < 90
    assert got(spark, rows, 4, 85) == expected


def test_block_links_count_partial_overlaps():
    rng = np.random.default_rng(1)
    pools = [np.arange(q * 100, q * 100 + 60) for q in range(ngram_join.OVERLAP_FRAGMENTS)]
    sides = [[[np.sort(rng.choice(p, rng.integers(40, 60), False)) for p in pools] for _ in range(k)] for k in (7, 9)]
    rows = [[(np.concatenate([c[q] for c in side]), np.repeat(np.arange(len(side)), [len(c[q]) for c in side])) for q in range(len(pools))] for side in sides]
    sizes = [np.array([sum(map(len, c)) for c in side]) for side in sides]
    comps = [np.arange(7), np.array([0, 20, 21, 22, 23, 24, 25, 26, 27])]
    found = ngram_join.block_links(rows, sizes, comps, 70)
    for i, a in enumerate(sides[0]):
        for j, b in enumerate(sides[1]):
            x, y = set(np.concatenate(a)), set(np.concatenate(b))
            assert found[i, j] == (comps[0][i] != comps[1][j] and 100 * len(x & y) >= 70 * len(x | y))


def test_hard_rows(spark):
    docs = hard_docs(spark)
    out = link_components(docs).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert by[900001].n_shingles == by[900002].n_shingles == 0 and by[900002].component_id == 900002
    assert by[900005].n_shingles == 1 and by[None].component_id is None
    assert link_components(empty_docs(spark)).count() == 0
