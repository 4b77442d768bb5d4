"""Removal of repeated runs of lines by winnowing.

A gram is the shortest run of whole lines from a line on that holds ``GRAM_WORDS`` words or more. For each line, among
the grams that lie in the shortest run of ``RUN_WORDS`` words from it, the one with the smallest hash is a fingerprint;
likewise for the shortest run that ends with the line. So any two equal runs of either kind select an equal gram. Matches
of a repeated fingerprint are found twice:

* with the fingerprint's first occurrence (in order of document, then line): the match is extended line by line both
  ways and the later run is deleted, so runs of ``GRAM_WORDS`` words go as well;
* with all others: the runs of ``RUN_WORDS`` words that selected the fingerprint are compared by their own hash, and
  every one but the first is deleted. A match so grows to its whole length, whichever earlier text holds it: of a repeated
  passage the first lines are the shortest run from its start, and each later line ends a shortest run inside it.

So each line with words of a run of ``RUN_WORDS`` words of whole lines that stood anywhere before is deleted. A
fingerprint or run of any frequency costs one row an occurrence.

Lines are what ``\\n`` separates; their 64-bit hashes are compared. A deleted run has ``GRAM_WORDS`` words at least.

Rows: a null text stays null and has no lines; documents without an id come first; rows that share an id are ordered
by a hash of their text, and rows equal in both are one document, each losing the same lines; an empty table gives no
rows. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

GRAM_WORDS, RUN_WORDS = 40, 50
#: Documents that meet one copy of a first occurrence's lines.
SALT_ROWS = 256


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """(signed 64-bit hash, words) of each line."""
    lines = text.split("\n")
    return [_signed(xxhash.xxh3_64_intdigest(x.encode())) for x in lines], [len(x.split()) for x in lines]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def winnow(hashes: list[int], words: list[int], gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """(gram hash, first line) of the selected grams, and (run hash, first line, end, hash of its gram) of each run: the
    shortest ones from each line and to each line."""
    n = len(hashes)

    def ends(least: int) -> list[int]:
        """For each line the end of the shortest run from it with ``least`` words, or 0."""
        out, end, held = [0] * n, 0, 0
        for i in range(n):
            while end < n and held < least:
                held += words[end]
                end += 1
            out[i] = end if held >= least else 0
            held -= words[i]
        return out

    gram_end, run_end = ends(gram_words), ends(run_words)
    keys: dict[int, int] = {}
    packed = np.array(hashes, "<i8").tobytes()

    def key(i: int) -> int:
        if i not in keys:
            keys[i] = _signed(xxhash.xxh3_64_intdigest(packed[8 * i : 8 * gram_end[i]]))
        return keys[i]

    spans, begin, held = [(i, run_end[i]) for i in range(n) if run_end[i] and words[i]], 0, 0
    for end in range(1, n + 1):
        held += words[end - 1]
        while held - words[begin] >= run_words:
            held -= words[begin]
            begin += 1
        # The shortest run to this line, if it is not the shortest from its own first line as well.
        if words[end - 1] and held >= run_words and run_end[begin] != end:
            spans.append((begin, end))
    chosen: dict[int, int] = {}
    runs = []
    for i, end in spans:
        best, j = (key(i), i), i + 1
        while j < end and gram_end[j] and gram_end[j] <= end:
            if words[j] and (k := key(j)) < best[0]:
                best = (k, j)
            j += 1
        chosen[best[1]] = best[0]
        runs.append((_signed(xxhash.xxh3_64_intdigest(packed[8 * i : 8 * end])), i, end, best[0]))
    return sorted((k, i) for i, k in chosen.items()), runs


def extend(own: list[int], other: list[int], seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of lines ``[a, b)`` of ``own`` that equal lines of ``other`` around the seeds (own line, other line)."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, j in sorted(seeds):
        done = runs.setdefault(i - j, [])
        if done and done[-1][0] <= i < done[-1][1]:
            continue
        a, b = i, i + 1
        while a > 0 and a - 1 - (i - j) >= 0 and own[a - 1] == other[a - 1 - (i - j)]:
            a -= 1
        while b < len(own) and b - (i - j) < len(other) and own[b] == other[b - (i - j)]:
            b += 1
        done.append((a, b))
    return [r for found in runs.values() for r in found]


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deleted_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``doc_id, text_hash, removed``: the line ranges ``[a, b)`` to delete from each document that has any."""

    print_type = pa.list_(pa.struct([("gram", pa.int64()), ("line", pa.int32())]))
    run_type = pa.list_(pa.struct([("run", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("gram", pa.int64())]))

    def lines(batches):
        for batch in batches:
            for part in slices(batch):
                found = [line_hashes(t) for t in part.column(2).to_pylist()]
                prints = [winnow(h, w, gram_words, run_words) for h, w in found]
                chosen = [[dict(zip(("gram", "line"), x, strict=True)) for x in p] for p, _ in prints]
                runs = [[dict(zip(("run", "a", "b", "gram"), x, strict=True)) for x in r] for _, r in prints]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array(chosen, print_type), pa.array(runs, run_type)], names=["doc_id", "text_hash", "hashes", "prints", "runs"])

    own = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    kept = materialize(own.mapInArrow(lines, "doc_id long, text_hash long, hashes array<bigint>, prints array<struct<gram:bigint,line:int>>, runs array<struct<run:bigint,a:int,b:int,gram:bigint>>"), "lines")
    place = F.struct("doc_id", "text_hash", "line").alias("place")
    prints = kept.select("doc_id", "text_hash", F.explode("prints").alias("p")).select("doc_id", "text_hash", "p.gram", "p.line")
    first = prints.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final").select(F.col("gram").alias("f_gram"), "first")
    later = prints.join(first, F.col("gram") == F.col("f_gram")).where(F.struct("doc_id", "text_hash", "line") > F.col("first"))
    seeds = later.groupBy("doc_id", "text_hash", F.col("first.doc_id").alias("f_id"), F.col("first.text_hash").alias("f_hash")).agg(F.collect_set(F.struct(F.col("line").alias("own"), F.col("first.line").alias("other"))).alias("seeds"))
    unique = kept.groupBy("doc_id", "text_hash").agg(F.first("hashes").alias("hashes"))
    # A first occurrence that many documents share is dealt out with them.
    sources = seeds.groupBy("f_id", "f_hash").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")).select(F.col("f_id").alias("s_id"), F.col("f_hash").alias("s_hash"), "salts")
    is_source = lambda i, h: F.col(i).eqNullSafe(F.col("s_id")) & (F.col(h) == F.col("s_hash"))
    other = unique.select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("hashes").alias("other")).join(sources, is_source("o_id", "o_hash"))
    other = other.withColumn("o_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("o_id", "o_hash", "other", "o_salt")
    seeds = seeds.join(sources, is_source("f_id", "f_hash")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), "salts").cast("int"))
    pairs = seeds.join(other, F.col("f_id").eqNullSafe(F.col("o_id")) & (F.col("f_hash") == F.col("o_hash")) & (F.col("salt") == F.col("o_salt")))
    mine = unique.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), F.col("hashes").alias("mine"))
    both = pairs.join(mine, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))).select("doc_id", "text_hash", "mine", "other", "seeds")

    def grow(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 5)), strict=True)
            found = [extend(m, o, [(s["own"], s["other"]) for s in seeds]) for m, o, seeds in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"a": a, "b": b} for a, b in f] for f in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["doc_id", "text_hash", "runs"])

    grown = both.mapInArrow(grow, "doc_id long, text_hash long, runs array<struct<a:int,b:int>>")
    # Runs of repeated fingerprints, wherever they stood before.
    runs = kept.select("doc_id", "text_hash", F.explode("runs").alias("r")).select("doc_id", "text_hash", "r.*").join(first.select("f_gram"), F.col("gram") == F.col("f_gram"), "left_semi")
    start = F.struct("doc_id", "text_hash", "a")
    earliest = runs.groupBy("run").agg(F.min(start).alias("first"), F.max(start).alias("final")).where("first < final").select(F.col("run").alias("e_run"), "first")
    again = runs.join(earliest, F.col("run") == F.col("e_run")).where(start > F.col("first")).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return materialize(grown.unionByName(again).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("removed")), "runs")


def dedup_lines(docs: DataFrame, keep_columns: list[str], gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``keep_columns`` with the cleaned ``text``, ``n_lines``, ``n_removed`` and ``removed`` (first-last, inclusive)."""
    runs = deleted_runs(docs, gram_words, run_words).select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "removed")
    others = [c for c in keep_columns if c != "text"]
    own = docs.select(*[F.col(c).alias(f"own_{c}") for c in others], F.col("doc_id").cast("long").alias("k_id"), F.col("text").cast("string").alias("k_text"))
    # Always by a shuffle: whether the deletions are few enough to be sent everywhere depends on the corpus.
    joined = own.join(runs.hint("merge"), F.col("k_id").eqNullSafe(F.col("r_id")) & (F.xxhash64("k_text") == F.col("r_hash")), "left").select(*[f"own_{c}" for c in others], F.col("k_text").alias("text"), "removed")
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in others] + ["text string", "n_lines long", "n_removed long", "removed string"])
    names = [*others, "text", "n_lines", "n_removed", "removed"]

    def cut(batches):
        for part in (p for batch in batches for p in slices(batch)):
            texts, totals, counts, places = [], [], [], []
            for text, runs in zip(part.column(len(others)).to_pylist(), part.column(len(others) + 1).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                gone = merge_runs([(r["a"], r["b"]) for r in runs or []])
                totals.append(len(lines))
                counts.append(sum(b - a for a, b in gone))
                places.append(",".join(f"{a}-{b - 1}" for a, b in gone))
                for a, b in reversed(gone):
                    del lines[a:b]
                texts.append(text if not gone else "\n".join(lines))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.string())], names=names)

    return joined.mapInArrow(cut, schema)
