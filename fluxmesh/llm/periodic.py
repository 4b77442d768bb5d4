"""Periodic runs of words, found by probing harmonic grids.

A run is a stretch of words whose smallest period is ``p``, of ``max(MIN_LENGTH, MIN_REPEATS * p)`` words or more, that no
neighbouring word extends. For each period ``p`` words are compared on the grid ``0, p, 2p, ...`` only: a run is so long
that it holds two neighbouring grid points ``jp`` with word ``jp`` equal to word ``(j+1)p``, and equal words half a period
on. All periods together probe some ``n ln n`` words. Points that survive are extended both ways by comparing slices,
which double as long as they agree. A grid point inside a run found before, whose period divides ``p``, is skipped: what
it would find has the smaller period. So has a point inside the stretch just found.

Rows: a null or empty text has no words; each row counts for itself, so repeated rows come out alike; a null id plants
nothing; an empty table gives no rows. Texts of any length are read whole, in memory of some bytes a word.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MIN_LENGTH, MIN_REPEATS = 24, 3
CHUNK = 64
#: Grid points probed at once.
PROBES = 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Runs:
    """Runs found so far, by period: starts and ends rise together."""

    def __init__(self):
        self.periods = np.zeros(0, np.int64)
        self.found: dict[int, tuple[list[int], list[int]]] = {}
        self._arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, period: int, start: int, end: int) -> None:
        if period not in self.found:
            self.periods = np.append(self.periods, period)
        starts, ends = self.found.setdefault(period, ([], []))
        starts.append(start)
        ends.append(end)

    def cover(self, points: np.ndarray, p: int) -> np.ndarray:
        """Whether ``[point, point + p]`` lies in a run whose period divides ``p``."""
        out = np.zeros(len(points), bool)
        for q in self.periods[p % self.periods == 0].tolist():
            if q not in self._arrays:  # no more runs of a smaller period are to come
                self._arrays[q] = tuple(np.array(x) for x in self.found[q])
            starts, ends = self._arrays[q]
            at = np.searchsorted(starts, points, "right") - 1
            out |= (at >= 0) & (ends[at] > points + p)
        return out


def reach(ids: np.ndarray, at: int, p: int, step: int) -> int:
    """How many words from ``at`` on (going by ``step``) equal the one ``p`` later, by slices that double."""
    done, size = 0, CHUNK
    while True:
        if step > 0:
            a = at + done
            b = min(a + size, len(ids) - p)
        else:
            b = at + 1 - done
            a = max(b - size, 0)
        if a >= b:
            return done
        equal = ids[a:b] == ids[a + p : b + p]
        if not equal.all():
            return done + int(np.argmin(equal) if step > 0 else np.argmin(equal[::-1]))
        done, size = done + b - a, 2 * size


def probed(ids: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(grid point ``x``, period ``p``) of periods ``first`` to ``last - 1`` where words ``x``, ``x + p`` and ``x + 2p`` are
    equal, and so are those half a period after ``x`` and ``x + p``; by period, then point."""
    periods = np.arange(first, last)
    counts = (len(ids) - 1) // periods - 1
    p = np.repeat(periods, counts)
    x = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
    for a, b in ((0, 2), (2, 4), (1, 3)):  # in half periods
        same = ids[x + a * p // 2] == ids[x + a * p // 2 + (b - a) // 2 * p]
        x, p = x[same], p[same]
    return x, p


def periodic_runs(ids: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ``min_repeats`` is 3 or more."""
    n, runs, first = len(ids), Runs(), 1
    last = n // min_repeats + 1 if n >= min_length else 1
    while first < last:
        upto = min(last, first + max(1, PROBES * first // n))
        xs, ps = probed(ids, first, upto)
        cuts = np.flatnonzero(np.diff(ps)) + 1
        for points, p in zip(np.split(xs, cuts), ps[np.append(0, cuts)].tolist() if len(ps) else (), strict=len(ps) > 0):
            least, after = max(min_length, min_repeats * p), -1
            for x in points[~runs.cover(points, p)].tolist():
                if x < after:
                    continue
                right = x + reach(ids, x, p, 1)  # the first word that differs from the one p later
                left = x - reach(ids, x - 1, p, -1)
                after = right
                if right + p - left >= least:
                    runs.add(p, left, right + p)
        first = upto
    return sorted((a, b - a, p) for p, (starts, ends) in runs.found.items() for a, b in zip(starts, ends, strict=True))


def plant(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth document (by the checksum of its id) gets a periodic tail of its own words."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def examine(words: list[str], min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(runs, the words without the repeats of any run)."""
    numbers: defaultdict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
    runs = periodic_runs(ids, min_length, min_repeats)
    if not runs:
        return runs, words
    depth = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return runs, [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> int | None:
    """The number of the run with the greatest length / period, the smallest start, then period."""
    return min(range(len(runs)), key=lambda i: (-Fraction(runs[i][1], runs[i][2]), runs[i][0], runs[i][2]), default=None)


def find_runs(docs: DataFrame, keep_columns: list[str], planted: bool = False, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """``keep_columns`` of ``docs(doc_id, text)``, ``n_words``, ``runs`` (start, length, period), ``best`` (the strongest run's
    place among them, from 0; null without runs) and ``collapsed``, the words outside the repeats, joined by spaces."""
    if min_repeats < 3 or min_length < 8 * min_repeats:
        raise ValueError("runs shorter than three periods (or 8 words a repeat) can lie between grid points")
    types, k = dict(docs.dtypes), len(keep_columns)
    own = docs.select(*[F.col(c).alias(f"own_{c}") for c in keep_columns], F.col("doc_id").cast("long").alias("k_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("k_text"))
    names = [*keep_columns, "n_words", "runs", "best", "collapsed"]
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            counts, found, best, kept = [], [], [], []
            for i, text in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True):
                words = WORD.findall(text)
                words = plant(words, i) if planted else words
                runs, rest = examine(words, min_length, min_repeats)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                best.append(strongest(runs))
                kept.append(" ".join(rest))
            yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(best, pa.int32()), pa.array(kept, pa.string())], names=names)

    schema = ", ".join([f"`{c}` {types[c]}" for c in keep_columns] + ["n_words long, runs array<struct<start:long,length:long,period:long>>, best int, collapsed string"])
    return own.mapInArrow(run, schema)
