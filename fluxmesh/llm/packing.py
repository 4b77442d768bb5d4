"""Packing documents into token sequences: best fit, then a local search that exchanges documents between bins.

Documents longer than a sequence are cut into full pieces and a rest; every other document stays whole. Pieces are
dealt by a hash of their identity into groups of about ``GROUP`` pieces; a group is packed by best fit decreasing,
after which the bins that are not full exchange pieces: a move, a one-for-one or a two-for-one swap is taken whenever
it raises the sum of squared fills, between any two of them, until no such exchange is left or the tokens need as many
bins as there are. A group holds so many pieces that it loses less than one bin against packing all pieces together.

Rows: a null text is empty and is one piece, the end id; rows with a null id or the same id are packed each as its own
document; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize
from .wordtokens import encoded_batches

GROUP = 60_000
PIECES = "doc_id long, copy int, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece. ``copy`` numbers equal ids in a task so that repeated rows keep apart."""

    def cut(batches):
        for batch in batches:
            for ids, encoded in encoded_batches(batch, tokenizer):
                rows = []
                end = np.array([end_id], "<u4").tobytes()
                for k, (i, body) in enumerate(zip(ids, encoded, strict=True)):
                    body += end
                    n = len(body) // 4
                    view = memoryview(body)
                    rows += [(i, k, p, p * capacity, min(capacity, n - p * capacity), zlib.crc32(view[4 * p * capacity : 4 * (p + 1) * capacity])) for p in range(-(-n // capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing. Bins of each free size are stacked; a bit per size finds the smallest that is enough."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sizes, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = sizes >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                sizes &= ~(1 << free)
            bins[b].append(i)
            free -= n
        else:
            b, free = len(bins), capacity - n
            bins.append([i])
        if free:
            stacks[free].append(b)
            sizes |= 1 << free
    return bins


def drain(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between underfull bins, until no exchange raises the sum of squared fills or as few bins are left
    as the tokens need."""
    least = -(-sum(lengths) // capacity)
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    work = [b for b in bins if sum(lengths[i] for i in b) < capacity]
    left = len(full) + len(work)
    if left <= least:
        return full + work
    rooms = _Rooms(work, lengths, capacity)
    gained = True
    while gained and left > least:
        gained = False
        for src in sorted((k for k in range(len(work)) if work[k]), key=lambda k: (-rooms.room[k], k)):
            if rooms.room[src] and _exchange(src, work, lengths, rooms):
                gained = True
                left -= not work[src]
                if left <= least:
                    break
    return full + [b for b in work if b]


class _Rooms:
    """For each sum of none, one or two pieces of a bin, the rooms of the underfull bins that hold such pieces."""

    def __init__(self, work: list[list[int]], lengths: list[int], capacity: int):
        self.work, self.lengths, self.many = work, lengths, len(work)
        self.room = [capacity - sum(lengths[i] for i in b) for b in work]
        self.lists: list[list[int]] = [[] for _ in range(capacity)]
        self.most = np.full(capacity, -1, np.int64)  # the largest room of each list
        self.at = np.arange(capacity)
        for k in range(len(work)):
            self.add(k)

    def sums(self, k: int) -> set[int]:
        own = sorted(self.lengths[i] for i in self.work[k])
        once = sorted(set(own))
        twice = {2 * x for x, y in zip(own, own[1:], strict=False) if x == y}
        return {0, *once, *twice, *(x + y for p, x in enumerate(once) for y in once[p + 1 :])}

    def add(self, k: int) -> None:
        if self.work[k] and self.room[k]:
            key = self.room[k] * self.many + k
            for s in self.sums(k):
                insort(self.lists[s], key)
                self.most[s] = self.lists[s][-1] // self.many

    def drop(self, k: int) -> None:
        if self.work[k] and self.room[k]:
            key = self.room[k] * self.many + k
            for s in self.sums(k):
                rooms = self.lists[s]
                rooms.pop(bisect_left(rooms, key))
                self.most[s] = rooms[-1] // self.many if rooms else -1

    def partner(self, n: int, own: int) -> tuple[int, int] | None:
        """(bin, sum given back) by which a piece of ``n`` from a bin with room ``own`` raises the squared fill, the
        most tokens first; the bin has room for what it gains and ends fuller than the source was."""
        for s in np.flatnonzero(self.at[:n] + self.most[:n] >= n).tolist():
            rooms = self.lists[s]
            at = bisect_left(rooms, (n - s) * self.many)
            if rooms[at] // self.many < n - s + own:
                return rooms[at] % self.many, s
        return None


def _exchange(src: int, work: list[list[int]], lengths: list[int], rooms: _Rooms) -> bool:
    """Exchange pieces of bin ``src`` with other bins while it can; true if the sum of squared fills rose."""
    gained, again = False, True
    rooms.drop(src)
    while again:
        again = False
        for a in sorted(work[src], key=lambda i: (-lengths[i], i)):
            found = rooms.partner(lengths[a], rooms.room[src])
            if not found:
                continue
            k, s = found
            back = _pieces(work[k], lengths, s)
            rooms.drop(k)
            work[k] = [i for i in work[k] if i not in back] + [a]
            work[src] = [i for i in work[src] if i != a] + back
            rooms.room[k] -= lengths[a] - s
            rooms.room[src] += lengths[a] - s
            rooms.add(k)
            gained = again = True
            break
    rooms.add(src)
    return gained


def _pieces(own: list[int], lengths: list[int], s: int) -> list[int]:
    """None, one or two pieces that sum to ``s``."""
    if not s:
        return []
    seen: dict[int, int] = {}
    for i in own:
        if lengths[i] == s:
            return [i]
        if s - lengths[i] in seen:
            return [seen[s - lengths[i]], i]
        seen[lengths[i]] = i
    raise ValueError("no such pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece; offsets have no gaps."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = materialize(pieces_of(docs, tokenizer, end_id, capacity), "pieces")
    groups = max(1, round(pieces.count() / group))

    @lean
    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_pylist()
        bins = drain(best_fit(lengths, capacity), lengths, capacity)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = t.column("g")[0].as_py() << 40
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                seq[i], off[i] = base + b, at
                at += lengths[i]
        kept = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "copy", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
