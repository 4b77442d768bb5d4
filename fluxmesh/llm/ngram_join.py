"""Near-duplicate documents by an exact n-gram Jaccard join with vertical partitioning.

1. Every text becomes its set of distinct word n-grams (64-bit hashes). Texts with equal sets form a class, and only
   classes are compared. Each task sends a class once, so copies cost nothing beyond their own task.
2. The n-gram order is cut into fragments, ranges of the hash. A fragment counts how many classes hold each n-gram;
   n-grams of a single class can not overlap and are only counted, the others are sent on to their classes.
3. A class orders its n-grams by frequency and hash. Two sets that reach the threshold share an n-gram in their
   prefixes of that order, and if rare n-grams fill a prefix the class has no partner and leaves the join.
4. Candidates share a prefix n-gram and pass the length and position bounds. Their partial overlaps are counted
   fragment by fragment and summed per pair, which decides the pair exactly.
5. First each member of a posting list meets the list's smallest member, its hub, which joins a group of near copies by
   as many pairs as it has members. Lists whose members are then in one component are done.
6. Of the open lists, short ones form their pairs of different components. Long ones are gathered by their hub, so that
   a class goes to few groups; a group is cut into blocks, and a task takes two blocks, sums the partial overlaps of all
   their pairs fragment by fragment in memory and returns joined components, at most a row a member. Rows grow with the
   members times the blocks of a group, not with its pairs.

So every pair of classes that are still in different components is decided, and no link between components is left out.

Rows: null texts and texts without words have an empty set and link with nothing; a document without an id is measured
and never linked; rows that share an id are compared each by their own text; an empty table gives no rows. Texts are
read whole. Frequencies use 48 bits of the hash, which only orders n-grams; overlaps use all 64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_scratch, free_shuffles, lean, materialize, own_memory, slices

NGRAM, PERCENT = 4, 85
FRAGMENT_BYTES = 6 << 20
OVERLAP_FRAGMENTS = 8
FLUSH = 400_000
MEMO_WORDS = 150_000
#: Open posting lists of more members are decided block against block.
LONG_LIST = 48
#: Classes and n-grams of a block, and n-grams that a task compares at a time.
BLOCK_CLASSES, BLOCK_GRAMS, COLUMNS = 1024, 1 << 18, 2048
#: Ids of classes to compare are broadcast up to this many rows (8 bytes each), else joined by a shuffle.
BROADCAST_ROWS = 300_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EMPTY = 0
DOCS, SINGLES, SHARED = 0, 1, 2
_words: dict[bytes, int] = {}


# ---- sets -------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of the whole text if it has fewer words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MEMO_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    x = _mix(h[: len(h) - n + 1] + np.uint64(n))
    for j in range(1, n):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(x)


def class_of(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set; EMPTY for the empty set."""
    if not len(grams):
        return EMPTY
    h = xxhash.xxh3_64_intdigest(grams.tobytes())
    return (h - (1 << 64) if h >> 63 else h) or 1


# ---- packed rows ------------------------------------------------------------------------------------------------


def _pack(classes: np.ndarray, grams: np.ndarray, extra: np.ndarray | None = None) -> bytes:
    """Entries (class, 48-bit n-gram[, 32-bit count]) in the given order; a run of one class names it once."""
    cut = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    runs = np.diff(np.append(cut, len(classes))).astype("<u4")
    head = np.array([len(cut), len(classes)], "<i8")
    short = np.ascontiguousarray(grams.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([head.tobytes(), classes[cut].astype("<i8").tobytes(), runs.tobytes(), short.tobytes(), b"" if extra is None else extra.astype("<u4").tobytes()])


def _unpack(data: bytes, with_extra: bool) -> tuple[np.ndarray, ...]:
    m, k = np.frombuffer(data, "<i8", 2).tolist()
    at = 16
    classes = np.frombuffer(data, "<i8", m, at)
    runs = np.frombuffer(data, "<u4", m, at + 8 * m)
    at += 12 * m
    wide = np.zeros((k, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * k, at).reshape(-1, 6)
    out = (np.repeat(classes, runs), wide.view("<u8").ravel())
    return (*out, np.frombuffer(data, "<u4", k, at + 6 * k)) if with_extra else out


DOC_ROW = np.dtype([("doc", "<i8"), ("cls", "<i8"), ("n", "<i4")])
SINGLE_ROW = np.dtype([("cls", "<i8"), ("n", "<i4")])


def _rows(kind: int, keys: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([kind] * len(keys), pa.int32()), pa.array(payloads, pa.binary())], names=["part", "kind", "payload"])


PACKED = "part int, kind int, payload binary"


def _cut(part: np.ndarray):
    """(part, positions) for each part, keeping order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
    for a, b in zip(at, [*at[1:], len(part)], strict=True):
        yield int(part[order[a]]), order[a:b]


# ---- the join ---------------------------------------------------------------------------------------------------


def need(n, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with any partner."""
    return (percent * n + 99) // 100


def postings(docs: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """Rows of two kinds: ``DOCS`` (a: doc id, b: class, n: set size) and ``SHARED`` (a: n-gram, b: class, n, rank)
    for the prefix n-grams that more than one class holds."""

    def sets(batches):
        seen: set[int] = set()
        rows: list[tuple] = []
        held, names, size = [], [], 0

        def flush():
            # Documents need no meeting: they are dealt evenly, whatever copies they have.
            table = np.array(rows, DOC_ROW)
            for at in range(0, len(table), 4096):
                yield _rows(DOCS, [fragments + xxhash.xxh32_intdigest(table[at : at + 1].tobytes()) % fragments], [table[at : at + 4096].tobytes()])
            if held:
                grams = np.concatenate(held) >> np.uint64(16)
                owner = np.repeat(np.array(names, np.int64), [len(x) for x in held])
                frag = ((grams >> np.uint64(16)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                keys, payloads = zip(*((f, _pack(owner[at], grams[at])) for f, at in _cut(frag)), strict=True)
                yield _rows(SHARED, list(keys), list(payloads))

        own_memory("ngrams", _words.clear)
        for part in (p for batch in batches for p in slices(batch)):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                grams = shingle_set(text, n)
                cls = class_of(grams)
                rows.append((doc, cls, len(grams)))
                if cls != EMPTY and cls not in seen:
                    seen.add(cls)
                    held.append(grams)
                    names.append(cls)
                    size += len(grams)
                if size > FLUSH or len(rows) > 200_000:
                    yield from flush()
                    rows, held, names, size = [], [], [], 0
        if rows:
            yield from flush()

    @lean
    def fragment(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == DOCS:
            part = t.column("part")[0].as_py() - fragments
            return pa.Table.from_batches([_rows(DOCS, [part] * t.num_rows, t.column("payload").to_pylist())])
        parts = [_unpack(x.as_buffer(), False) for x in t.column("payload")]
        cls, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(gram)
        cls, gram = cls[order], gram[order]
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        alone = first & np.append(first[1:], True)
        single = cls[alone]
        cls, gram = cls[~alone], gram[~alone]
        order = np.lexsort((cls, gram))
        cls, gram = cls[order], gram[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])]) if len(cls) else np.zeros(0, bool)
        cls, gram = cls[new], gram[new]
        _, back, df = np.unique(gram, return_inverse=True, return_counts=True)
        df = df[back]
        single = np.concatenate([single, cls[df == 1]])
        cls, gram, df = cls[df > 1], gram[df > 1], df[df > 1]
        out = []
        names, counts = np.unique(single, return_counts=True)
        table = np.zeros(len(names), SINGLE_ROW)
        table["cls"], table["n"] = names, counts
        for b, at in _cut((names.view("<u8") % np.uint64(fragments)).astype(np.int64)):
            out.append(_rows(SINGLES, [b], [table[at].tobytes()]))
        order = np.argsort(cls, kind="stable")
        cls, gram, df = cls[order], gram[order], df[order]
        for b, at in _cut((cls.view("<u8") % np.uint64(fragments)).astype(np.int64)):
            out.append(_rows(SHARED, [b], [_pack(cls[at], gram[at], df[at])]))
        return pa.Table.from_batches(out or [_rows(SINGLES, [], [])])

    @lean
    def gather(t: pa.Table) -> pa.Table:
        kinds, payloads = t.column("kind").to_pylist(), t.column("payload")
        docs_in = np.concatenate([np.zeros(0, DOC_ROW), *[np.frombuffer(p.as_buffer(), DOC_ROW) for k, p in zip(kinds, payloads, strict=True) if k == DOCS]])
        singles = np.concatenate([np.zeros(0, SINGLE_ROW), *[np.frombuffer(p.as_buffer(), SINGLE_ROW) for k, p in zip(kinds, payloads, strict=True) if k == SINGLES]])
        parts = [_unpack(p.as_buffer(), True) for k, p in zip(kinds, payloads, strict=True) if k == SHARED]
        cols = [[DOCS] * len(docs_in), docs_in["doc"], docs_in["cls"], docs_in["n"], np.zeros(len(docs_in), np.int32)]
        if parts:
            cls, gram, df = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((gram, df, cls))
            cls, gram = cls[order], gram[order]
            names, start, count = np.unique(cls, return_index=True, return_counts=True)
            own, where = np.unique(singles["cls"], return_inverse=True)
            alone = np.bincount(where, singles["n"], len(own)).astype(np.int64)
            at = np.minimum(np.searchsorted(own, names), max(len(own) - 1, 0))
            rare = np.where(own[at] == names, alone[at], 0) if len(own) else np.zeros(len(names), np.int64)
            size = rare + count
            prefix = size - need(size, percent) + 1
            rank = np.repeat(rare - start, count) + np.arange(len(cls))
            keep = rank < np.repeat(prefix, count)
            cols = [np.concatenate([a, b]) for a, b in zip(cols, ([SHARED] * int(keep.sum()), gram[keep].astype(np.int64), cls[keep], np.repeat(size, count)[keep], rank[keep]), strict=True)]
        kinds_out = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([pa.array(np.asarray(c), k) for c, k in zip(cols, kinds_out, strict=True)], names=["kind", "a", "b", "n", "rank"])

    packed = docs.mapInArrow(sets, PACKED)
    counted = packed.groupBy("part").applyInArrow(fragment, PACKED)
    return counted.groupBy("part").applyInArrow(gather, "kind int, a long, b long, n int, rank int")


def class_sets(docs: DataFrame, n: int) -> DataFrame:
    """``cls, frag, grams``: the sets of ``docs``, cut into overlap fragments."""

    def cut(batches):
        own_memory("ngrams", _words.clear)
        for batch in batches:
            for rows in slices(batch):
                cls, frag, grams = [], [], []
                for text in rows.column(0).to_pylist():
                    x = shingle_set(text, n)
                    bounds = np.searchsorted(x, np.arange(OVERLAP_FRAGMENTS + 1, dtype=np.uint64)[:-1] << np.uint64(64 - int(math.log2(OVERLAP_FRAGMENTS))))
                    name, x = class_of(x), x.view(np.int64)
                    for f, part in enumerate(np.split(x, bounds[1:])):
                        cls.append(name)
                        frag.append(f)
                        grams.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(frag, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["cls", "frag", "grams"])

    return docs.select("text").mapInArrow(cut, "cls long, frag int, grams array<bigint>").dropDuplicates(["cls", "frag"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold: partial overlaps of each fragment, summed per pair."""
    left = sets.select(F.col("cls").alias("a"), "frag", F.col("grams").alias("ga"))
    right = sets.select(F.col("cls").alias("b"), "frag", F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, ["b", "frag"])
    overlap = both.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("o"))
    return overlap.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _bounded(percent: int):
    """Length and position bounds of a pair (na, ra), (nb, rb) that shares an n-gram at these ranks."""
    na, nb = F.col("na"), F.col("nb")
    room = F.least(na - F.col("ra"), nb - F.col("rb"))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * room >= percent * (na + nb))


def _named(lists: DataFrame, joined: DataFrame) -> DataFrame:
    """``lists`` with each class's component so far."""
    return lists.join(joined, F.col("cls") == F.col("node"), "left").select("gram", "cls", "n", "rank", F.coalesce("comp", "cls").alias("comp"))


def _bridged(joined: DataFrame, bridges: DataFrame) -> DataFrame:
    """``joined`` after the links ``bridges(a, b)`` between its components."""
    over = components(bridges).select(F.col("node").alias("c_node"), F.col("comp").alias("c_comp"))
    both = joined.join(over, F.col("comp") == F.col("c_node"), "full")
    return materialize(both.select(F.coalesce("node", "c_node").alias("node"), F.coalesce("c_comp", "comp").alias("comp")), "joined")


def block_links(rows: list[list[np.ndarray]], sizes: list[np.ndarray], comps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of two blocks link: partial overlaps of each fragment, summed per pair.

    ``rows[side][fragment]`` is (n-grams, member of each); pairs of one component or of sizes too different stay False.
    """
    n, m = sizes[0].astype(np.int64)[:, None], sizes[1].astype(np.int64)[None]
    open_ = (comps[0][:, None] != comps[1][None]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    overlap = np.zeros(open_.shape, np.float32)
    left = [np.array(x, np.float32) for x in sizes]
    for (g, i), (h, j) in zip(*rows, strict=True):
        if not open_.any():
            break
        shared = np.intersect1d(g, h)
        for at in range(0, len(shared), COLUMNS):
            part = shared[at : at + COLUMNS]
            marks = []
            for grams, owner, k in ((g, i, len(n)), (h, j, m.shape[1])):
                place = np.minimum(np.searchsorted(part, grams), len(part) - 1)
                hit = part[place] == grams
                mark = np.zeros((k, len(part)), np.float32)
                mark[owner[hit], place[hit]] = 1
                marks.append(mark)
            overlap += marks[0] @ marks[1].T
        for side, owner in enumerate((i, j)):
            left[side] -= np.bincount(owner, minlength=len(left[side]))
        # What the fragments to come can add at most.
        most = overlap + np.minimum(left[0][:, None], left[1][None])
        open_ &= (100 + percent) * most.astype(np.int64) >= percent * (n + m)
    return open_


def hub_groups(crowded: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: components of ``crowded(gram, cls, n, comp)`` that links between members of a list join.

    Lists of one hub form a group: the hub holds their n-grams in its own prefix, so they are few and much alike.
    """
    members = crowded.join(hubs.select("gram", F.col("a").alias("hub")), "gram").select("hub", "cls", "n", "comp").distinct()
    sizes = members.groupBy("hub", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    sizes = sizes.groupBy("hub").agg(F.sum("m").alias("all"), F.sum("grams").alias("grams"), F.max(F.struct("m", "comp")).alias("most")).where("most.m < all")
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK_CLASSES), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    whole = sets.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("frag", "grams"))), lambda x: x["grams"]).alias("frags"))
    dealt = members.join(sizes.select("hub", F.col("most.comp").alias("main"), blocks.alias("blocks")), "hub").join(whole, "cls")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # Of two classes in different components one lies outside the group's largest, so those meet all blocks.
    outside = dealt.where("comp <> main").select("hub", F.col("own").alias("i"), other.alias("j"), F.lit(0).alias("side"), "cls", "n", "comp", "frags")
    inside = dealt.select("hub", other.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "cls", "n", "comp", "frags")

    @lean
    def decide(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t.column("side").to_numpy()
        rows, sizes, comps = [], [], []
        for k in (0, 1):
            own = t.take(np.flatnonzero(side == k))
            sizes.append(own.column("n").to_numpy())
            comps.append(own.column("comp").to_numpy())
            frags = pc.list_flatten(own.column("frags")).combine_chunks()  # OVERLAP_FRAGMENTS lists a class
            length = pc.list_value_length(frags).to_numpy(zero_copy_only=False)
            grams, place = frags.flatten().to_numpy(), np.repeat(np.arange(len(length)), length)
            rows.append([(grams[at], place[at] // OVERLAP_FRAGMENTS) for at in (np.flatnonzero(place % OVERLAP_FRAGMENTS == q) for q in range(OVERLAP_FRAGMENTS))])
        ends: tuple = ([], [])
        if len(sizes[0]) and len(sizes[1]):
            linked = block_links(rows, sizes, comps, percent)
            # Each member's smallest component within reach, which joins what the links join.
            low, far = [np.array(c) for c in comps], np.int64(np.iinfo(np.int64).max)
            while linked.any():
                right = np.minimum(low[1], np.where(linked, low[0][:, None], far).min(0))
                back = np.minimum(low[0], np.where(linked, right[None], far).min(1))
                if (right == low[1]).all() and (back == low[0]).all():
                    break
                low = [back, right]
            ends = (np.concatenate(comps), np.concatenate(low))
            change = ends[0] != ends[1]
            ends = tuple(x[change] for x in ends)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    return materialize(outside.unionByName(inside).groupBy("hub", "i", "j").applyInArrow(decide, "a long, b long"), "crowded")


def link_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # A source that does not know its size says 2 ** 63; such a table is cut by the session's partitions.
    fragments = max(8, -(-size // FRAGMENT_BYTES)) if size < 1 << 60 else 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = text.where("doc_id is not null")
    found = materialize(postings(known, n, percent, fragments), "postings")
    free_shuffles(spark)
    own = found.where(F.col("kind") == DOCS).select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("n").alias("n_shingles"))
    lists = found.where(F.col("kind") == SHARED).select(F.col("a").alias("gram"), F.col("b").alias("cls"), "n", "rank")
    hubs = lists.groupBy("gram").agg(F.min(F.struct("cls", "n", "rank")).alias("hub"), F.count("*").alias("m")).where("m > 1").select("gram", F.col("hub.cls").alias("a"), F.col("hub.n").alias("na"), F.col("hub.rank").alias("ra"))
    star = lists.select("gram", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb")).join(hubs, "gram").where("a <> b")
    star = materialize(star.where(_bounded(percent)).select("a", "b", "na", "nb").distinct(), "star")
    live = lists.join(hubs.select("gram"), "gram", "left_semi")
    chosen = live.select("cls").distinct()
    reps = materialize(own.join(chosen, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("rep")).select("rep").distinct(), "reps")
    side = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
    sets = materialize(class_sets(known.join(side, F.col("doc_id") == F.col("rep"), "left_semi"), n), "sets")
    joined = materialize(components(materialize(verified(star, sets, percent), "links")), "joined")
    free_shuffles(spark)
    named = _named(live, joined)
    open_lists = named.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("gram", "m")
    rest = materialize(named.join(open_lists, "gram"), "open")
    crowded = hub_groups(rest.where(F.col("m") > LONG_LIST), hubs, sets, percent)
    short = rest.where(F.col("m").between(3, LONG_LIST)).drop("m")  # of two members, one is the hub
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"])
    prefix = lists.join(short.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(order.alias("prefix"))
    short = materialize(short.join(prefix, "cls"), "short")
    a = short.select("gram", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("comp").alias("ca"), F.col("prefix").alias("pa"))
    b = short.select("gram", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("comp").alias("cb"), F.col("prefix").alias("pb"))
    # Common n-grams lie in both prefixes, or behind the prefix that ends first in the order.
    behind = F.greatest(*[F.floor((percent * F.col(c) + 99) / 100) - 1 for c in ("na", "nb")])
    enough = (100 + percent) * (F.size(F.array_intersect("pa", "pb")) + behind) >= percent * (F.col("na") + F.col("nb"))
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = a.join(b, "gram").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _bounded(percent) & enough).select("a", "b", "na", "nb", "ca", "cb").distinct()
    apart = materialize(apart.join(tried, ["a", "b"], "left_anti"), "apart")
    found_links = verified(apart.select("a", "b", "na", "nb"), sets, percent)
    bridges = found_links.join(apart.select("a", "b", "ca", "cb"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    final = _bridged(joined, bridges.unionByName(crowded).distinct())
    for used in (rest, short, apart, sets):
        drop_scratch(used)

    placed = own.join(final, F.col("cls") == F.col("node"), "left").select("doc_id", "cls", "n_shingles", F.coalesce("comp", "cls").alias("comp"))
    lowest = placed.where(F.col("cls") != EMPTY).groupBy("comp").agg(F.min("doc_id").alias("low"), F.count("*").alias("m")).where("m > 1").select(F.col("comp").alias("l_comp"), "low")
    out = placed.join(lowest, F.col("comp") == F.col("l_comp"), "left").select("doc_id", F.col("n_shingles").cast("long"), F.coalesce("low", "doc_id").alias("component_id"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(shingle_set(t, n)) for t in batch.column(1).to_pylist()], pa.int64()), batch.column(0)], names=["doc_id", "n_shingles", "component_id"])

    return out.unionByName(text.where("doc_id is null").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long"))
