"""Byte-level BPE through a lexicon of frequent words, compiled into a minimal acyclic transducer.

The corpus' most frequent pieces (as the tokenizer splits text) are compiled into an automaton whose equal suffixes
are shared; every edge carries how many words sort before it, so the sum along a word's path is the word's place in
a table of id sequences. The file is flat and is memory-mapped by the workers, which look up a whole batch of pieces
at a time. A piece that is not in the lexicon is merged by the rules of the vocabulary, so ids never depend on it.

Rows: a null or empty text has no ids; equal rows and equal ids are encoded each; an empty table gives no rows; texts
are encoded whole; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, open_fs, scratch
from .wordtokens import byte_symbols, tokenizer_path

#: Pieces of the lexicon. It bounds what is collected to compile it; rarer pieces are merged, with the same ids.
LEXICON_WORDS = 1 << 18
#: Pieces seen less often are never frequent, however small the corpus.
LEAST_SEEN = 4
MEMO = 1_000_000
#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters whose classes all Unicode versions agree on; other texts are split by the library's own splitter.
RARE = re.compile("[^\x00-ɏ]")
BLANK_PAIR = re.compile(r"\s ")


# ---- the transducer ---------------------------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Flat bytes of the minimal transducer of ``entries``: words in byte order are added, finished suffixes shared."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    edges: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    path: list[list] = [[{}, False]]  # open states from the root: [label to state id, final]

    def close(down_to: int, last: bytes) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            out, end = path.pop()
            key = (end, *sorted(out.items()))
            if key not in register:
                register[key] = len(edges)
                edges.append(sorted(out.items()))
                final.append(end)
            path[-1][0][last[depth - 1]] = register[key]

    last = b""
    for w in words:
        common = len(os.path.commonprefix([last, w]))
        close(common, last)
        path += [[{}, False] for _ in w[common:]]
        path[-1][1] = True
        last = w
    close(0, last)
    root = len(edges)
    edges.append(sorted(path[0][0].items()))
    final.append(path[0][1])
    count = [0] * len(edges)  # words from each state; states come after those they lead to
    rows = []
    for s, out in enumerate(edges):
        n = int(final[s])
        for label, to in out:
            rows.append((s << 8 | label, to, n))
            n += count[to]
        count[s] = n
    table = np.array(rows or [(0, 0, 0)][:0], np.int64).reshape(-1, 3)
    ids = np.array([i for w in words for i in entries[w]], np.int32)
    ends = np.cumsum([0, *[len(entries[w]) for w in words]], dtype=np.int64)
    head = np.array([len(table), len(edges), len(words), len(ids), root], np.int64)
    parts = [head, table[:, 0], table[:, 1], table[:, 2], np.array(final, np.int64), ends, ids]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, mapped from a file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n_edges, n_states, n_words, n_ids, self.root = np.frombuffer(raw[:40], np.int64).tolist()
        at, out = 40, []
        for n, kind in ((n_edges, np.int64), (n_edges, np.int64), (n_edges, np.int64), (n_states, np.int64), (n_words + 1, np.int64), (n_ids, np.int32)):
            size = n * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind))
            at += size
        self.keys, self.to, self.skip, self.final, self.ends, self.ids = out

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1; all words advance one byte at a time together."""
        sizes = np.array([len(w) for w in words], np.int64)
        place = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not len(words):
            return place
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes)
        state, total, depth = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state << 8 | flat[starts[live] + depth]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[e] == key
            live, e = live[ok], e[ok]
            state, total = self.to[e], total[ok] + self.skip[e]
            depth += 1
            done = sizes[live] == depth
            place[live[done]] = np.where(self.final[state[done]] > 0, total[done], -1)
            live, state, total = live[~done], state[~done], total[~done]
        return place

    def outputs(self, places: np.ndarray) -> list[bytes]:
        """The ids of words at these places, as little-endian 32-bit numbers."""
        raw = memoryview(self.ids).cast("B")
        return [bytes(raw[a:b]) for a, b in zip((4 * self.ends[places]).tolist(), (4 * self.ends[places + 1]).tolist(), strict=True)]


# ---- merges -----------------------------------------------------------------------------------------------------


class Merger:
    """The vocabulary and its merges."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(name if os.path.isabs(name) else tokenizer_path(name))
        self.model = self.lib.model
        spec = json.load(open(name if os.path.isabs(name) else tokenizer_path(name), encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.symbol = byte_symbols()
        back = {s: b for b, s in enumerate(self.symbol)}
        size = 1 + max([*self.vocab.values(), *self.added.values()])
        self.raw: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.raw[i] = bytes([back[c] for c in token])
        for token, i in self.added.items():
            self.raw[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]

    def ids(self, piece: str) -> list[int]:
        """Short pieces are merged by the library's model, which takes a quarter of the time that Python takes; long
        ones (which its quadratic search would stall on) by a heap."""
        if len(piece) < 64:
            symbols = piece if piece.isascii() and piece.isalnum() else "".join([self.symbol[b] for b in piece.encode()])
            return [t.id for t in self.model.tokenize(symbols)]
        return [self.vocab[p] for p in self._many([self.symbol[b] for b in piece.encode()])]

    def _many(self, parts: list[str]) -> list[str]:
        """Lowest rank first and leftmost among equals: a heap of pairs over a linked list."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(parts) and (r := self.rank.get((parts[x], parts[after[x]]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [p for p in parts if p]


# ---- texts ------------------------------------------------------------------------------------------------------

_mergers: dict[str, "TextEncoder"] = {}
_lexicons: dict[str, Lexicon] = {}


def lexicon_at(uri: str) -> Lexicon:
    """The lexicon at ``uri``, mapped where it lies, or from the worker's own copy if the store is remote."""
    if uri not in _lexicons:
        fs, path = open_fs(uri)
        if fs.type_name != "local":
            with fs.open_input_stream(path) as src, tempfile.NamedTemporaryFile(suffix=".fst", delete=False) as copy:
                copy.write(src.read())
            path = copy.name
        _lexicons.clear()
        _lexicons[uri] = Lexicon(path)
    return _lexicons[uri]


class TextEncoder:
    """Splits texts into blocks at blanks, blocks into pieces, and pieces into ids, remembering the blocks."""

    def __init__(self, name: str):
        import regex

        self.merger = Merger(name)
        self.split = regex.compile(PATTERN).findall
        self.blocks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.lexicon: Lexicon | None = None
        self.lib = self.merger.lib.pre_tokenizer
        self.added = re.compile("(" + "|".join(map(re.escape, self.merger.added)) + ")") if self.merger.added else None

    def use(self, lexicon: Lexicon | None) -> None:
        if lexicon is not self.lexicon or len(self.blocks) > MEMO:
            self.blocks, self.pieces, self.lexicon = {}, {}, lexicon

    def blocks_of(self, text: str) -> list[str]:
        """Stretches that no piece crosses: at each blank after a non-blank, if no other blank stands before one."""
        if RARE.search(text):
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenize_str(text)]
        if BLANK_PAIR.search(text):
            return self.split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def pieces_of(self, block: str) -> list[str]:
        body = block[1:] if block[0] == " " else block
        if not RARE.search(body):
            if body.isalpha():
                return [block]
            if body[-1:] in (",", ".") and body[:-1].isalpha():
                return [block[:-1], body[-1]]
            return self.split(block)
        return [block[a:b] for _, (a, b) in self.lib.pre_tokenize_str(block)]

    def _learn(self, blocks: list[str]) -> None:
        cut = [self.pieces_of(b) for b in blocks]
        new = list({p for ps in cut for p in ps}.difference(self.pieces))
        if self.lexicon:
            place = self.lexicon.find([p.encode() for p in new])
            hit = (place >= 0).tolist()
            self.pieces.update(zip([p for p, ok in zip(new, hit, strict=True) if ok], self.lexicon.outputs(place[place >= 0]), strict=True))
            new = [p for p, ok in zip(new, hit, strict=True) if not ok]
        for p in new:
            ids = self.merger.ids(p)
            self.pieces[p] = struct.pack(f"<{len(ids)}i", *ids)
        get = self.pieces.__getitem__
        for b, ps in zip(blocks, cut, strict=True):
            self.blocks[b] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut: list[list[str]] = []
        for t in texts:
            if not t:
                cut.append([])
            elif self.added and self.added.search(t):
                cut.append([b for k, part in enumerate(self.added.split(t)) for b in ([part] if k % 2 else self.blocks_of(part) if part else [])])
            else:
                cut.append(self.blocks_of(t))
        for token, i in self.merger.added.items():
            self.blocks[token] = np.array([i], np.int32).tobytes()
        new = list(set().union(*cut).difference(self.blocks))
        if new:
            self._learn(new)
        get = self.blocks.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]

    def decode(self, ids) -> str:
        """The text of ``ids``, special tokens included."""
        raw = self.merger.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")


def text_encoder(name: str) -> TextEncoder:
    if name not in _mergers:
        _mergers[name] = TextEncoder(name)
    return _mergers[name]


def frequent_pieces(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """The most frequent pieces over all texts (``piece, n``), at most ``limit``: all that reach the least count class
    for which they are so few. A class is an eighth of a doubling, so choosing it takes a table of a few hundred rows.

    Each task counts its pieces before anything is shuffled, so a piece that fills the corpus is one row a task.
    """

    def count(batches):
        enc, seen = text_encoder(tokenizer), Counter()

        def out():
            rows = Counter()
            for block, n in seen.items():
                for p in enc.pieces_of(block):
                    rows[p] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"piece": pa.array(list(rows), pa.string()), "n": pa.array(list(rows.values()), pa.int64())})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(enc.blocks_of(t))
            if len(seen) > MEMO:
                yield out()
        yield out()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "piece string, n long")
    often = materialize(counted.groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN).withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "pieces")
    taken, least = 0, 1 << 30
    for level, n in sorted(((r["level"], r["count"]) for r in often.groupBy("level").count().collect()), reverse=True):
        if taken + n > limit:
            break
        taken, least = taken + n, level
    return often.where(F.col("level") >= least).select("piece", "n")


def build_lexicon(docs: DataFrame, tokenizer: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the corpus' ``limit`` most frequent pieces and write the transducer to the shared folder."""
    merger = Merger(tokenizer)
    words = [r.piece for r in frequent_pieces(docs, tokenizer, limit).collect()]
    uri = f"{scratch(docs.sparkSession, 'lexicon')}/{uuid.uuid4().hex}.fst"
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(compile_lexicon({w.encode(): merger.ids(w) for w in words}))
    return uri


def encode_documents(docs: DataFrame, tokenizer: str, lexicon: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): each text encoded, and its ids decoded."""

    def run(batches):
        enc = text_encoder(tokenizer)
        decimal = enc.merger.decimal
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                enc.use(lexicon_at(lexicon))
                ids = [x.tolist() for x in enc.encode(part.column(1).to_pylist())]
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(",".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids],
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
