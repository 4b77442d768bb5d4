import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fluxmesh.llm import bpe
from fluxmesh.llm.common import scratch
from fluxmesh.llm.packing import best_fit, drain, pack
from fluxmesh.llm.token_files import SequenceFile, SequenceWriter, read_token_files, write_token_files
from fluxmesh.llm.wordtokens import tokenizer_path, word_encoder

from .helpers import HARD, empty_docs, hard_docs

TEXTS = [
    "", "a", " a", "  a  b ", "x\n y", "It's   \n\n ok\t\t ", "　  x", "<|endoftext|> a<|endoftext|>", "日本 語 text 123", "aaaa" * 300, "é" * 80 + " " * 40,
    "\x1c \x1d y", "x \n", "İ ſ'S Σας", "don't we'll they're 's", "word.,; 12,3. x.,", "x́ é", "a\x85b c", "tail ", "\n\nhead",
]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_words_encode_as_the_library_does():
    lib, enc = library("word_bpe_49k.json"), word_encoder("word_bpe_49k.json")
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode([None, *TEXTS])]
    assert got == [[], *[lib.encode(t, add_special_tokens=False).ids for t in TEXTS]]


def test_transducer_finds_exactly_its_words(tmp_path):
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["stop", "top", "tops", "stops", "s", "staying", "saying", "é", "éa"])}
    (tmp_path / "x").write_bytes(bpe.compile_lexicon(words))
    lex = bpe.Lexicon(str(tmp_path / "x"))
    asked = [*words, b"", b"to", b"stopp", b"z", "à".encode()]
    place = lex.find(asked)
    assert [np.frombuffer(lex.outputs(place[i : i + 1])[0], np.int32).tolist() for i in range(len(words))] == list(words.values())
    assert (place[len(words) :] == -1).all()
    assert len(lex.final) < sum(map(len, words))
    (tmp_path / "e").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "e")).find([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_bpe_ids_and_decoding_equal_the_library(tmp_path, with_lexicon):
    lib, enc = library("byte_bpe_50k.json"), bpe.TextEncoder("byte_bpe_50k.json")
    if with_lexicon:
        (tmp_path / "x").write_bytes(bpe.compile_lexicon({w.encode(): enc.merger.ids(w) for w in [" a", "It", " ok", "word"]}))
        enc.use(bpe.Lexicon(str(tmp_path / "x")))
    for t, ids in zip(TEXTS, enc.encode(TEXTS), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t
        assert enc.decode(ids.tolist()) == lib.decode(ids.tolist(), skip_special_tokens=False)
    assert enc.decode([161, 220]) == lib.decode([161, 220], skip_special_tokens=False)


def test_bpe_documents(spark):
    docs = hard_docs(spark)
    lib = library("byte_bpe_50k.json")
    out = bpe.encode_documents(docs, "byte_bpe_50k.json", bpe.build_lexicon(docs, "byte_bpe_50k.json", 500), with_ids=True).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(map(str, lib.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert all(len(r.ids) == r.n_tokens for r in out)
    none = empty_docs(spark)
    assert bpe.encode_documents(none, "byte_bpe_50k.json", bpe.build_lexicon(none, "byte_bpe_50k.json")).count() == 0


def test_token_files_round_trip(spark):
    docs = hard_docs(spark)
    enc = word_encoder("word_bpe_49k.json")
    files = write_token_files(docs, "word_bpe_49k.json", 2, seq_len=64, rows_per_batch=8)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, files).collect())
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = enc.encode([r.text])[0] + np.array([2], "<u4").tobytes()
        want.append((at, r.doc_id, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    f = SequenceFile(files[0]["path"])
    seq = f.tokens(1)
    assert not seq.flags.owndata and len(seq) == 64 and f.mask(0).true_count == 64
    assert read_token_files(spark, write_token_files(empty_docs(spark), "word_bpe_49k.json", 2)).count() == 0


def test_sequence_file_views(tmp_path):
    ids = np.arange(1000, dtype=np.uint16)
    with pa.OSFile(str(tmp_path / "f"), "wb") as sink:
        w = SequenceWriter(sink, 16, 4, np.uint16)
        for k in range(0, 1000, 37):
            w.add(ids[k : k + 37])
        w.close()
    f = SequenceFile(str(tmp_path / "f"))
    assert len(f) == 63 and f.tokens(5).tolist() == list(range(80, 96))
    assert f.mask(62).to_pylist() == [True] * 8 + [False] * 8
    assert f.span(60, 200).tolist() == list(range(60, 260))


def test_packing_covers_every_token_once(spark):
    docs = hard_docs(spark)
    rows = pack(docs, "word_bpe_49k.json", 1, capacity=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    enc = word_encoder("word_bpe_49k.json")
    want = []
    for r in docs.collect():
        ids = enc.encode([r.text])[0] + np.array([1], "<u4").tobytes()
        n = len(ids) // 4
        want += [(str(r.doc_id), p, 256 * p, min(256, n - 256 * p), zlib.crc32(ids[1024 * p : 1024 * (p + 1)])) for p in range(-(-n // 256))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert len(by) <= 1.01 * -(-sum(r.length for r in rows) // 256)
    assert pack(empty_docs(spark), "word_bpe_49k.json", 1).count() == 0


def test_search_empties_a_bin():
    lengths = [5, 5, 6, 3, 3, 2]
    bins = [[0], [2], [1, 3], [4, 5]]
    out = drain(bins, lengths, 12)
    assert len(out) == 2 and sorted(i for b in out for i in b) == list(range(6))
    assert all(sum(lengths[i] for i in b) <= 12 for b in out)
    assert len(best_fit([4, 4, 4, 2, 2], 8)) == 2


def test_search_ends_when_no_exchange_raises_the_squared_fill():
    rng = random.Random(3)
    for low, high, n in ((600, 1800, 900), (200, 1500, 600), (3, 90, 300)):
        lengths, capacity = [rng.randint(low, high) for _ in range(n)], 4096
        out = drain(best_fit(lengths, capacity), lengths, capacity)
        assert sorted(i for b in out for i in b) == list(range(n))
        sizes = [[lengths[i] for i in b] for b in out]
        assert all(sum(b) <= capacity for b in sizes)
        if len(out) == -(-sum(lengths) // capacity):
            continue
        work = [b for b in sizes if sum(b) < capacity]
        for src in work:
            for k in work:
                if k is not src:
                    room, ahead = capacity - sum(k), sum(src) - sum(k)
                    gains = {a - s for a in src for s in {0, *k, *(x + y for p, x in enumerate(k) for y in k[:p])}}
                    assert not any(max(0, ahead) < g <= room for g in gains)


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
    assert HARD
