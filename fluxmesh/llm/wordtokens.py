"""Exact encoding by a tokenizers file whose merges never cross white space, with a memo of words per worker.

The text normaliser of such files (NFC, white space to one blank, lower case) and their splitting pattern act on
each white-space word alone, so a text's ids are its words' ids one after another. Texts with characters for which
that is not certain (marks that compose, unusual blanks, letters whose lower case differs between libraries) or with
a special token's text are handed to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from .common import own_memory, slices

#: Characters for which a word's ids do not depend on its neighbours: ASCII without controls, and Latin letters.
UNSURE = re.compile("[^\x09-\x0d\x20-\x7e\xa1-įı-ſ]|<\\|")
MEMO_WORDS = 500_000
_encoders: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encoder(name: str) -> "WordEncoder":
    """The worker's encoder; it outlives a task when Spark reuses the worker."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class WordEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(name if os.path.isabs(name) else tokenizer_path(name))
        self.lib.no_truncation()
        self.lib.no_padding()
        self.memo: dict[str, bytes] = {}
        self.symbol = byte_symbols()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, word: str) -> bytes:
        """Ids of a lower-case word of letters only, which is one piece: no normaliser or splitter is needed."""
        piece = word if word.isascii() else "".join([self.symbol[b] for b in word.encode()])
        ids = [t.id for t in self.lib.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> None:
        memo = self.memo
        tails = [w for w in words if len(w) > 1 and w[-1] in ".," and w[-2].isalnum()]
        whole = set(words).difference(tails)
        whole.update(w[:-1] for w in tails)
        whole.update(".,")
        whole = [w for w in whole if w not in memo]
        model, bare = self._letters, []
        for w in whole:
            if w.isalpha() and len(w) < 200:
                memo[w] = model(w)
            else:
                bare.append(w)
        for at in range(0, len(bare), 20_000):
            part = bare[at : at + 20_000]
            memo.update(zip(part, self._ids(part), strict=True))
        for w in tails:
            memo[w] = memo[w[:-1]] + memo[w[-1]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; a null text is empty."""
        out: list[bytes] = [b""] * len(texts)
        lists: list[tuple[int, list[str]]] = []
        unsure: list[int] = []
        seen: set[str] = set()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for i, t in enumerate(texts):
            if not t:
                continue
            if UNSURE.search(t):
                unsure.append(i)
                continue
            words = t.lower().split()
            seen.update(words)
            lists.append((i, words))
        missing = [w for w in seen if w not in self.memo]
        if missing:
            self._learn(missing)
        get = self.memo.__getitem__
        for i, words in lists:
            out[i] = b"".join(map(get, words))
        for i in unsure:
            out[i] = self._ids([texts[i]])[0]
        return out


def encoded_batches(batch, name: str, texts_at_once: int = 500):
    """(doc ids, encoded texts) of an Arrow batch with doc_id and text, a few hundred rows at a time."""
    enc = word_encoder(name)
    own_memory("words " + name, enc.memo.clear)
    for part in slices(batch, texts_at_once):
        yield part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())
