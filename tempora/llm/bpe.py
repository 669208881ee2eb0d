"""Whole-text encoding with the tokenizers library, word by word through a bounded cache.

A byte-pair tokenizer first cuts a text into pre-tokens and merges within each of them only, so ids of a text are the ids of its
pieces in a row wherever a piece boundary is always a pre-token boundary. Texts repeat words; the cache asks the library for each
piece once. Pieces for which independence isn't certain, and texts with unusual white space, go to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

from tempora.llm.common import own_cache

#: Pieces that a cache holds at most, with its older half, and the longest piece that is kept: about 120 MB in a worker.
CACHE_ENTRIES, KEPT_CHARS = 700_000, 32

_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Pieces of letters, other ASCII signs but the apostrophe, and single line breaks: each run is a pre-token.
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++|[!-&(-/:-@\[-`{-~]{1,8}+(?![!-&(-/:-@\[-`{-~])|\n(?!\s)")
#: Letters of _LATIN, and signs that often stand behind a word.
_LETTER_SET, _SIGN_SET = frozenset(chr(c) for c in range(256) if _LATIN.match(chr(c))), frozenset(".,;:!?")
_PARTS = re.compile(rf"(?:{_PART.pattern})++")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as itself and the n-th other byte as the letter 256 + n."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(other)}


_LETTERS = _byte_letters()


def _spelled(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


class _Pieces(dict):
    """Piece to the bytes of its ids; looks up what is missing.

    A full cache becomes the older half, of which what is asked for again moves to the new one: words that texts repeat stay.
    """

    def __init__(self, owner: Encoder, space: str, fold: bool) -> None:
        super().__init__()
        self.owner, self.space, self.fold, self.lead = owner, space, fold, _LETTERS[32] if space else ""
        self.older: dict[str, bytes] = {}

    def clear(self) -> None:
        super().clear()
        self.older = {}

    def __missing__(self, piece: str) -> bytes:
        # a word with a sign behind it, and words with a line break between them, are so many that the cache has their parts only
        if len(piece) > 1 and piece[-1] in _SIGN_SET and piece[-2] in _LETTER_SET:
            return self[piece[:-1]] + self.owner.sign(piece[-1])
        if "\n" in piece:
            left, _, right = piece.partition("\n")
            if left and right and right[0] in _LETTER_SET and (left[-1] in _LETTER_SET or left[-1] in _SIGN_SET):
                return self[left] + self.owner.sign("\n") + self.owner.first[right]
        if len(self) >= CACHE_ENTRIES // 2:
            older = dict(self)
            self.clear()
            self.older = older
        if (found := self.older.get(piece)) is not None:
            pass
        elif piece.isascii() and piece.isalpha():
            found = self.owner.of_word(self.lead + (piece.lower() if self.fold else piece))
        elif _LATIN.fullmatch(piece):
            found = self.owner.of_word(self.lead + _spelled(piece.lower() if self.fold else piece))
        elif _PARTS.fullmatch(piece):
            found = b"".join([self._part(m[0], not m.start()) for m in _PART.finditer(piece)])
        else:
            found = self.owner.of_text(self.space + piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = found
        return found

    def _part(self, part: str, first: bool) -> bytes:
        """A run of letters, of signs, or a line break; the first one of a piece has the space before it."""
        own = self if first else self.owner.first
        if _LATIN.match(part):
            return own[part]
        return self.owner.sign((self.space if first else "") + part)


class Encoder:
    """encode(text) gives the ids of the whole text as little-endian unsigned integers of `dtype`, without special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: A tokenizer that normalizes here drops white space and letter case; the other keeps one space with the word after it.
        self.folds = self.tokenizer.normalizer is not None
        self.signs: dict[str, bytes] = {}
        self.first = _Pieces(self, "", self.folds)
        self.rest = self.first if self.folds else _Pieces(self, " ", False)
        own_cache("bpe", self.signs)
        own_cache("bpe", self.first)
        own_cache("bpe", self.rest)

    def sign(self, part: str) -> bytes:
        """A run of signs or a line break, by itself."""
        if (found := self.signs.get(part)) is None:
            if len(self.signs) >= CACHE_ENTRIES // 8:
                self.signs.clear()
            found = self.signs[part] = self.of_text(part)
        return found

    def of_text(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of_word(self, spelled: str) -> bytes:
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if self.folds:
            if _SEPARATORS.search(text):
                return self.of_text(text)
            return b"".join(map(self.rest.__getitem__, text.split()))
        if _ODD_SPACE.search(text):
            return self.of_text(text)
        pieces = text.split(" ")
        head = self.first[pieces[0]] if pieces[0] else b""
        return head + b"".join(map(self.rest.__getitem__, pieces[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, so that the cache lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
