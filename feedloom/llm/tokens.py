"""Token ids of whole texts through caches of the words that workers have already met.

A byte-level or word-level BPE tokenizer cuts a text into pre-tokens and encodes each one on its
own, so the ids of a pre-token are always the same.  The classes here cut texts of common Latin
characters at spaces, encode a chunk that is new with the BPE model of the ``tokenizers`` library
and remember its ids.  Any other text (other scripts, control characters, doubled spaces, special
strings) goes through the library's own pre-tokenizer or as a whole through its ``encode``, so ids
always are those of the library.

Caches hold a fixed number of entries: two generations, of which the older one is dropped.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

#: Characters for which Python's classes agree with the tokenizers' expressions, NFC changes
#: nothing and lower case is a character each.
PLAIN = re.compile("[\t-\r -~¡-§©«¬®-±´¶-¸»¿-ÖØ-öø-ÿ–—‘’“”…€]*")
CHUNKS = 300_000


def load(name: str):
    """A tokenizer of the ``tokenizers`` library by file name or path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


class Remembered:
    """Values by key, computed where missing; two generations of at most ``limit`` entries."""

    def __init__(self, compute, limit: int = CHUNKS):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def __getitem__(self, key):
        value = self.young.get(key)
        return self._missing(key) if value is None else value

    def _missing(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self.young) >= self.limit:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value

    def all(self, keys: list) -> list:
        """The value of each key."""
        values = list(map(self.young.get, keys))
        if None in values:
            values = [self[k] if v is None else v for k, v in zip(keys, values)]
        return values

    def clear(self) -> None:
        self.young, self.old = {}, {}


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others take the code points from 256 on, in order."""
    table, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            table[b] = chr(b)
        else:
            table[b] = chr(free)
            free += 1
    return table


class ByteLevelIds:
    """Ids of a byte-level BPE tokenizer as little-endian unsigned integers of ``width`` bytes."""

    WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.dtype = np.dtype(f"<u{array(self.code).itemsize}")
        self.stand_in = byte_alphabet()
        self.space = self.stand_in[32]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = Remembered(self._word)
        self.first = Remembered(self._chunk)
        self.spaced = Remembered(self._spaced)

    def _word(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable():
            word = word.encode().decode("latin-1").translate(self.stand_in)
        elif word[0] == " ":
            word = self.space + word[1:]
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word, self.WORDS.findall(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a chunk with the space before it."""
        if chunk.isalpha():
            return self._word(" " + chunk)
        word, *rest = self.WORDS.findall(" " + chunk)
        if rest and word[1:].isalpha():
            return self.spaced[word[1:]] + b"".join(self.words.all(rest))
        return self._chunk(" " + chunk)

    def ids(self, text: str) -> bytes:
        if "  " in text or not PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(self.spaced.all(rest))

    def clear(self) -> None:
        """Forget the words met; the tokenizer stays."""
        for held in (self.words, self.first, self.spaced):
            held.clear()


class WordCounts:
    """Number of tokens of a tokenizer that lower-cases, drops white space and encodes words.

    ``frequent`` is the first tier: lengths of frequent white-space-delimited chunks that every
    worker holds; the second tier is a cache of its own.
    """

    WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:_|[^\s\w])+")

    def __init__(self, name: str, frequent: dict[str, int] | None = None):
        self.tokenizer = load(name)
        self.model = self.tokenizer.model
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.stand_in = byte_alphabet()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mapped = Remembered(lambda word: len(self.model.tokenize(word)))
        self.chunks = Remembered(self._chunk)
        self.frequent = frequent or {}

    def _word(self, word: str) -> int:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.stand_in)
        return len(self.model.tokenize(word))

    def _chunk(self, chunk: str) -> int:
        known = self.frequent.get(chunk)
        if known is not None:
            return known
        if chunk.isalpha():
            return self._word(chunk)
        word, *rest = self.WORDS.findall(chunk)
        return (self.chunks[word] if word.isalpha() else self._word(word)) + sum(map(self._word, rest)) if rest else self._word(word)

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not PLAIN.fullmatch(text):
            return sum(self.mapped[word] for word, _ in self.cut(self.normalize(text)))
        return sum(self.chunks.all(text.lower().split()))


@cache
def byte_level(name: str) -> ByteLevelIds:
    """One per worker and tokenizer, so that the caches outlive a task."""
    return ByteLevelIds(name)
