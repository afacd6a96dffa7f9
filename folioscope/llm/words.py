"""Words of whole texts as integers: runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased.

Texts are handled as UTF-8 bytes: every byte of a sign beyond ASCII is 0x80 or more, so one table of 256 bytes lower-cases
A-Z and turns what parts words into spaces. Long texts are cut between words, so that memory stays bounded by the text
and its word numbers.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: What each byte becomes.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20


def pieces(text: bytes):
    """The translated text in parts that end between words."""
    text = text.translate(TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Dictionary:
    """Numbers for words, in order of first appearance."""

    def __init__(self):
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The numbers of a text's words."""
        get = self.number.__getitem__
        parts = [np.fromiter(map(get, p.split()), dtype=np.int64) for p in pieces(text or b"")]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def words(self) -> list[bytes]:
        return list(self.number)


def counted_words(texts) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, document, word, times, words of each document): one row for each word of each text, by word and document."""
    known = Dictionary()
    every = [known(t) for t in texts]
    length = np.array([len(x) for x in every], dtype=np.int64)
    if not length.sum():
        none = np.zeros(0, dtype=np.int64)
        return [], none, none, none, length
    n = len(every)
    key = np.concatenate(every) * n + np.repeat(np.arange(n), length)
    del every
    key.sort()
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[new, len(key)])
    key = key[new]
    return known.words(), key % n, key // n, times, length
