"""Tokenizing whole texts word by word with a cache of what each distinct word becomes.

A text is split as the tokenizer file says; each distinct word is encoded once and remembered. The ids equal those
of the ``tokenizers`` library on the whole text. Null texts are empty.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

def _usual() -> list[int]:
    """Code points that are split here: Latin, punctuation, currency and letterlike signs, as far as they stay among
    themselves when composed and lower-cased. Texts with others are split by the library, since Unicode tables differ.
    """
    blocks = ((0, 0x1C), (0x20, 0x250), (0x1E00, 0x1F00), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0), (0x2100, 0x2150))
    among = {c for a, b in blocks for c in range(a, b)}
    return sorted(c for c in among if {ord(x) for x in unicodedata.normalize("NFC", chr(c)).lower()} <= among)


def _class(points: list[int]) -> str:
    """The inside of a character class of these code points."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


_USUAL = _usual()
_UNUSUAL = re.compile(f"[^{_class(_USUAL)}]")
#: Distinct words of each of the two generations that one Python worker holds, about 40 MB. When the young one is full
#: it becomes the old one, whose words are forgotten unless they were met again meanwhile (results do not change).
CACHE_WORDS = 200_000


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordSplitter:
    """Splits texts into the words that a tokenizer file's BPE model sees, and into its special tokens.

    ``lower`` files (word ends, white space dropped) and byte-level files are told apart by their normalizer.
    """

    def __init__(self, path: str, special: bool = True):
        import json

        self.tok = load_tokenizer(path)
        spec = json.load(open(path))
        self.lower = spec["normalizer"] is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letter, digit = (_class([c for c in _USUAL if unicodedata.category(chr(c))[0] == kind]) for kind in "LN")
        # The split patterns of the two kinds of tokenizer file, letters first.
        if self.lower:
            pattern = rf"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digit}]|[^\s{letter}{digit}]+"
        else:
            pattern = rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digit}]+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+"
        self.find = re.compile(pattern).findall

    def words(self, text: str | None) -> list[str]:
        """The words of a text in order; special tokens stand as themselves."""
        if not text:
            return []
        if self.cut is not None and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.cut.split(text)):
                if k % 2:
                    out.append(part)
                elif part:
                    out += self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _UNUSUAL.search(text):
            if self.lower:
                text = self.tok.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        if self.lower:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
        return self.find(text)


class WordCache:
    """word -> what ``encode`` makes of it; unseen words are encoded together. Words that keep coming stay known."""

    def __init__(self, encode, most: int | None = None):
        self.encode, self.most = encode, most or CACHE_WORDS
        self.young: dict = {}
        self.old: dict = {}

    def learn(self, texts_words: list[list[str]]):
        """Encode what is new; returns the lookup."""
        words = set().union(*texts_words)
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > self.most:
            self.old, self.young, missing = self.young, {}, words
        unseen = []
        for w in missing:
            if (made := self.old.get(w)) is None:
                unseen.append(w)
            else:
                self.young[w] = made
        if unseen:
            self.young.update(zip(unseen, self.encode(unseen)))
        return self.young.__getitem__


def text_blocks(batch, column: str = "text", chars: int = 500_000):
    """(first row, texts) in runs of about ``chars`` characters, so that memory stays small however long texts are."""
    col = batch.column(batch.schema.get_field_index(column))
    at = 0
    texts: list[str] = []
    size = 0
    for k in range(len(col)):
        t = col[k].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= chars:
            yield at, texts
            at, texts, size = k + 1, [], 0
    if texts:
        yield at, texts


def _signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printing ones themselves, the others from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + n): b for n, b in enumerate(others)}


class WordPieces:
    """The ids of one word: byte-pair merging of its bytes by rank, for a tokenizer file's vocabulary and merges.

    Where the vocabulary marks word ends, the byte 0xFF, which no UTF-8 text holds, is put after the word; that it joins
    the byte before it comes first of all merges.
    """

    def __init__(self, spec: dict, dtype: np.dtype):
        import tiktoken

        model, signs = spec["model"], _signs()
        mark, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self.end = b"\xff" if mark else b""
        whole = lambda t: bytes(signs[c] for c in (t.removesuffix(mark) if mark else t)) + (self.end if mark and t.endswith(mark) else b"")
        ids = {bytes([b]): vocab.get(c) for c, b in signs.items()}
        if mark:
            ids |= {bytes([b]) + self.end: vocab.get(c + mark) for c, b in signs.items()}
        ranks = {t: n for n, t in enumerate(ids)}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            t = whole(a + b)
            ranks.setdefault(t, len(ranks))
            ids.setdefault(t, vocab[a + b])
        self.merge = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.id_bytes = [b"" if ids[t] is None else np.array(ids[t], dtype=dtype).tobytes() for t in ranks]

    def __call__(self, word: str) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.merge(word.encode() + self.end)))


class _Known(dict):
    """word -> ids, made when first asked for. ``turn`` ends a generation: words not met in the next one are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        self[word] = made
        return made

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class IdEncoder:
    """Texts -> id arrays as the ``tokenizers`` library gives them, each distinct word encoded once."""

    def __init__(self, path: str, special: bool = True):
        import json

        self.split = WordSplitter(path, special)
        self.dtype = np.dtype("<u2" if self.split.tok.get_vocab_size() <= 65536 else "<u4")
        self.pieces = WordPieces(json.load(open(path)), self.dtype)
        self.known = _Known(self._one)

    def _one(self, word: str) -> bytes:
        if (own := self.split.special.get(word)) is not None:
            return np.array(own, dtype=self.dtype).tobytes()
        return self.pieces(word)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``dtype``."""
        self.known.turn(CACHE_WORDS)
        get = self.known.__getitem__
        return [b"".join(map(get, self.split.words(t))) for t in texts]


_HELD: dict = {}


def held(kind, *args):
    """One encoder for a Python worker, kept between its tasks."""
    key = (kind.__name__, *args)
    if key not in _HELD:
        _HELD[key] = kind(*args)
    return _HELD[key]


def release() -> None:
    """Free the encoders of this worker."""
    _HELD.clear()
