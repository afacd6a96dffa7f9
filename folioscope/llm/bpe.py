"""Operator 3: BPE encoding and decoding by batched numpy merge rounds.

All symbols of many distinct words lie in one flat array. A round looks every adjacent pair up by binary search in
the sorted pair keys, takes the lowest rank of each word, merges all its places (leftmost first where they overlap)
and looks up only the pairs that changed. Words leave once no pair of theirs is known. Texts are split into words as
the tokenizer file says; each distinct word is encoded once per worker.

Defined results: null and empty texts have no ids, the hash of the empty string and an empty decoded text; special
tokens written in a text are encoded as such; repeated rows each give a row; an empty table gives no rows; a very long text is
a block of its own, whose words and ids one task holds; other columns pass through unless their name is one of the four
results.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches
from .tokens import CACHE_WORDS, WordCache, WordSplitter, held, text_blocks

_FAR = np.int64(1) << 40


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class NumpyBPE:
    """A BPE model read from a ``tokenizers`` file, as sorted pair keys with ranks and results."""

    def __init__(self, path: str):
        spec = json.load(open(path))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        sym = byte_symbols()
        self.first = np.array([vocab[sym[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[sym[b] + self.end] for b in range(256)], dtype=np.int64)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (non-empty)."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = self._merge(sym, word)
        cut = np.searchsorted(done_word, np.arange(len(words) + 1))
        return [done_sym[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the keys, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out_sym, out_word = [], []
        at = np.full(len(sym), -1, dtype=np.int64)  # the pair of each symbol and its right neighbour
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(sym) else np.zeros(0, dtype=np.int64)
        at[inner] = self._find(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(at >= 0, self.rank[at], _FAR)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            span = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(low < _FAR, span)
            if not live.all():
                out_sym.append(sym[~live])
                out_word.append(word[~live])
                sym, word, at, rank = sym[live], word[live], at[live], rank[live]
                if not len(sym):
                    break
                keep = low < _FAR
                low, span = low[keep], span[keep]
            hit = np.flatnonzero(rank == np.repeat(low, span))
            # In a run of overlapping places (the same symbol repeated) every second one merges.
            fresh = np.r_[True, (np.diff(hit) > 1) | (word[hit[1:]] != word[hit[:-1]])]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            new = np.cumsum(stay) - 1
            sym, word, at = sym[stay], word[stay], at[stay]
            moved = new[hit]
            mark = np.zeros(len(sym), dtype=bool)
            mark[moved] = True
            mark[np.maximum(moved - 1, 0)] = True
            touched = np.flatnonzero(mark)
            right = np.minimum(touched + 1, len(sym) - 1)
            known = (right > touched) & (word[right] == word[touched])
            at[touched] = -1
            go = touched[known]
            at[go] = self._find(sym[go], sym[go + 1])
        if not out_sym:
            return sym, word
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


class BPECodec:
    """Texts -> (ids, decoded text), both made from the ids of each distinct word."""

    def __init__(self, path: str):
        self.split = WordSplitter(path)
        self.model = NumpyBPE(path)
        self.cache = WordCache(self._encode, CACHE_WORDS // 2)

    def _encode(self, words: list[str]) -> list[tuple[str, int, str]]:
        special = self.split.special
        plain = [w for w in words if w not in special]
        ids = dict(zip(plain, self.model.encode_words(plain))) if plain else {}
        out = []
        for w in words:
            own = [special[w]] if w in special else ids[w].tolist()
            out.append((" ".join(map(str, own)), len(own), self.decode(own)))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, joined by spaces."""
        tokens = self.model.tokens
        return " ".join([tokens[i] for i in ids])

    def encode_decode(self, texts: list[str]):
        """For each text: ids as decimals joined by spaces, their number, and the decoded text."""
        words = [self.split.words(t) for t in texts]
        get = self.cache.learn(words)
        for own in words:
            got = [get(w) for w in own]
            yield " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """Add n_tokens, ids (array), decoded, and their SHA-256 digests to ``docs``.

    ``ids`` and ``decoded`` can be left out where only the digests are wanted. ``tokenizer``: the file's path on the
    executors.
    """
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    names = {f.name for f in made}
    keep = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(keep + made)

    def run(batches):
        import pyarrow as pa

        codec = held(BPECodec, tokenizer)
        for batch in batches:
            for at, texts in text_blocks(batch, text):
                out: dict[str, list] = {f.name: [] for f in made}
                for own, n, plain in codec.encode_decode(texts):
                    out["n_tokens"].append(n)
                    out["ids_sha256"].append(hashlib.sha256(own.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(plain.encode()).hexdigest())
                    if ids:
                        out["ids"].append(np.array(own.split(), dtype=np.int32) if own else np.zeros(0, dtype=np.int32))
                    if decoded:
                        out["decoded"].append(plain)
                cols = [batch.column(batch.schema.get_field_index(f.name)).slice(at, len(texts)) for f in keep]
                types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                cols += [pa.array(out[f.name], type=types.get(f.name, pa.string())) for f in made]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return map_batches(docs, run, schema, encoders=True)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id with the digest columns only."""
    out = encode(docs.select("doc_id", "text"), tokenizer, ids=False, decoded=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
