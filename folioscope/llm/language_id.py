"""Operator 7: language identification as a mixture of languages fitted to each document.

Every language is a distribution over hashed letter trigrams (letters lower-cased, everything else one space). A
document's trigrams are taken as drawn from a mixture; expectation-maximisation estimates the proportions, and a
penalised likelihood (half the logarithm of the number of trigrams for each further language, scaled for the overlap
of trigrams) selects the set of languages. The language with the largest proportion is predicted; the score is that
proportion times the posterior of the language against each other one alone.

The trigram counts come from a sample of labelled rows, bounded at about ``fit_rows`` rows a language.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything where no labelled
row could be learned from; null or empty labels are not learned from; repeated rows each give a row; an empty table gives no
rows; columns named as the results are replaced, others pass through. A very long text is read whole by one task, which holds
its trigrams as numbers, some twenty times its size for a while.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

#: Labelled rows a language from which its trigrams are counted (about; they are drawn by a hash of doc_id).
FIT_ROWS = 4_000
#: Languages that are learned, the commonest labels; a language takes 256 KB.
LANGUAGES = 256
BUCKETS = 1 << 15
#: How many independent draws a trigram is worth in the penalty: neighbours share two of three letters.
OVERLAP = 3.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case, or a space if it is no letter."""
    import unicodedata

    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            out[c] = ord(ch.lower()[0])
    return out


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of a text in order; none if it has no letter."""
    own = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    own = np.r_[np.uint32(32), own, np.uint32(32)]
    own = own[np.r_[True, (own[1:] != 32) | (own[:-1] != 32)]]
    if len(own) < 3:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = own[:-2] * np.uint32(0x9E3779B1) + own[1:-1] * np.uint32(0x85EBCA77) + own[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    return (h >> np.uint32(17)).astype(np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    logp: np.ndarray  # (languages, buckets)

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = trigrams(text or "")
        if not len(grams) or not self.langs:
            return "und", 0.0
        count = np.bincount(grams, minlength=BUCKETS)
        at = np.flatnonzero(count)
        c = count[at].astype(np.float64)
        logp = self.logp[:, at].astype(np.float64)
        alone = logp @ c
        best = int(alone.argmax())
        posterior = 1 / np.exp(np.clip((alone - alone[best]) / OVERLAP, -700, 0)).sum()
        p = np.exp(logp - logp.max(axis=0))
        share, _ = mixture(p, c)
        others = [k for k in np.argsort(-share).tolist() if share[k] > 0.02 and k != best]
        chosen, held = [best], np.array([1.0])
        reached = float(np.log(p[best]) @ c)
        for k in others:
            more, gain = mixture(p[[*chosen, k]], c)
            if (gain - reached) / OVERLAP <= np.log(c.sum()) / 2 + np.log(len(self.langs)):
                break
            chosen, held, reached = [*chosen, k], more, gain
        top = int(held.argmax())
        return self.langs[chosen[top]], float(held[top] * posterior)


def mixture(p: np.ndarray, c: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation and the log-likelihood they reach."""
    share = np.full(len(p), 1 / len(p))
    total = c.sum()
    for _ in range(steps):
        each = share[:, None] * p
        new = each @ (c / each.sum(axis=0)) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(np.log(share @ p) @ c)


def fit(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Count trigrams by language over labelled rows (lang, text) where ``learn`` holds."""
    own = docs.filter(learn & F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
    rows = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not rows:
        return LanguageModel([], np.zeros((0, BUCKETS), dtype=np.float32))
    # 63 bits of a hash against the share of each language's rows.
    most = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(int(fit_rows / n * (1 << 63)), (1 << 63) - 1))])
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1) <= F.try_element_at(most, F.col("lang"))

    def count(batches):
        import pyarrow as pa

        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                seen[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": n[at]})

    counted = map_batches(own.filter(drawn).select("lang", "text"), count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    langs = sorted(rows)
    counts = np.full((len(langs), BUCKETS), 0.02)
    place = {x: k for k, x in enumerate(langs)}
    np.add.at(counts, (np.array([place[x] for x in table["lang"].to_pylist()], dtype=np.int64), table["bucket"].to_numpy()), table["n"].to_numpy())
    return LanguageModel(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred and score to ``docs`` by its text alone; columns of these names are replaced."""
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = [model.predict(t.as_py()) for t in batch.column(at)]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return map_batches(docs, run, schema)
