"""Operator 1: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of three lexicons (a small fixed list of insults; words, and word beginnings,
learned from labelled rows by their log-odds), how near second-person words stand to hits, capitals, punctuation, and
obfuscation. A bounded sample of labelled rows is dealt by a hash into folds. The features that the trees learn from
use, for each fold, lexicons learned from the other folds, and the calibration sees margins of trees that were fitted
without the row's fold, so that no row judges what it has itself taught.

Defined results: a null text is empty; an empty text gets the score its features give; without labels of both classes
the score is the share of toxic labels (0 without any); repeated rows each give a row; an empty table gives no rows; a column
named ``score`` is replaced by ``score`` and kept where rows are only dropped, others pass through. A very long text is scored
whole by one task, which holds its words and a few numbers for each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import map_batches, small_side, written

#: Labelled rows, about, on which lexicons, trees and calibration are fitted (drawn by a hash of doc_id).
FIT_ROWS = 16_000
FOLDS = 5
#: Entries of the learned lexicons at most; candidates for them at most.
LEXICON, CANDIDATES = 4_000, 20_000
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6)

#: Common insults in four languages, and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers clown clowns scum trash garbage pathetic worthless disgusting "
    "filth filthy vermin imbecile cretin fool fools jerk bastard bitch asshole crap shit fuck fucking whore slut "
    "retard retarded ugly hate kill die dummkopf trottel arschloch dreck abschaum idiota imbecil estupido estúpido "
    "basura asqueroso idiote crétin connard salaud ordure débile".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton vous votre vos usted tú ti".split())
#: Signs that stand for letters in obfuscated words.
STANDS_FOR = str.maketrans("@4310$57", "aaeiosst", "*_-.")

_WORD = re.compile(r"\w+")
_ODD = re.compile(r"(?<!\S)[^\W\d_]+[@$*0134_57.-]+[^\W\d_]+|[^\W\d_]*[@$*][^\W\d_]+")
_LONG = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"([!?])[!?]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKS = re.compile(r"[^\w\s]")


@dataclass
class Lexicons:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        """The largest log-odds known of a word or its beginnings."""
        return max(self.words.get(word, 0.0), *(self.beginnings.get(word[:k], 0.0) for k in BEGINNINGS))


def features(text: str, lex: Lexicons) -> list[float]:
    """Dense features of a whole text."""
    words = _WORD.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    fixed = [k for k, w in enumerate(words) if w in INSULTS]
    get = lex.words.get
    learned = [w for w in words if w in lex.words]
    starts = []
    if lex.beginnings:
        known = lex.beginnings
        for w in words:
            for size in BEGINNINGS:
                if w[:size] in known:
                    starts.append(w[:size])
                    break
    hits = [k for k, w in enumerate(words) if w in INSULTS or w in lex.words or any(w[:size] in lex.beginnings for size in BEGINNINGS)]
    strong = sum(1 for k in hits if words[k] in INSULTS or lex.weight(words[k]) > 3.5)
    second = [k for k, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        gaps = [min(abs(h - second[min(a, len(second) - 1)]), abs(h - second[max(a - 1, 0)])) for h, a in zip(hits, at)]
        near = sum(g <= 5 for g in gaps)
    upper = len(_UPPER.findall(text))
    odd = [m.group().lower() for m in _ODD.finditer(text)] if "@" in text or "$" in text or "*" in text else []
    hidden = sum(m.translate(STANDS_FOR) in INSULTS for m in odd)
    marks = len(_MARKS.findall(text))
    distinct, distinct_starts = set(learned), set(starts)
    return [
        float(np.log1p(len(words))),
        100 * len(hits) / n,
        float(len(hits)),
        100 * strong / n,
        float(strong),
        100 * len(fixed) / n,
        float(len(fixed)),
        100 * len(learned) / n,
        float(len(learned)),
        float(len(distinct)),
        max(map(get, distinct), default=0.0),
        100 * len(starts) / n,
        float(len(starts)),
        float(len(distinct_starts)),
        max((lex.beginnings[s] for s in distinct_starts), default=0.0),
        near / max(len(hits), 1),
        100 * len(second) / n,
        upper / chars,
        100 * marks / chars,
        100 * len(_RUN.findall(text)) / n,
        100 * len(odd) / n,
        float(hidden),
        100 * len(_LONG.findall(text)) / n,
    ]


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    trees: boosting.Boosted
    calibration: boosting.Isotonic

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicons) for t in texts])
        return np.clip(self.calibration(self.trees.margin(x)), 0.0, 1.0)


def _terms(text: str) -> set[str]:
    """The distinct words of a text and, marked, their beginnings."""
    words = set(_WORD.findall(text.lower()))
    return words | {"^" + w[:k] for w in words for k in BEGINNINGS if len(w) >= k}


def _document_counts(rows: DataFrame, among: frozenset | None) -> DataFrame:
    """(fold, term, n): in how many texts of a fold each term (of ``among``) occurs, partial sums first."""

    def run(batches):
        import pyarrow as pa

        n: Counter = Counter()
        for batch in batches:
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _terms(text.as_py())
                n.update((fold, t) for t in (own if among is None else own & among))
        yield pa.RecordBatch.from_pydict({"fold": pa.array([f for f, _ in n], pa.int32()), "term": pa.array([t for _, t in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return map_batches(rows.select("fold", "text"), run, "fold int, term string, n long").groupBy("fold", "term").agg(F.sum("n").alias("n"))


def learn_lexicons(rows: DataFrame) -> list[Lexicons]:
    """From rows (text, toxic, fold): terms whose document odds are far higher among toxic texts.

    One pair of lexicons for each fold, learned without it, and at the end one learned from all.
    """
    size = {(r["toxic"], r["fold"]): r["n"] for r in rows.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (t, _), n in size.items() if t == kind) for kind in (0, 1)]
    if not all(total):
        return [Lexicons()] * (FOLDS + 1)
    found = written(_document_counts(rows.filter("toxic = 1"), None), "terms")
    often = found.groupBy("term").agg(F.sum("n").alias("all")).filter(F.col("all") >= max(3, total[1] // 400))
    often = often.orderBy(F.desc("all"), "term").limit(CANDIDATES).select("term")
    counts: list[dict[str, np.ndarray]] = [{}, {}]
    toxic = found.join(F.broadcast(often), "term").toArrow()
    clean = _document_counts(rows.filter("toxic = 0"), frozenset(toxic["term"].to_pylist())).toArrow()
    for kind, table in ((1, toxic), (0, clean)):
        for fold, term, n in zip(*(table[c].to_pylist() for c in ("fold", "term", "n"))):
            counts[kind].setdefault(term, np.zeros(FOLDS, dtype=np.int64))[fold] += n
    none = np.zeros(FOLDS, dtype=np.int64)
    out = []
    for fold in [*range(FOLDS), None]:
        left = [k for k in range(FOLDS) if k != fold]
        rows_of = [sum(size.get((kind, k), 0) for k in left) for kind in (0, 1)]
        odds, hits = {}, {}
        for t, by in counts[1].items():
            hits[t], n = int(by[left].sum()), int(counts[0].get(t, none)[left].sum())
            if hits[t] >= max(3, rows_of[1] // 400):
                odds[t] = float(np.log((hits[t] + 0.5) / (rows_of[1] + 1)) - np.log((n + 0.5) / (rows_of[0] + 1)))
        strong = sorted((t for t in odds if odds[t] > 2.0), key=lambda t: (-hits[t] * odds[t], t))[:LEXICON]
        out.append(Lexicons({t: odds[t] for t in strong if t[0] != "^"}, {t[1:]: odds[t] for t in strong if t[0] == "^"}))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) with the texts of ``docs``."""
    own = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = written(own, "labels")
    share = min(1.0, fit_rows / max(own.count(), 1))
    # 63 bits of a hash against the share, so that the sample keeps its size however many labels there are.
    drawn = own.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 1) < int(share * (1 << 63))) if share < 1 else own
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small_side(drawn), "doc_id")
    # Copies of a text would teach and judge at once: a text belongs to one fold, and counts once.
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = written(rows.select("text", "toxic", "fold"), "labelled")
    lexicons = learn_lexicons(rows)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t.as_py(), lexicons[k]) for t, k in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "fold"])

    table = map_batches(rows, run, "x array<double>, toxic int, fold int").toArrow()
    fold, y = table["fold"].to_numpy(), table["toxic"].to_numpy().astype(float)
    if not len(y):
        return ToxicityModel(lexicons[-1], boosting.Boosted(-30.0, []), boosting.isotonic(y, y))
    x = np.array(table["x"].to_pylist(), dtype=float)
    order = np.lexsort([*x.T, y])  # a fixed order, whatever the order of tasks
    fold, y, x = fold[order], y[order], x[order]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[fold == k] = boosting.fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return ToxicityModel(lexicons[-1], boosting.fit(x, y), boosting.isotonic(margin, y))


def score(docs: DataFrame, model: ToxicityModel, most: float | None = None) -> DataFrame:
    """``docs`` with ``score``; with ``most`` instead ``docs`` as it is, without rows that reach it."""
    keep = [f for f in docs.schema.fields if most is not None or f.name != "score"]
    names = [f.name for f in keep]
    schema = T.StructType(keep + [T.StructField("score", T.DoubleType())] * (most is None))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = model.score([t.as_py() or "" for t in batch.column(batch.schema.get_field_index("text"))])
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            if most is None:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(got, pa.float64())], names=[*names, "score"])
            else:
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(got < most))

    return map_batches(docs, run, schema)
