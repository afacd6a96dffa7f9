"""Quality of answers: parts and totals, signs of made-up text, budgets, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import any_of, count_of, n_words, words

#: Terms that show what a question and its answer are about.
IMPORTANT = ("calculate", "formula", "reserve", "premium", "liability", "gaap", "ifrs")
#: What only a made-up answer would say without its sources, and signs of templates; of either dots span
#: lines in the first.
MADE_UP = (
    r"(?is)current ratio.*current assets.*current liabilities", r"(?is)debt to equity.*total debt.*total equity", r"(?is)return on equity.*net income.*shareholders equity",
    r"(?is)generally accepted accounting principles", r"(?is)international financial reporting standards",
)
TEMPLATES = (r"(?im)^(?:here are|the following are|these include)", r"(?im)1\.[ \t\n]+[^\n]*\n2\.[ \t\n]+[^\n]*\n3\.", r"(?im)in general|typically|usually|commonly")
#: Words of complex and of simple questions.
COMPLEX = ("how", "what", "why", "explain", "describe", "analyze", "compare", "detail", "breakdown", "difference", "relationship", "process")
SIMPLE = ("is", "are", "can", "does", "will", "define")
NUMBER = r"[0-9]+(?:\.[0-9]+)?%?"
#: Weights of the parts of the unified score, and the least and most that pass.
UNIFIED = {"semantic": 0.3, "grounding": 0.4, "risk": 0.2}
LEAST_SEMANTIC, LEAST_GROUNDING, MOST_RISK, LEAST_OVERALL = 0.25, 0.20, 0.7, 0.25
#: Keywords of the domains of questions, and words of source names that speak for one.
KNOWLEDGE = {
    "accounting": (("revenue", "recognition", "liability", "asset", "equity", "gaap", "ifrs", "fasb", "asc", "financial", "statement", "disclosure", "measurement"), ("gaap", "asc", "fasb")),
    "insurance": (("actuarial", "reserve", "premium", "policy", "claim", "underwriting", "reinsurance", "solvency", "capital", "licat", "regulatory"), ("licat", "actuarial")),
    "foreign_currency": (("foreign", "currency", "exchange", "rate", "translation", "remeasurement", "functional", "reporting", "monetary", "nonmonetary"), ("foreign", "currency", "pwc")),
}


def completeness(question: Column, answer: Column) -> Column:
    """One and a half times the share of a question's distinct words in the answer, 1 at most."""
    q = F.array_distinct(words(F.lower(question)))
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.lower(answer)))) / F.size(q)).otherwise(0.0)
    return F.least(share * 1.5, F.lit(1.0))


def accuracy(sources: Column, answer: Column) -> Column:
    """Twice the share of the sources' numbers that the answer keeps, 1 at most; 0.8 without numbers."""
    own = F.array_distinct(F.regexp_extract_all(sources, F.lit(NUMBER), F.lit(0)))
    kept = F.size(F.array_intersect(own, F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(0))))
    return F.when(F.size(own) > 0, F.least(kept / F.size(own) * 2, F.lit(1.0))).otherwise(0.8)


def formatting(answer: Column) -> Column:
    section = F.when(answer.rlike(r"(?m)^#{1,3}[ \t\n]+[A-Za-z0-9_]"), 0.4).otherwise(0.0)
    bullets = F.when(any_of(answer, ("•", "-")), 0.3).otherwise(0.0)
    return section + bullets + F.when(F.contains(answer, F.lit("\n\n")), 0.3).otherwise(0.0)


def relevance(question: Column, answer: Column) -> Column:
    q = count_of(F.lower(question), IMPORTANT)
    return F.when(q > 0, F.least(count_of(F.lower(answer), IMPORTANT) / q, F.lit(1.0))).otherwise(0.8)


def made_up(answer: Column, sources: Column) -> Column:
    """The share of eight signs: five phrases that the sources don't hold, and three forms of templates."""
    signs = sum(((answer.rlike(p) & ~sources.rlike(p)).cast("int") for p in MADE_UP), F.lit(0))
    signs = signs + sum((answer.rlike(p).cast("int") for p in TEMPLATES), F.lit(0))
    return signs / float(len(MADE_UP) + len(TEMPLATES))


def token_budget(question: Column, n_docs: Column) -> Column:
    """2000 to 4000 by length, words, kind of words and number of documents."""
    n, low = n_words(question), F.lower(question)
    hard, easy = count_of(low, COMPLEX), count_of(low, SIMPLE)
    points = F.when(F.length(question) > 100, 2).when(F.length(question) > 50, 1).otherwise(0) + F.when(n > 15, 2).when(n > 8, 1).otherwise(0)
    points = points + F.when(hard > easy, hard).when(easy > 0, -1).otherwise(0) + F.least(F.floor(n_docs / 3), F.lit(3))
    return F.when(points <= 0, 2000).when(points <= 2, 2500).when(points <= 4, 3000).when(points <= 6, 3500).otherwise(4000).cast("long")


def unified(parts: dict[str, list[Column]]) -> Column:
    """The weighted mean of the groups that have a value; risk counts as what is left of 1."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, cols in parts.items():
        n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
        mean = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / n
        value = 1 - mean if name == "risk" else mean
        total, weight = total + F.when(n > 0, value * UNIFIED[name]).otherwise(0.0), weight + F.when(n > 0, UNIFIED[name]).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def context(domain: Column, source: Column, content: Column) -> Column:
    """Half the share of a domain's keywords in the content, and 0.3 where the source's name speaks for the domain."""
    low, name, out = F.lower(content), F.lower(source), F.lit(0.0)
    for d, (keys, hints) in KNOWLEDGE.items():
        own = count_of(low, keys) / len(keys) * 0.5 + F.when(F.coalesce(any_of(name, hints), F.lit(False)), 0.3).otherwise(0.0)
        out = F.when(domain == d, F.least(own, F.lit(1.0))).otherwise(out)
    return out

#: Technical terms of documents and answers, and the weights of what both share.
SHARED_TERMS = ("reserve", "liability", "premium", "policy", "actuarial", "gaap", "ifrs", "asc", "fas", "ssap", "vnpr", "dac", "ual")
SHARED = {"phrase": 0.3, "term": 0.2, "number": 0.15, "header": 0.1, "word": 0.1, "sequence": 0.2}


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts in matching blocks, as ``difflib`` finds them; its time grows with the product of the lengths."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def document_usage(document: Column, response: Column, question: Column, head: int = 1000) -> Column:
    """How much of a document shows in a response: phrases, terms, numbers, headers, words of the question, likeness.

    Phrases are runs of three words or more between other signs, over 15 signs long; each time one occurs in the document
    counts. Likeness, over 0.1, is that of the first ``head`` signs; all else is taken over whole texts. Nulls are empty.
    """
    document, response, question = (F.coalesce(c, F.lit("")) for c in (document, response, question))
    d, r = F.lower(document), F.lower(response)

    def found(c: Column, pattern: str) -> Column:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def shared(a: Column, b: Column, pattern: str) -> Column:
        return F.size(F.array_intersect(found(a, pattern), found(b, pattern)))

    runs = F.transform(F.split(d, r"(?U)[^\p{L}\p{N}_\s]+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    phrases = F.size(F.filter(runs, lambda p: (F.length(p) > 15) & (F.size(F.split(p, r"(?U)\s+")) >= 3) & F.contains(r, p)))
    asked = F.filter(F.array_distinct(words(F.lower(question))), lambda w: F.length(w) > 3)
    relevant = F.least(F.size(F.filter(asked, lambda w: F.contains(d, w))), F.size(F.filter(asked, lambda w: F.contains(r, w))))
    alike = sequence_ratio(F.substring(d, 1, head), F.substring(r, 1, head))
    return (
        phrases * SHARED["phrase"]
        + shared(d, r, r"(?U)\b(?:" + "|".join(SHARED_TERMS) + r")\b") * SHARED["term"]
        + shared(d, r, r"(?U)\b\d+(?:\.\d+)?%?\b") * SHARED["number"]
        + shared(document, response, r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}:") * SHARED["header"]
        + relevant * SHARED["word"]
        + F.when(alike > 0.1, alike).otherwise(0.0) * SHARED["sequence"]
    )
