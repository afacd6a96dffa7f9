"""Rules and lexicons that tag questions, answers and documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, count_of, labels_where, n_words
from .questions import RULES

#: The compliance rules in order, each as one pattern, which may hit inside a word.
COMPLIANCE = {rule: "|".join(patterns) for rule, patterns in RULES.items()}
#: Kinds of question in order, with the words that show them.
KINDS = {
    "how_to": ("how to", "how do i", "steps", "process"),
    "definition": ("what is", "define", "definition", "meaning"),
    "calculation": ("calculate", "computation", "formula"),
    "compliance": ("compliance", "requirement", "regulation"),
    "example": ("example", "sample", "template"),
}
#: Topics in order.
TOPICS = {
    "US_GAAP": ("asc", "fasb", "gaap"),
    "IFRS": ("ifrs", "ias"),
    "revenue_recognition": ("revenue", "asc 606", "contract"),
    "leases": ("lease", "asc 842", "rental"),
    "financial_instruments": ("derivative", "investment", "fair value"),
    "insurance": ("insurance", "premium", "claim", "policyholder"),
    "reserves": ("reserve", "provision", "allowance"),
    "consolidation": ("consolidation", "subsidiary", "intercompany"),
    "cash_flow": ("cash flow", "statement of cash flows"),
    "depreciation": ("depreciation", "amortization", "asset"),
}
#: Domains in order, with patterns of which each that occurs counts one.
DOMAINS = {
    "accounting": (r"\b(?:asc|ifrs|gaap|fasb)\b", r"\b(?:revenue|liability|asset|equity)\b", r"\b(?:financial|accounting|reporting)\b", r"\b[0-9]+(?:-[0-9]+)+\b"),
    "insurance": (r"\b(?:licat|actuarial|reserve|premium)\b", r"\b(?:insurance|policy|claim|underwriting)\b", r"\b(?:regulatory|capital|solvency)\b"),
    "foreign_currency": (r"\b(?:foreign|currency|fx|exchange)\b", r"\b(?:translation|hedging|rate)\b"),
}
#: Frameworks with keywords, indicators and what either adds.
FRAMEWORKS = {
    "usstat": (("usstat", "us statutory", "statutory accounting", "naic", "sap", "ssap", "fis", "blanks"), ("reserve methodology", "statutory reserves", "commissioners standard", "valuation manual"), 0.1),
    "ifrs": (("ifrs", "international financial reporting", "iasb", "ias", "ifrs 17", "contractual service margin"), ("building block approach", "variable fee approach", "premium allocation approach"), 0.1),
    "gaap": (("gaap", "us gaap", "generally accepted accounting principles", "asc", "accounting standards codification"), ("long duration", "short duration", "targeted improvements", "ldti"), 0.1),
    "actuarial": (("actuarial", "mortality", "morbidity", "lapse", "surrender", "policyholder behavior"), ("actuarial assumptions", "experience studies", "credibility", "liability adequacy"), 0.15),
    "regulatory": (("regulatory", "capital", "solvency", "risk based capital", "rbc", "c-1", "c-2", "c-3", "c-4"), ("authorized control level", "company action level", "regulatory action level"), 0.1),
}
#: Advice in answers, words of duty, patterns of plain and signs of hard questions.
ADVICE = ("you should", "i recommend", "i advise", "my recommendation", "the best approach is")
DUTY = ("must", "required", "shall", "mandatory")
PLAIN = r"^what is [a-z ]+\?$|^define [a-z ]+$|^[a-z ]+ definition$|^explain [a-z ]+$"
HARD = (" vs ", " versus ", " compared to ", " compare ", " difference between ", " contrast ", " which is better ", " should i choose ")


def first_rule(c: Column, rules: dict[str, str]) -> Column:
    """The first rule whose pattern occurs, whatever its case; null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules.items()):
        out = F.when(c.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def kind_of_question(c: Column) -> Column:
    low, out = F.lower(c), F.lit("general")
    for name, parts in reversed(KINDS.items()):
        out = F.when(any_of(low, parts), name).otherwise(out)
    return out


def complexity(c: Column) -> Column:
    n = n_words(c)
    return F.when(n < 5, "simple").when(n < 15, "medium").otherwise("complex")


def topics(c: Column) -> Column:
    return topics_in(F.lower(c))


def topics_in(low: Column) -> Column:
    """The topics of a text in lower case."""
    return labels_where({name: any_of(low, parts) for name, parts in TOPICS.items()})


def best(scores: dict[str, Column], least: float) -> tuple[Column, Column]:
    """(name, score) of the largest score; the first of equals; null below ``least``."""
    ranked = F.array_max(F.array(*[F.struct(v.cast("double").alias("s"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, v) in enumerate(scores.items())]))
    return F.when(ranked["s"] >= least, ranked["n"]), ranked["s"]


def domain(c: Column) -> Column:
    low = F.lower(c)
    return best({n: sum((low.rlike(p).cast("int") for p in ps), F.lit(0)) for n, ps in DOMAINS.items()}, 1)[0]


def framework(c: Column, shortest: int = 100, least: float = 0.7) -> tuple[Column, Column]:
    """(framework, confidence): a tenth a keyword's word, 0.15 an indicator's word, a boost where any hit."""
    low = F.lower(c)
    scores = {}
    for name, (keywords, indicators, boost) in FRAMEWORKS.items():
        s = sum((F.contains(low, F.lit(k)).cast("int") * (0.1 * len(k.split())) for k in keywords), F.lit(0.0))
        s = s + sum((F.contains(low, F.lit(k)).cast("int") * (0.15 * len(k.split())) for k in indicators), F.lit(0.0))
        scores[name] = F.least(F.lit(1.0), F.when(s > 0, s + boost).otherwise(s))
    name, s = best(scores, least)
    long = F.length(c) >= shortest
    return F.when(long, F.coalesce(name, F.lit("general"))).otherwise("general"), F.when(long, s).otherwise(0.0)


def response_issues(c: Column) -> Column:
    """What an answer lacks or says too much of, in order."""
    low = F.lower(c)
    own = {f"advice_language: {a}": F.contains(low, F.lit(a)) for a in ADVICE}
    own["missing_citations"] = ~(F.contains(c, F.lit("[")) & F.contains(c, F.lit("]")))
    own["missing_disclaimer"] = any_of(low, DUTY) & ~F.contains(low, F.lit("professional judgment"))
    return labels_where(own)


def processing_tier(c: Column, known: Column) -> Column:
    """fast, cached or full; ``known``: whether the question's signature is cached."""
    low = F.trim(F.lower(c))
    n = n_words(c)
    return F.when(low.rlike(PLAIN) | (n <= 3), "fast").when(known, "cached").otherwise("full")


#: What shows that a question is a hard one.
HARD = (" vs ", " versus ", " compared to ", " compare ", " difference between ", " contrast ", " which is better ", " should i choose ")


def full_tier(c: Column, known: Column, alike: Column) -> Column:
    """``processing_tier`` in full: hard or long questions go the full way, others are cached if most of their words are."""
    low = F.lower(c)
    n = n_words(c)
    hard = any_of(low, HARD) | (n > 10)
    return F.when(F.trim(low).rlike(PLAIN) | (n <= 3), "fast").when(known, "cached").when(hard, "full").when(alike, "cached").otherwise("full")


def plain_words(c: Column) -> Column:
    """A question's words without punctuation, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_ \t\n]", ""), r"[ \t\n]+", " "))


def signature(c: Column) -> Column:
    """The start of the hash of ``plain_words``."""
    return F.substring(F.sha2(plain_words(c), 256), 1, 16)


def importance(c: Column) -> Column:
    """How much a message of a conversation matters: 1 and more by its signs, less if short, 2 at most."""
    low = F.lower(c)
    value = (
        F.lit(1.0)
        + F.when(F.contains(c, F.lit("?")), 0.3).otherwise(0.0)
        + F.when(any_of(low, ("calculate", "formula", "equation")), 0.4).otherwise(0.0)
        + F.when(c.rlike(r"[0-9]+(?:\.[0-9]+)?%"), 0.3).otherwise(0.0)
        + F.when(low.rlike(r"(^|[^a-z0-9_])(section|vm-|ldti|gaap)"), 0.2).otherwise(0.0)
    )
    return F.least(F.when(F.length(c) < 50, value * 0.8).otherwise(value), F.lit(2.0))


def share_of(c: Column, parts: dict[str, list[str]]) -> tuple[Column, Column]:
    """(name, share): the lexicon with most parts in a text, and its share of all hits; null without hits."""
    low = F.lower(c)
    counts = {n: count_of(low, p) for n, p in parts.items()}
    total = sum(counts.values(), F.lit(0))
    name, most = best(counts, 1)
    return name, F.when(total > 0, most / total).otherwise(0.0)
