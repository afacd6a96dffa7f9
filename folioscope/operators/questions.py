"""What a question asks for: rules it breaks, phrases, intent, product, topic and route, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import EDGE, END
from ..functions.text import any_of, labels_where

#: The patterns of each compliance rule, in order, and what is answered instead.
RULES = {
    "tax_advice": (r"tax\s+advice", r"tax\s+planning", r"minimize\s+tax", r"tax\s+strategy", r"tax\s+optimization"),
    "legal_advice": (r"legal\s+advice", r"sue|lawsuit", r"legal\s+interpretation", r"litigation", r"legal\s+opinion"),
    "investment_advice": (r"investment\s+advice", r"buy|sell|trade", r"investment\s+recommendation", r"portfolio\s+advice"),
    "actuarial_certification": (r"actuarial\s+opinion", r"certify|certification", r"actuarial\s+statement"),
}
#: Answers in place of a blocked one; the wording is ours, the subject of each rule is named in it.
TEMPLATES = {
    "tax_advice": "Accounting treatment can be explained by the applicable standards, but this is no tax advice; please ask a tax professional.",
    "legal_advice": "Accounting standards can be explained, but this is no legal advice; please ask legal counsel.",
    "investment_advice": "Only accounting and actuarial guidance is given, no investment advice; please ask an investment advisor.",
    "actuarial_certification": "Actuarial concepts can be explained, but this is no actuarial opinion; please ask a qualified actuary.",
}
#: What calls for the notice on professional judgment.
JUDGMENT = (r"should\s+we", r"what\s+would\s+you\s+do", r"your\s+recommendation", r"best\s+practice", r"which\s+method\s+is\s+better")
NOTICE = "Professional Judgment Required: standards are applied to specific facts by qualified professionals."

#: Words that carry no meaning, and words that show what a question wants, in order.
STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "among", "this", "that", "these", "those", "i", "me", "my", "myself", "we", "us", "our", "you",
    "your", "he", "him", "his", "she", "her", "it", "its", "they", "them", "their", "be", "is", "am", "are", "was", "were", "being", "been", "have",
    "has", "had", "having", "will", "would", "should", "could", "can", "may", "might",
)
INTENTS = {
    "calculation": ("how", "calculate", "compute", "determine"),
    "definition": ("what", "define", "explain"),
    "comparison": ("difference", "compare", "versus", "vs"),
    "procedure": ("steps", "process", "procedure"),
}

#: Patterns of products, of questions and of documents (with the spelling that is matched there), and what a
#: whole-life hit may not be.
PRODUCTS = {
    "universal_life": (r"\buniversal\s+life\b", r"\bul\s+polic", r"\bul\s+insurance\b", r"\bflexible\s+premium\b", r"\bcash\s+value\s+life\b", r"\bsecondary\s+guarantee\b", r"\bno\s*lapse\s+guarantee\b", r"\bdeath\s+benefit\s+option\b", r"\baccount\s+value\b"),
    "whole_life": (r"\bwhole\s+life\s+polic", r"\bwhole\s+life\s+insurance\b", r"\btraditional\s+whole\s+life\b", r"\bordinary\s+life\b", r"\bpermanent\s+insurance\b", r"\bparticipating\s+whole\s+life\b"),
    "term_life": (r"\bterm\s+life\b", r"\bterm\s+insurance\b", r"\blevel\s+term\b", r"\bdecreasing\s+term\b", r"\brenewable\s+term\b", r"\bconvertible\s+term\b"),
    "variable_life": (r"\bvariable\s+life\b", r"\bvariable\s+universal\s+life\b", r"\bvul\s+polic", r"\bseparate\s+account\b"),
}
DOCUMENT_PRODUCTS = {
    "universal_life": (r"\buniversal\s+life\b", r"\bul\s+polic", r"\bcash\s+value\s+life\b", r"\bflexible\s+premium\b", r"\bdeath\s+benefit\s+option\b", r"\bsecondary\s+guarantee\b", r"\bno\s*lapse\s+guarantee\b"),
    "whole_life": (r"\bwhole\s+life\s+polic", r"\bwhole\s+life\s+insurance\b", r"\btraditional\s+whole\s+life\b", r"\bordinary\s+life\b", r"\bpermanent\s+insurance\b"),
    "term_life": (r"\bterm\s+life\b", r"\bterm\s+insurance\b", r"\blevel\s+term\b", r"\bdecreascing\s+term\b"),
}
NOT_WHOLE = r"\bwhole\s+contract\b"

#: General terms in order and what a question with one is widened by.
EXPANSIONS = {
    "capital health": "LICAT ratio core ratio total ratio capital adequacy",
    "company capital": "LICAT ratio core ratio total ratio regulatory capital",
    "assess capital": "LICAT ratio core ratio total ratio capital adequacy",
    "financial strength": "LICAT ratio core ratio total ratio capital adequacy",
    "capital adequacy": "LICAT ratio core ratio total ratio regulatory capital",
    "insurance": "LICAT OSFI regulatory capital solvency",
    "regulatory": "OSFI LICAT compliance capital requirements",
    "solvency": "LICAT ratio capital adequacy regulatory capital",
    "accounting": "GAAP IFRS standards disclosure requirements",
    "financial reporting": "GAAP IFRS disclosure standards",
    "compliance": "regulatory requirements OSFI GAAP IFRS",
    "risk": "management capital regulatory operational",
    "management": "risk capital regulatory",
}

#: Words of the seven fields that are answered at all.
FIELDS = {
    "financial": ("financial", "finance", "revenue", "profit", "loss", "earnings", "income", "expense", "assets", "liabilities", "equity", "balance sheet", "cash flow", "statement", "budget", "forecast", "valuation", "investment", "portfolio", "returns", "capital", "funding", "financing", "debt", "credit", "loan", "mortgage"),
    "accounting": ("accounting", "gaap", "ifrs", "asc", "fas", "ias", "standard", "compliance", "audit", "auditing", "journal", "ledger", "depreciation", "amortization", "accrual", "recognition", "measurement", "disclosure", "reporting", "consolidation", "segment", "fair value", "impairment", "tax"),
    "insurance": ("insurance", "insurer", "policy", "premium", "claim", "coverage", "underwriting", "reinsurance", "actuarial", "risk", "reserve", "liability", "benefit", "annuity", "life insurance", "health insurance", "property", "casualty", "solvency", "capital adequacy", "licat", "regulatory"),
    "banking": ("bank", "banking", "deposit", "withdrawal", "account", "lending", "borrowing", "interest rate", "mortgage", "loan", "credit", "debit", "payment", "financial institution", "federal reserve", "monetary policy", "currency"),
    "investment": ("investment", "investing", "stock", "bond", "security", "portfolio", "mutual fund", "etf", "dividend", "yield", "return", "risk", "volatility", "market", "trading", "hedge fund", "private equity", "venture capital"),
    "mathematical": ("calculation", "formula", "equation", "mathematical", "statistics", "probability", "model", "modeling", "quantitative", "analysis", "ratio", "percentage", "present value", "future value", "discount rate", "compound", "regression"),
    "economics": ("economic", "economics", "inflation", "deflation", "gdp", "recession", "growth", "unemployment", "monetary", "fiscal", "policy", "market", "supply", "demand", "price", "cost", "microeconomic", "macroeconomic"),
}
#: Signs that a question is about the documents, and forms of questions of general knowledge.
OF_DOCUMENTS = (r"\bour company\b", r"\bthe uploaded\b", r"\bthe document\b", r"\bin the document\b", r"\bshow me\b", r"\bfind\b[^\n]*\bin\b", r"\banalyze\b", r"\bpolicy\b", r"\bprocedure\b", r"\bin the[^\n]*image\b", r"\bfrom the[^\n]*image\b", r"\bthe[^\n]*chart\b", r"\buploaded[^\n]*image\b")
GENERAL = (r"^\s*what is\s+[a-z\s]+\??$", r"^\s*define\s+[a-z\s]+\??$", r"^\s*what\s+does\s+[a-z\s]+\s+mean\??$", r"^\s*what\s+are\s+the\s+types\s+of\s+[a-z\s?]+\??$", r"^\s*how\s+does\s+[a-z\s]+\s+work\??$")

#: Words that call for extraction, by kind, the weight of some, and forms that add to each kind.
EXTRACTION = {
    "job_titles": ("job title", "position", "role", "who is", "breakdown by", "list all", "employees with title", "staff members", "team members", "organizational", "people with"),
    "organizational": ("department", "division", "team", "structure", "hierarchy", "reports to", "organization", "org chart", "reporting"),
    "financial_roles": ("cfo", "treasurer", "financial", "accounting", "finance team", "controller", "analyst", "financial analyst", "accountant"),
    "approval_authority": ("approval", "authorization", "authority", "spending limit", "approval matrix", "who can approve", "signature authority"),
}
WEIGHT = {"job title": 0.3, "breakdown by": 0.3, "list all": 0.3, "cfo": 0.25, "treasurer": 0.25, "controller": 0.25, "who is": 0.2, "employees with": 0.2}
FORMS = (r"who are? the", r"list[^\n]*(?:employees|staff|people)", r"breakdown[^\n]*by[^\n]*(?:title|role|position)", r"what[^\n]*(?:titles|positions|roles)", r"how many[^\n]*(?:employees|staff)", r"who[^\n]*(?:cfo|treasurer|controller|analyst)")


def edged(pattern: str) -> str:
    r"""``pattern`` with its edges of words (``\b``) said so that both engines read them alike, for letters of any script."""
    return re.sub(r"\\b(?=[a-z])", lambda _: EDGE, pattern).replace(r"\b", END)


def matched(c: Column, patterns) -> Column:
    """The patterns that occur, whatever the case, in order."""
    return labels_where({p: c.rlike("(?i)" + p) for p in patterns})


def first_blocking(c: Column, rules: dict[str, tuple[str, ...]] = RULES) -> tuple[Column, Column]:
    """(name, matched patterns) of the first rule with a hit; null without one."""
    name, hits = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for rule, patterns in reversed(rules.items()):
        any_hit = c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        name, hits = F.when(any_hit, rule).otherwise(name), F.when(any_hit, matched(c, patterns)).otherwise(hits)
    return name, hits


def words_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def parsed(rows: DataFrame, query: str = "query") -> DataFrame:
    """``rows`` with ``keywords`` (distinct words of three letters and more that carry meaning, as they come), ``phrases``
    (quoted parts, and two- and three-word phrases whose outer words carry meaning; distinct, sorted) and ``named``.

    Words and what they carry are columns of their own first, so that each is worked out once.
    """
    w = rows.withColumn("_w", words_of(F.col(query)))
    stop = F.array(*map(F.lit, STOP))
    w = w.withColumn("_good", F.transform("_w", lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x)))

    def runs(n: int) -> Column:
        made = F.transform("_w", lambda x, k: F.when(F.get("_good", k) & F.coalesce(F.get("_good", k + n - 1), F.lit(False)), F.array_join(F.slice("_w", k + 1, F.lit(n)), " ")))
        return F.array_compact(made)

    quotes = F.regexp_extract_all(query, F.lit('"([^"]*)"'), F.lit(1))
    words = F.array_compact(F.zip_with("_w", "_good", lambda x, g: F.when(g, x)))
    out = w.withColumns({"keywords": F.array_distinct(words), "phrases": F.array_sort(F.array_distinct(F.concat(quotes, runs(2), runs(3)))), "named": named(F.col(query))})
    return out.drop("_w", "_good")


def named(c: Column) -> Column:
    """Capitalised words, acronyms and numbers; distinct, sorted."""
    plain = F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_.%]+", "  ")
    found = [F.regexp_extract_all(F.regexp_replace(plain, r"[.%]", "  "), F.lit(p), F.lit(1)) for p in (r"(?:^| )([A-Z][a-z]+)(?: |$)", r"(?:^| )([A-Z]{2,})(?: |$)")]
    numbers = F.regexp_extract_all(plain, F.lit(r"(?:^| )([0-9]+(?:\.[0-9]+)?)%?(?: |\.|$)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(*found, numbers)))


def intent(c: Column) -> Column:
    low, out = F.lower(c), F.lit("general")
    for name, parts in reversed(INTENTS.items()):
        out = F.when(any_of(low, parts), name).otherwise(out)
    return out


def focused(c: Column, phrases: Column, keywords: Column) -> Column:
    """The query to search for: the longest phrase in quotes (the first of equals), else three keywords, else all."""
    size = lambda p: F.size(F.split(p, " ")) + F.when(p.rlike("^(?:a|an|the) "), 0).otherwise(2)
    own = F.filter(phrases, lambda p: F.contains(p, F.lit(" ")))
    best = F.array_min(F.transform(own, lambda p: F.struct((-size(p)).alias("n"), p.alias("p"))))["p"]
    few = F.slice(keywords, 1, 3)
    return F.when(best.isNotNull(), F.concat(F.lit('"'), best, F.lit('"'))).when(F.size(few) > 0, F.array_join(few, " ")).otherwise(c)


def product_scores(low: Column, products: dict) -> dict[str, Column]:
    """How many patterns of each product occur; whole life doesn't count beside a whole contract."""
    out = {n: sum((low.rlike(edged(p)).cast("int") for p in ps), F.lit(0)) for n, ps in products.items()}
    out["whole_life"] = F.when(low.rlike(edged(NOT_WHOLE)), 0).otherwise(out["whole_life"])
    return out


def leading(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(name, share of all) of the largest score, the first of equals; null and 0 without any."""
    total = sum(scores.values(), F.lit(0))
    top = F.greatest(*scores.values())
    name = F.lit(None).cast("string")
    for n, s in reversed(scores.items()):
        name = F.when(s == top, n).otherwise(name)
    return F.when(total > 0, name), F.when(total > 0, top / total).otherwise(0.0)


def expanded(c: Column) -> Column:
    low, out = F.lower(c), c
    for term, more in reversed(EXPANSIONS.items()):
        out = F.when(F.contains(low, F.lit(term)), F.concat(c, F.lit(" " + more))).otherwise(out)
    return out


def fields(c: Column) -> Column:
    """The fields of knowledge a question touches."""
    return labels_where({n: any_of(F.lower(c), p) for n, p in FIELDS.items()})


def general_knowledge(c: Column) -> Column:
    """A question of general knowledge by its form, unless it speaks of documents."""
    low = F.lower(c)
    of_documents = low.rlike("|".join(f"(?:{edged(p)})" for p in OF_DOCUMENTS))
    return ~of_documents & low.rlike("|".join(f"(?:{p})" for p in GENERAL).replace("$", r"\z"))


def extraction_scores(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    forms = sum((F.when(low.rlike(p), 0.2).otherwise(0.0) for p in FORMS), F.lit(0.0))
    return {n: sum((F.when(F.contains(low, F.lit(w)), WEIGHT.get(w, 0.1)).otherwise(0.0) for w in ws), F.lit(0.0)) + forms for n, ws in EXTRACTION.items()}


#: Phrases of follow-up questions that fit any talk, and signs that one belongs to this talk.
ANY_TALK = ("how do insurers typically", "what strategies do insurers", "how does claims impact profitability", "what are some strategies for", "how do companies typically handle", "what are the benefits of this approach", "how can organizations improve", "what factors influence profitability", "what are some common practices", "how can we improve our", "what does this mean for the industry", "what are the implications for", "how should companies approach", "what best practices should", "how does this compare to industry standards")
SPEAKS_OF = ("mentioned", "explained", "described", "discussed", "cited", "document", "section", "example", "table", "schedule", "presentation", "compared to", "other segments", "different", "breakdown", "components")
SHARED = ("calculation", "method", "approach", "guidance", "component", "breakdown", "segment", "traditional", "group", "reserve", "reserves", "liability", "premium", "valuation", "actuarial", "capital", "ratio", "regulatory", "compliance", "standard", "requirement", "disclosure", "analysis", "assessment", "evaluation", "review", "implementation")
OWN_TERMS = ("reserve", "liability", "premium", "actuarial", "capital", "ratio", "valuation", "standard", "compliance", "regulatory", "gaap", "ifrs", "calculation", "method")


def contextual(question: Column, asked: Column, answer: Column) -> Column:
    """Whether a follow-up question belongs to a talk: it names something of the question or of the answer."""
    q, a, r = F.lower(question), F.lower(asked), F.lower(answer)
    shared = any_of(q, SHARED) & F.exists(F.array(*map(F.lit, SHARED)), lambda t: F.contains(q, t) & F.contains(r, t))
    taken = lambda c, longer: F.size(F.filter(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), lambda w: (F.length(w) > longer) & F.contains(q, w)))
    figures = F.exists(F.regexp_extract_all(r, F.lit(r"[0-9]+\.[0-9]+%"), F.lit(0)), lambda x: F.contains(q, x))
    own = (F.length(q) > 20) & any_of(q, OWN_TERMS)
    return ~any_of(q, ANY_TALK) & (any_of(q, SPEAKS_OF) | shared | figures | (taken(a, 3) >= 2) | (taken(r, 4) >= 3) | own)


def validation_score(phrases: Column, named: Column, keywords: Column, content: Column) -> Column:
    """Three points a phrase, two a name, one a keyword of the question in the content, by its thousands of signs."""
    low = F.lower(content)
    hits = lambda xs: F.size(F.filter(xs, lambda x: F.contains(low, F.lower(x))))
    points = 3 * hits(phrases) + 2 * hits(named) + hits(keywords)
    return points / F.greatest(F.lit(1.0), F.length(content) / 1000)
