"""What documents are about and whom they name, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, labels_where, words

#: Signs of content domains and of document domains, in order; by source name and by text.
CONTENT = {
    "regulatory": ("usstat", "ifrs", "gaap", "regulation", "compliance"),
    "legal": ("contract", "agreement", "legal", "terms"),
    "technical": ("api", "technical", "specification", "manual"),
    "medical": ("medical", "patient", "diagnosis", "treatment"),
}
DOMAINS = {
    "insurance": (("licat", "insurance", "regulatory", "capital"), ()),
    "accounting_standards": (("pwc", "asc", "ifrs", "gaap"), ("asc ", "ifrs", "accounting standard")),
    "foreign_currency": (("foreign", "currency", "fx"), ("foreign currency", "exchange rate")),
    "actuarial": (("actuarial", "valuation", "reserves"), ("actuarial", "present value", "discount rate")),
}
#: The document domains that serve a question of a domain.
COMPATIBLE = {
    "accounting_standards": ("accounting_standards", "foreign_currency", "general"),
    "foreign_currency": ("foreign_currency", "accounting_standards", "general"),
    "insurance": ("insurance", "actuarial", "general"),
    "actuarial": ("actuarial", "insurance", "general"),
    "general": ("general", "accounting_standards", "foreign_currency", "insurance", "actuarial"),
}
#: Words of frameworks, of comparisons, and of document types by source name and text.
FRAMEWORKS = {"usstat": ("usstat", "us statutory", "valuation manual"), "ifrs": ("ifrs", "international financial reporting"), "gaap": ("gaap", "generally accepted accounting")}
COMPARING = ("compare", "vs", "versus", "difference")
#: Standards, terms and categories of terms that insights and profiles report.
STANDARDS = ("ASC", "FASB", "IFRS", "GAAP", "CECL", "LDTI", "ASU", "FAS")
INSIGHT_TERMS = ("reserve", "liability", "asset", "premium", "claim", "policyholder", "actuarial", "valuation")
CATEGORIES = {
    "Standards": ("gaap", "ifrs", "asc", "fasb", "iasb", "pcaob", "sox", "coso"),
    "Financial Items": ("revenue", "liability", "asset", "equity", "income", "expense", "cash flow", "balance sheet"),
    "Insurance Terms": ("reserve", "premium", "claim", "policy", "policyholder", "underwriting", "reinsurance"),
    "Actuarial": ("actuarial", "valuation", "assumption", "mortality", "morbidity", "lapse", "discount rate"),
    "Compliance": ("compliance", "audit", "control", "regulation", "requirement", "disclosure"),
}
_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december)"
#: Dates by digits and by names of months; figures with a currency or a percent sign; lines that are headings.
DATES = rf"(?i)(?:[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|{_MONTH}[ ]+[0-9]{{1,2}},?[ ]+[0-9]{{4}}|[0-9]{{1,2}}[ ]+{_MONTH}[ ]+[0-9]{{4}})"
FIGURES = r"(?:\$[0-9,]+(?:\.[0-9]{2})?(?: ?(?:million|billion|thousand))?|[0-9][0-9,]*(?:\.[0-9]{1,2})?%)"
HEADING = r"^(?:[A-Z ]{10,50}|[0-9]+\. +[A-Z][^.]+|[0-9]+\.[0-9]+ +[A-Z][^.]+)$"
#: Two capitalised words, with or without an initial between.
NAME = r"[A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+"

#: Parts of titles by field of work, and words that stand for no title.
TITLES = {
    "financial": ("cfo", "treasurer", "controller", "financial", "finance", "accounting"),
    "operations": ("operations", "coo", "manager", "director", "supervisor"),
    "technical": ("cto", "technical", "engineer", "developer", "architect"),
    "legal": ("legal", "counsel", "attorney", "compliance"),
    "human_resources": ("hr", "human resources", "people", "talent"),
}
NO_TITLE = ("not specified", "none", "n/a", "")


def first_of(c: Column, lexicon: dict, otherwise: str = "general") -> Column:
    """The first name of which a word occurs."""
    out = F.lit(otherwise)
    for name, parts in reversed(lexicon.items()):
        out = F.when(any_of(c, parts), name).otherwise(out)
    return out


def domain(source: Column, text: Column) -> Column:
    """The domain of a document by words of its source's name or of its text; the first that fits."""
    s, t, out = F.lower(source), F.lower(text), F.lit("general")
    for name, (by_source, by_text) in reversed(DOMAINS.items()):
        hit = F.coalesce(any_of(s, by_source), F.lit(False))
        out = F.when(hit | (any_of(t, by_text) if by_text else F.lit(False)), name).otherwise(out)
    return out


def frameworks(text: Column) -> Column:
    return labels_where({n: any_of(F.lower(text), p) for n, p in FRAMEWORKS.items()})


def document_type(source: Column, text: Column) -> Column:
    s, t = F.lower(F.coalesce(source, F.lit(""))), F.lower(text)
    return F.when(any_of(s, ("manual", "guide")), "manual").when(any_of(t, ("comparison", "compare")), "comparison_guide").when(any_of(t, ("regulation", "statutory")), "regulation").otherwise("other")


def distinct_first(c: Column, pattern: str, most: int) -> Column:
    """The first ``most`` different matches, in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), 1, most)


def headings(c: Column, lines: int = 50, most: int = 8) -> Column:
    """Lines of 6 to 79 signs in capitals or numbered, among the first ``lines``."""
    own = F.transform(F.slice(F.split(c, "\n"), 1, lines), lambda x: F.trim(x))
    return F.slice(F.filter(own, lambda x: (F.length(x) > 5) & (F.length(x) < 80) & x.rlike(HEADING)), 1, most)


def bands(n_words: Column, n_pages: Column, n_categories: Column) -> Column:
    level = F.when(n_words > 5000, "substantial").when(n_words > 1000, "moderate").otherwise("basic")
    scope = F.when(n_categories > 2, "multiple").otherwise("specific")
    form = F.when(n_pages > 20, "complex").otherwise("standard")
    review = F.when(n_words > 10000, "detailed").otherwise("standard")
    return F.concat_ws("/", level, scope, form, review)


def in_content(name: Column, title: Column, content: Column) -> Column:
    """Whether a name, and its title or a usual variation of it, occur in a text."""
    low, t = F.lower(content), F.lower(title)
    kinds = F.array(t, F.replace(t, F.lit(" "), F.lit("")), F.trim(F.replace(t, F.lit("chief"), F.lit(""))), F.trim(F.replace(t, F.lit("officer"), F.lit(""))))
    titled = title.isNull() | F.exists(kinds, lambda k: (F.length(k) > 0) & F.contains(low, k))
    return F.contains(low, F.lower(name)) & titled


def clean_title(title: Column) -> Column:
    own = F.trim(title)
    return F.when(~F.lower(own).isin(*NO_TITLE), own)


def work_fields(title: Column) -> Column:
    return labels_where({n: any_of(F.lower(title), p) for n, p in TITLES.items()})


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


#: Forms in which a name and a title stand together, titles of finance, and the forms of a name beside one
#: (whatever the case). What ends a title is taken with it, as nothing that could begin the next hit.
NAME_AND_TITLE = (r"([A-Z][a-z]+ [A-Z][a-z]+),?\s+([A-Z][a-zA-Z\s]+?)[\n.,]", r"([A-Z][a-zA-Z\s]{2,}?):\s*([A-Z][a-z]+ [A-Z][a-z]+)", r"([A-Z][a-z]+ [A-Z][a-z]+)\s*-\s*([A-Z][a-zA-Z\s]+)")
FINANCE = ("Chief Financial Officer", "CFO", "Treasurer", "Controller", "Financial Analyst", "Finance Director", "Finance Manager")
BESIDE = (r"(?i)([A-Z][a-z]+ [A-Z][a-z]+),?\s+{title}", r"(?i){title}:?\s+([A-Z][a-z]+ [A-Z][a-z]+)", r"(?i)([A-Z][a-z]+ [A-Z][a-z]+)\s*-\s*{title}")


def people(text: Column) -> Column:
    """People that a text names with a title, as (name, title, confidence): by form 0.6, by a title of finance 0.7."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    person = lambda n, t, c: F.struct(n.alias("name"), t.alias("title"), F.lit(c).alias("confidence"))
    found = []
    for p in NAME_AND_TITLE:
        pairs = F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda n, t: person(bare(n), bare(t), 0.6))
        found.append(F.filter(pairs, lambda x: x["name"].rlike(r"\S\s+\S") & (F.length(x["title"]) > 2)))
    for title in FINANCE:
        own = F.concat(*[F.regexp_extract_all(text, F.lit(p.format(title=title)), F.lit(1)) for p in BESIDE])
        hit = F.contains(F.lower(text), F.lit(title.lower()))
        found.append(F.when(hit, F.transform(own, lambda n: person(n, F.lit(title), 0.7))).otherwise(F.array().cast("array<struct<name:string,title:string,confidence:double>>")))  # noqa: B023
    return F.concat(*found)
