"""Scores of questions and of answers against their sources, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_of, n_words, sentences, terms, words

#: Words of the query rules.
POINTS_BACK = ("that document", "this document", "the document", "it say", "above", "previous")
COMPARING = ("difference", "compare", "versus", "vs", "between", "contrast")
PROCEDURAL = ("how to", "steps", "process", "procedure", "calculate", "determine")
#: Weights by type (exact match, semantic, context, entity coverage).
WEIGHTS = {"specific_reference": (0.6, 0.2, 0.1, 0.1), "conceptual": (0.2, 0.6, 0.1, 0.1), "contextual": (0.3, 0.4, 0.2, 0.1)}
REFERENCE = r"[0-9]+(?:[.-][0-9]+)+"
#: Words that make a sentence a claim, and words that prove nothing.
CLAIMING = ("is", "are", "requires", "must", "should", "includes", "consists of", "equals", "ratio", "percentage", "calculation")
EMPTY_WORDS = ("this", "that", "with", "from", "they", "will", "would", "could", "should", "must", "also", "such", "each", "some", "more", "most")
GENERIC = ("in general", "typically", "commonly used", "standard practice")


def entities(q: Column) -> Column:
    """References by number, quoted parts and acronyms of a question, without repeats, sorted."""
    found = F.concat(F.regexp_extract_all(q, F.lit(REFERENCE), F.lit(0)), F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(q, F.lit(r"\b[A-Z]{2,6}\b"), F.lit(0)))
    return F.array_sort(F.array_distinct(found))


def query_type(q: Column) -> Column:
    low = F.lower(q)
    return (
        F.when(any_of(low, POINTS_BACK), "contextual")
        .when(F.exists(entities(q), lambda e: e.rlike(REFERENCE)), "specific_reference")
        .when(any_of(low, COMPARING), "comparison")
        .when(any_of(low, PROCEDURAL), "procedural")
        .otherwise("conceptual")
    )


def specificity(q: Column) -> Column:
    """Mean of four factors: length, entities, digits and quotes."""
    parts = F.least(n_words(q) / 10.0, F.lit(1.0)) + F.least(F.size(entities(q)) / 3.0, F.lit(1.0)) + F.when(q.rlike("[0-9]"), 0.5).otherwise(0.0) + F.when(F.contains(q, F.lit('"')), 0.3).otherwise(0.0)
    return parts / 4


def weights(kind: Column, spec: Column) -> list[Column]:
    """The four weights, moved by how specific the question is, adding to one."""
    base = []
    for k in range(4):
        c = F.lit(WEIGHTS["conceptual"][k])
        for name in ("specific_reference", "contextual"):
            c = F.when(kind == name, WEIGHTS[name][k]).otherwise(c)
        base.append(c)
    exact = F.when(spec > 0.7, F.least(F.lit(0.8), base[0] + 0.2)).when(spec < 0.3, F.greatest(F.lit(0.1), base[0] - 0.1)).otherwise(base[0])
    semantic = F.when(spec > 0.7, F.greatest(F.lit(0.1), base[1] - 0.1)).when(spec < 0.3, F.least(F.lit(0.7), base[1] + 0.2)).otherwise(base[1])
    total = exact + semantic + base[2] + base[3]
    return [c / total for c in (exact, semantic, base[2], base[3])]


def exact_match(own: Column, content: Column) -> Column:
    """Points for each entity in the content, by its kind, times the share found; at most 1."""
    low = F.lower(content)
    return exact_points(own, F.filter(own, lambda e: F.contains(low, F.lower(e))))


def exact_points(own: Column, hit: Column) -> Column:
    """``exact_match`` where it is known which entities were found."""
    points = F.aggregate(hit, F.lit(0.0), lambda s, e: s + F.when(F.length(e) > 10, 0.3).when(e.rlike(REFERENCE), 0.25).otherwise(0.15))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.least(points * F.size(hit) / F.size(own), F.lit(1.0)))


def coverage(own: Column, content: Column) -> Column:
    low = F.lower(content)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda e: F.contains(low, F.lower(e)))) / F.size(own))


def similarity_threshold(q: Column, base: float = 0.70, long: float = -0.05, hard: float = 0.05) -> Column:
    """Lower for long questions, higher for hard words, between 0.5 and 0.9."""
    many = F.size(F.filter(words(q), lambda w: F.length(w) > 6))
    move = F.when(n_words(q) > 15, long).when(many > 3, hard).otherwise(0.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(0.9), F.lit(base) + move))


def document_limit(q: Column, base: int = 10, most: int = 20) -> Column:
    n = n_words(q)
    return F.when(n > 20, min(most, base + 5)).when(n > 10, base).otherwise(max(5, base - 2)).cast("long")


def confidence(n_docs: Column, response: Column) -> Column:
    """From the number of documents and the length of the answer."""
    value = F.least(F.lit(0.8), n_docs / 5.0) * 0.6 + F.least(F.lit(1.0), n_words(response) / 100) * 0.2 + F.least(F.lit(1.0), n_docs / 10) * 0.2
    return F.when((n_docs == 0) | (F.length(response) == 0), 0.1).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), value)))


def claims(response: Column) -> Column:
    """Sentences of at least ten signs that claim something."""
    return F.filter(sentences(response, 9), lambda s: any_of(F.lower(s), CLAIMING))


def evidence_coverage(response: Column, sources: Column, share: float = 0.7) -> Column:
    """The share of claims of whose terms at least ``share`` occur in the sources; 0.5 without claims."""
    low = F.lower(sources)

    def supported(claim: Column) -> Column:
        own = F.filter(F.regexp_extract_all(F.lower(claim), F.lit("[a-z0-9_]{4,}"), F.lit(0)), lambda t: ~t.isin(*EMPTY_WORDS))
        return (F.size(own) > 0) & (F.size(F.filter(own, lambda t: F.contains(low, t))) >= share * F.size(own))

    own = claims(response)
    return F.when(F.size(own) == 0, 0.5).otherwise(F.size(F.filter(own, supported)) / F.size(own))


def grounded_terms(response: Column, sources: Column) -> Column:
    """The share of an answer's terms that occur in the sources, as substrings; 0.5 without terms."""
    low, own = F.lower(sources), terms(response)
    return F.when(F.size(own) == 0, 0.5).otherwise(F.size(F.filter(own, lambda t: F.contains(low, t))) / F.size(own))


def word_overlap(query: Column, source: Column) -> Column:
    """The share of a question's distinct words among those of a source."""
    q = F.array_distinct(words(F.lower(query)))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, words(F.lower(source)))) / F.size(q))


def generic_risk(response: Column) -> Column:
    low = F.lower(response)
    return sum((F.contains(low, F.lit(g)).cast("double") for g in GENERIC), F.lit(0.0)) / len(GENERIC)


def grounding_score(parts: dict[str, Column], by: dict[str, float], risk: Column) -> Column:
    """Weighted mean of the parts that are not null, less up to half by risk."""
    total = sum((F.coalesce(c * by[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), by[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    return F.when(weight == 0, 0.0).otherwise(total / weight * (1 - 0.5 * risk))


#: Concepts of the field, words that are no concept, and what makes three words a technical term.
FIELD_CONCEPTS = (
    "ratio", "ratios", "capital", "equity", "asset", "liability", "reserve", "reserves", "requirement", "regulation", "regulatory", "compliance",
    "ifrs", "gaap", "solvency", "licat", "calculation", "formula", "method", "risk", "coverage", "margin",
)
NO_CONCEPTS = (
    "this", "that", "with", "from", "they", "will", "would", "could", "should", "must", "also", "such", "each", "some", "more", "most",
    "have", "been", "when", "where", "what", "which", "these", "those",
)
TECHNICAL = ("factor", "rate", "test", "reserve", "value", "duration")
#: A formula, a number, and (in a text where words with other signs than ASCII letters are masked) three words in a row.
FORMULA = r"[A-Z]\w*\s*=\s*[0-9.+*/()\s\w×-]+"
NUMBER = r"[0-9]+\.?[0-9]*%?|\$[0-9]+\.?[0-9]*"
MASKED, THREE = r"[A-Za-z]*[0-9_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*", r"(?i)[a-z]+\s+[a-z]+\s+[a-z]+"
WORD = r"[\p{L}\p{M}\p{N}_]+"


def concepts(text: Column) -> Column:
    """Concepts of a text: words of the field, and its first ten words of four ASCII letters that mean something."""
    own = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    terms = F.filter(own, lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(*NO_CONCEPTS))
    return F.array_distinct(F.concat(F.filter(own, lambda w: w.isin(*FIELD_CONCEPTS)), F.slice(terms, 1, 10)))


def ungrounded(response: Column, sources: Column) -> dict[str, Column]:
    """Formulas, numbers and technical claims of a response that its sources don't hold."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    low = F.lower(sources)

    def no_formula(f: Column) -> Column:
        part = F.exists(F.split(f, r"[=+*/()-]"), lambda p: (F.length(bare(p)) > 2) & F.contains(sources, bare(p)))
        return ~(part | F.contains(sources, f) | F.contains(sources, F.replace(F.replace(f, F.lit("×"), F.lit("*")), F.lit(" "), F.lit(""))))

    def no_number(n: Column) -> Column:
        return ~n.isin("1", "2", "3") & (F.length(n) > 1) & ~F.contains(sources, n) & ~F.contains(sources, F.regexp_replace(n, r"^\$+|%+$", ""))

    def no_claim(c: Column) -> Column:
        return ~F.contains(low, F.lower(c)) & ~F.exists(F.split(c, r"\s+"), lambda w: (F.length(w) > 3) & F.contains(low, F.lower(w)))

    every = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    acronyms = F.filter(every(response, WORD), lambda w: w.rlike("^[A-Z]{2,5}$"))
    terms = F.filter(every(F.regexp_replace(response, MASKED, "#"), THREE), lambda t: any_of(F.lower(t), list(TECHNICAL)))
    return {"formulas": F.filter(every(response, FORMULA), no_formula), "numbers": F.filter(every(response, NUMBER), no_number), "claims": F.filter(F.concat(acronyms, terms), no_claim)}
