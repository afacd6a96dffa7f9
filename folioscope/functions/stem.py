"""Porter's stemming algorithm (1980) as a column expression, as SQL for the second engine, and for single words in tasks.

Each step is a list of rules (ending, what stands for it, what must hold of the stem before it); the first rule whose ending
fits decides, whether or not its condition holds. Conditions are patterns over letters: with C a consonant and V a vowel
(y after a consonant counts as one), m is how often VC follows in the stem.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the algorithm.
_C, _V = "(?:[^aeiouy]|^y|y(?=[aeiou]))", "[aeiouy]"
_CC, _VV = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"^(?:{_CC})?{_VV}{_CC}", f"^(?:{_CC})?{_VV}{_CC}{_VV}{_CC}"
_ONE = f"^(?:{_CC})?{_VV}{_CC}(?:{_VV})?$"
_VOWEL = f"^(?:{_CC})?{_V}"
#: consonant, vowel, consonant that is not w, x or y
_CVC = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"

#: The endings of steps 1a, 2, 3 and 4, longest first where one ends another.
STEP_1A = (("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None))
STEP_2 = tuple(
    (a, b, _M0)
    for a, b in (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
        ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
    )
)
STEP_3 = tuple((a, b, _M0) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")))
STEP_4 = tuple((a, "", _M1) for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"))
_ION = "[st]$"


class _Spark:
    """Text functions on columns."""

    matches = staticmethod(lambda x, p: x.rlike(p))
    replaced = staticmethod(lambda x, p, to: F.regexp_replace(x, p, to.replace("\\1", "$1")))
    long = staticmethod(lambda x, n: F.length(x) >= n)
    both = staticmethod(lambda a, b: a & b)
    apart = staticmethod(lambda a: ~a)

    @staticmethod
    def cases(pairs, other):
        out = F.when(*pairs[0])
        for p in pairs[1:]:
            out = out.when(*p)
        return out.otherwise(other)


class _Sql:
    """The same as text."""

    matches = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    replaced = staticmethod(lambda x, p, to: f"regexp_replace({x}, '{p}', '{to}')")
    long = staticmethod(lambda x, n: f"length({x}) >= {n}")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    apart = staticmethod(lambda a: f"(NOT {a})")
    cases = staticmethod(lambda pairs, other: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END")


def _same(w):
    return w


class _Plain:
    """The same as functions of a word; of cases only the first that holds is worked out, and none if no ending fits."""

    long = staticmethod(lambda x, n: lambda w: len(x(w)) >= n)
    both = staticmethod(lambda a, b: lambda w: a(w) and b(w))
    apart = staticmethod(lambda a: lambda w: not a(w))

    @staticmethod
    def matches(x, p):
        if p[-1] == "$" and p[:-1].isalpha():
            def ends(w):
                return x(w).endswith(p[:-1])

            if x is _same:
                ends.ending = p[:-1]
            return ends
        found = re.compile(p).search
        return lambda w: found(x(w)) is not None

    @staticmethod
    def replaced(x, p, to):
        changed = re.compile(p).sub
        return lambda w: changed(to, x(w))

    @staticmethod
    def cases(pairs, other):
        endings = tuple(getattr(holds, "ending", "") for holds, _ in pairs)

        def first(w):
            if w.endswith(endings):
                for holds, then in pairs:
                    if holds(w):
                        return then(w)
            return other(w)

        return first


def _step(k, x, rules):
    """The first rule whose ending fits."""
    pairs = []
    for ending, to, condition in sorted(rules, key=lambda r: -len(r[0])):
        new = k.replaced(x, f"{ending}$", to)
        if condition:
            new = k.cases([(k.matches(k.replaced(x, f"{ending}$", ""), condition), new)], x)
        pairs.append((k.matches(x, f"{ending}$"), new))
    return k.cases(pairs, x)


def _after_1b(k, x):
    """What an ending -ed or -ing leaves is mended."""
    double = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
    return [(k.matches(x, "(?:at|bl|iz)$"), k.replaced(x, "$", "e")), (k.matches(x, double), k.replaced(x, ".$", "")), (k.matches(x, _CVC), k.replaced(x, "$", "e"))]


def _steps(k):
    """Each step as a function of the word so far."""

    def step_1b(x):
        eed = k.cases([(k.matches(k.replaced(x, "eed$", ""), _M0), k.replaced(x, "d$", ""))], x)
        return k.cases([(k.matches(x, "eed$"), eed), *((k.both(k.matches(x, f"{e}$"), k.matches(k.replaced(x, f"{e}$", ""), _VOWEL)), k.replaced(x, f"{e}$", "~")) for e in ("ed", "ing"))], x)

    def step_1b_mended(x):
        bare = k.replaced(x, "~$", "")
        return k.cases([(k.apart(k.matches(x, "~$")), x), *_after_1b(k, bare)], bare)

    def step_1c(x):
        return k.cases([(k.both(k.matches(x, "y$"), k.matches(k.replaced(x, "y$", ""), _VOWEL)), k.replaced(x, "y$", "i"))], x)

    def step_4(x):
        ion = k.replaced(x, "ion$", "")
        dropped = k.cases([(k.both(k.matches(ion, _ION), k.matches(ion, _M1)), ion)], x)
        return k.cases([(k.matches(x, "ion$"), dropped)], _step(k, x, STEP_4))

    def step_5(x):
        e = k.replaced(x, "e$", "")
        keep = k.cases([(k.matches(e, _M1), e), (k.both(k.matches(e, _ONE), k.apart(k.matches(e, _CVC))), e)], x)
        return k.cases([(k.matches(x, "e$"), keep), (k.both(k.matches(x, "ll$"), k.matches(x, _M1)), k.replaced(x, "l$", ""))], x)

    def step_5b(x):
        return k.cases([(k.both(k.matches(x, "ll$"), k.matches(x, _M1)), k.replaced(x, "l$", ""))], x)

    return [lambda x: _step(k, x, STEP_1A), step_1b, step_1b_mended, step_1c, lambda x: _step(k, x, STEP_2), lambda x: _step(k, x, STEP_3), step_4, step_5, step_5b]


def stem(word: Column) -> Column:
    """The stem of a lower-cased word of three or more ASCII letters; other words stay."""

    def through(x: Column, steps) -> Column:
        if not steps:
            return x
        return F.get(F.transform(F.array(steps[0](x)), lambda y: through(y, steps[1:])), F.lit(0))

    own = word.rlike("^[a-z]{3,}$")
    return F.when(own, through(word, _steps(_Spark))).otherwise(word)


_PLAIN_STEPS = [s(_same) for s in _steps(_Plain)]
_OWN = re.compile("[a-z]{3,}").fullmatch


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    """What ``stem`` gives for one word."""
    if _OWN(word):
        for step in _PLAIN_STEPS:
            word = step(word)
    return word


def stem_sql(rows: str, column: str, keep: str = "*") -> str:
    """A query over ``rows`` with a further column ``stem`` of ``column``: one nested query a step."""
    out = f"SELECT *, {column} AS stem FROM {rows}"
    for k, s in enumerate(_steps(_Sql)):
        own = f"CASE WHEN regexp_matches({column}, '^[a-z]{{3,}}$') THEN {s('stem')} ELSE stem END"
        out = f"SELECT * REPLACE ({own} AS stem) FROM ({out}) AS s{k}"
    return out
