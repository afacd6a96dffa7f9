"""Operator 8: personal data by candidate gradient boosting, in DataFrame functions alone.

Four base kinds are sure: their pattern and check decide. Beyond them, generators of high recall propose spans that may
overlap (phone numbers without a plus, social security numbers, written-out mail addresses, bank accounts, card-like
digits that fail the Luhn check, long-form addresses, keys and passwords after their names). Format and context features of each candidate go through boosted
trees, written as column expressions; calibrated thresholds by kind select redactions. Candidates that touch a base
span are dropped, so base spans stay as they are. The trees are fitted on a bounded set of labelled snippets made from
templates below (``SNIPPETS`` rows), once in a driver process; no row of the data is used for that.

Each row is handled where it lies: no shuffle, no Python on executors. Offsets count code points. No pattern can
backtrack over long runs (possessive quantifiers and look-behinds stand where the plain pattern would try each start of
a run, without changing what matches first). Places, contexts, overlaps and redaction take time linear in a text and its
hits, however long it is (see ``spans``).

Defined results: null and empty texts have no spans and the hash of the empty string; equal rows each give a row; an
empty table gives no rows; other columns pass through ``find`` unless they have the names of its results.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from . import spans as sp
from .common import absent, plain

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
#: Labelled snippets from which the trees are fitted, and the least calibrated share of right ones to redact.
SNIPPETS, PRECISION = 1200, 0.9

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, with what is needed to scan long runs once.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Maximal digit runs of 14 to 19 digits: the plain pattern always takes a whole run.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: (kind, pattern) of the generators.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)[ -]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("email", rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{2,64}}+ ?[(\[{{ ](?:at|AT)[)\]}} ] ?[A-Za-z0-9-]{{2,64}}+ ?[(\[{{ ](?:dot|DOT)[)\]}} ] ?[A-Za-z]{{2,12}}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", BASE["card"]),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("secret", r"""(?i:password|passwd|passphrase|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{8,}"""),
)
#: Words before a candidate that speak for or against personal data.
FOR = r"(?i)(phone|tel|call|fax|mobile|cell|contact|reach|ssn|social|security|card|visa|mail|iban|account|bank|address)[^\n]{0,20}$"
AGAINST = r"(?i)(order|invoice|version|ref|isbn|serial|part|item|sku|code|build|ticket|look|stay|page)[^\n]{0,20}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    digit = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    each = F.transform(F.split(d, ""), lambda x, k: F.when(k % 2 == 0, digit(x)).when(digit(x) > 4, digit(x) * 2 - 9).otherwise(digit(x) * 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(m: Column) -> Column:
    plain = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(plain, lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def _if(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(sp.SPAN))


def base_spans(text: Column) -> Column:
    """All base spans, sorted by start and kind."""
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(BASE["ip"]), "card": text.rlike(BASE["card"]), "phone": text.rlike(r"\+[0-9]")}
    return F.array_sort(F.concat(*[_if(guards[k], sp.matches(text, BASE[k], n, CHECKS[k])) for n, k in enumerate(KINDS[:4])]))


def candidates(text: Column) -> Column:
    """Spans that the generators propose; ``kind`` numbers the generator here."""
    named = sp.let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("passw", "passphrase", "secret", "token", "apikey", "api_key")]))
    return F.concat(*[_if(named if k == "secret" else text.rlike(p), sp.matches(text, p, n)) for n, (k, p) in enumerate(GENERATORS)])


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    value = F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(F.coalesce(x.try_cast("int"), F.lit(0))))
    return F.aggregate(value, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def features(parts: Column, c: Column) -> Column:
    """Format and context features of a candidate in a text given as ``spans.chunks``."""
    before, after = sp.cut(parts, F.greatest(c["start"] - 40, F.lit(0)), c["start"]), sp.cut(parts, c["end"], c["end"] + 1)
    context = F.struct(_digits(c["match"]).alias("digits"), before.alias("before"), after.alias("after"))
    return sp.let(context, lambda x: F.array(*_features(c, x["digits"], x["before"], x["after"])))


def _features(c: Column, digits: Column, before: Column, after: Column) -> list[Column]:
    m = c["match"]
    kind = F.substr(before, F.greatest(F.length(before), F.lit(1)), F.lit(1))
    number = lambda x: x.cast("double")
    return [
        number(c["kind"]),
        number(F.length(digits)),
        number(F.length(m)),
        number(F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))),
        number(F.size(F.array_distinct(F.split(digits, "")))),
        number(F.contains(m, F.lit("("))),
        number(digits.rlike("^(000|9|666)")),
        number(before.rlike(FOR)),
        number(before.rlike(AGAINST)),
        number(kind.rlike("[A-Za-z0-9_/#.-]")),
        number(after.rlike("[A-Za-z0-9_/-]")),
        number(F.coalesce(_luhn(m), F.lit(False))),
        number(_mod97(m) == 1),
        number(m.rlike(r"(?i)[(\[{]at[)\]}]")),
        number(m.rlike(r"(?i)[^a-z](com|org|net|edu|gov|io|de|fr|es|uk)$")),
        number(m.rlike("[0-9]")),
        number(m.rlike("(?:[0-9][A-Za-z]|[A-Za-z][0-9])[^:=]*$")),
    ]


def _iban(rng: random.Random, good: bool) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(18))
    land = rng.choice(("DE", "FR", "ES", "GB"))
    check = 98 - int(body + "".join(str(ord(x) - 55) for x in land) + "00") % 97
    whole = f"{land}{(check if good else check % 89 + 3):02d}{body}"
    return " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def snippets(n: int = SNIPPETS) -> list[tuple[str, int]]:
    """Labelled texts from templates: personal data in its usual surroundings, and look-alikes."""
    rng = random.Random(1)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeiounrstlmd") for _ in range(rng.randint(3, 8)))
    good = ("phone ", "call me at ", "tel: ", "my mobile is ", "fax ", "contact: ")
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    mixed = lambda k: d(1) + "".join(rng.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(k - 1))
    key = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k - 2)) + "0b"
    bad = ("order ", "invoice no ", "part ", "ref ", "serial ", "ticket ")
    out = []
    while len(out) < n:
        sep = rng.choice(" .-")
        phone = rng.choice((f"({rng.randint(2, 9)}{d(2)}) {d(3)}-{d(4)}", f"{rng.randint(2, 9)}{d(2)}{sep}{d(3)}{sep}{d(4)}"))
        ssn = f"{rng.randint(1, 8)}{d(2)}-{d(2)}-{d(4)}"
        name = f"{word()}.{word()}" if rng.random() < 0.5 else word()
        rows = [
            (rng.choice(good) + phone, 1),
            (f"{word()} {word()} {phone}", 1),
            (rng.choice(bad) + phone, 0),
            (rng.choice(("ssn ", "social security number ", "my ssn is ")) + ssn, 1),
            (rng.choice(bad) + ssn, 0),
            (f"{word()} {d(3)}-{d(2)}-{d(4)}/{d(2)}", 0),
            (f"write to {name} {rng.choice(('(at)', '[at]'))} {word()} {rng.choice(('(dot)', '[dot]', 'dot'))} org", 1),
            (f"mail {name} at {word()} dot com", 1),
            (f"look {word()} at {word()} dot {word()}", 0),
            (f"{word()} {word()} {word()} at {word()} dot {word()}", 0),
            (f"{rng.choice(('iban ', 'account ', word() + ' '))}{_iban(rng, True)}", 1),
            (f"{rng.choice(('code ', 'serial ', word() + ' '))}{_iban(rng, False)}", 0),
            (f"{rng.choice(('card number ', 'visa ', 'my card '))}{rng.choice('3456')}{d(15)}", 1),
            (f"{word()} {d(16)}", 0),
            (f"{rng.choice(bad)}{d(rng.randint(14, 19))}", 0),
            (f"{word()} " + ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), 1),
            (f"{word()} " + ":".join(d(2) for _ in range(8)), 0),
            (f"{rng.choice(names)}{rng.choice((': ', '=', ' = '))}{mixed(rng.randint(8, 40))}", 1),
            (f'{rng.choice(names)} = "{key(rng.randint(16, 40))}"', 1),
            (f"{rng.choice(names)}{rng.choice((': ', '=', ' = '))}{word()}{word()}{word()}", 0),
            (f"{rng.choice(names)}: {word()}-{word()}_{word()}", 0),
        ]
        out += [(f"{text} {word()}.", y) for text, y in rows]
    return out[:n]


_FITTED: dict = {}


def fitted(spark: SparkSession) -> tuple[boosting.Boosted, list[float]]:
    """The trees, and for each generator the margin from which candidates are redacted."""
    if "model" not in _FITTED:
        rows = ", ".join(f"({n}, '{t}', {y})" for n, (t, y) in enumerate(snippets()))
        table = spark.sql(f"SELECT * FROM VALUES {rows} AS s(n, text, y)")
        each = table.select("n", "y", "text", F.explode(candidates(F.col("text"))).alias("c"))
        got = each.select("n", "y", features(sp.chunks(F.col("text")), F.col("c")).alias("x")).collect()  # a few a snippet
        x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float)
        fold = np.array([r["n"] % 5 for r in got])
        settings = {"trees": 24, "depth": 3, "rate": 0.3}
        margin = np.zeros(len(y))
        for k in range(5):
            margin[fold == k] = boosting.fit(x[fold != k], y[fold != k], **settings).margin(x[fold == k])
        least = []
        for g in range(len(GENERATORS)):
            own = x[:, 0] == g
            grid = np.unique(margin[own])
            share = boosting.isotonic(margin[own], y[own])(grid)
            least.append(float(grid[share >= PRECISION].min()) if (share >= PRECISION).any() else float("inf"))
        _FITTED["model"] = boosting.fit(x, y, **settings), least
    return _FITTED["model"]


def added_spans(spark: SparkSession, text: Column, base: Column, proposed: Column) -> Column:
    """Candidates that the trees select and that touch no base span; overlapping ones all stay.

    The features of a candidate are computed once, as an array; the trees read its elements.
    """
    trees, least = fitted(spark)

    def redact(c):
        wanted = F.lit(float("inf"))
        for g, m in enumerate(least):
            wanted = F.when(c["kind"] == g, F.lit(m)).otherwise(wanted)
        return trees.column(_Elements(c["x"])) >= wanted

    def named(c):
        kind = F.lit(0)
        for g, (k, _) in enumerate(GENERATORS):
            kind = F.when(c["kind"] == g, F.lit(KINDS.index(k))).otherwise(kind)
        return F.struct(c["start"].alias("start"), kind.alias("kind"), c["end"].alias("end"), c["match"].alias("match"))

    def seen(parts):
        return F.transform(sp.apart(proposed, base), lambda c: F.struct(*(c[k].alias(k) for k in ("start", "kind", "end", "match")), features(parts, c).alias("x")))

    return _if(F.size(proposed) > 0, sp.let(sp.chunks(text), lambda parts: F.transform(F.filter(seen(parts), redact), named)))


class _Elements:
    """An array column by place."""

    def __init__(self, x: Column):
        self.x = x

    def __getitem__(self, k: int) -> Column:
        return F.get(self.x, F.lit(k))


def find(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two columns of spans, (start, kind, end, match) sorted by start and kind: base ones, and all."""
    whole = F.coalesce(plain(text), F.lit(""))
    (proposed,) = absent([*docs.columns, base, spans], "proposed")
    out = docs.withColumn(base, base_spans(whole)).withColumn(proposed, candidates(whole))
    every = F.array_sort(F.concat(plain(base), added_spans(docs.sparkSession, whole, plain(base), plain(proposed))))
    return out.withColumn(spans, every).drop(proposed)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, their digest, and all spans."""
    found = find(docs.select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(sp.listed(F.col("base"), KINDS), 256).alias("base_sha256"), sp.listed(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; all columns stay."""
    base, spans = absent(docs.columns, "base", "spans")
    found = find(docs, text, base, spans)
    return found.withColumn(text, sp.replaced(plain(text), plain(spans), F.array(*map(F.lit, KINDS)))).select(*map(plain, docs.columns))
