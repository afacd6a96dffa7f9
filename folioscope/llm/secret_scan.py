"""Operator 12: secrets by a battery of randomness tests, in DataFrame functions alone.

Three base kinds are sure: their pattern and length decide. Beyond them, runs of at least ``LEAST`` key-like signs with a
letter are candidates. A candidate's encoding is the smallest alphabet of ``ALPHABETS`` that holds all its signs. Three
tests ask whether its signs could have been drawn from that alphabet at random: chi-squared for equal use of the
signs (with the exact mean and variance for its length), runs above and below the middle of the alphabet, and serial
correlation of neighbours. The smallest of the three p-values, times three, is the candidate's ``p``; far from random means
small.

False discoveries are controlled by length. Ordinary names (``decoys``: made-up words joined as identifiers, paths and
slugs, a bounded set that is a parameter) go through the same columns. In each class of lengths, the share of decoys that
look at least as random, times the candidates of all documents in the class, is how many ordinary candidates would look
like that; the cutoff is the loosest one at which these are at most ``FALSE`` of those taken. Short candidates, where
ordinary names pass more easily, so need to look more random, or aren't taken at all. Only counts by class and
bin (at most ``4 * BINS`` rows) meet in an aggregation. Candidates that touch a base span are dropped, so base spans stay
as they are.

Each row is handled where it lies: no Python on executors. Offsets count code points; time is linear in a text and its
hits (see ``spans``).

Defined results: null and empty texts have no spans and the hash of the empty string; equal rows each give a row; an
empty table gives no rows; other columns pass through ``find`` and ``redact`` whatever their names.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as sp
from .common import absent, plain, written

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: The base patterns. Runs are taken whole, with look-behinds where each start of a run would be tried.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Signs of a candidate at least, the pattern of its run, and what stands for false discoveries at most among those taken.
LEAST, FALSE = 20, 0.05
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: The alphabets of encodings, smallest first.
ALPHABETS = (_DIGITS + "abcdef", _DIGITS + "ABCDEF", _UP + "234567", _DIGITS + _LOW, _DIGITS + _UP, _UP + _LOW + _DIGITS, _UP + _LOW + _DIGITS + "+/", _UP + _LOW + _DIGITS + "-_", _UP + _LOW + _DIGITS + "+/-_")
#: First lengths of the classes; bins of -log10 p, ten to the unit; decoys.
CLASSES, BINS, DECOYS = (20, 24, 32, 48), 300, 2000
SCORED = "array<struct<start:int,end:int,cls:int,bin:int>>"


def has_long_run(text: Column) -> Column:
    """Whether a text holds a run that a candidate or a hexadecimal key needs: most don't, and are looked through once."""
    return text.rlike(CANDIDATE.removesuffix("+={0,2}"))


def base_spans(text: Column, long_run: Column) -> Column:
    """All base spans, sorted by start and kind."""
    long_value = lambda m: F.length(F.regexp_extract(m, _VALUE, 1)) >= 8
    words = sp.let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("passw", "secret", "token", "apikey", "api_key")]))
    guards = {"assign": words, "access": F.contains(text, F.lit("AKIA")), "hex": long_run}
    none = F.array().cast(sp.SPAN)
    each = [F.when(guards[k], sp.matches(text, p, n, long_value if k == "assign" else None)).otherwise(none) for n, (k, p) in enumerate(BASE.items())]
    return F.array_sort(F.concat(*each))


def candidates(text: Column, long_run: Column) -> Column:
    """Runs of key-like signs that hold a letter."""
    found = sp.matches(text, CANDIDATE, KINDS.index("random"), lambda m: m.rlike("[A-Za-z]"))
    return F.when(long_run, found).otherwise(F.array().cast(sp.SPAN))


def _two_sided(z: Column) -> Column:
    """Share of a normal distribution at least as far from its mean (Abramowitz and Stegun 26.2.17)."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return sp.let(F.abs(z), lambda z: 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * sp.let(1 / (1 + 0.2316419 * z), poly))


def _battery(x: Column, size: Column) -> Column:
    """Three times the smallest p-value of the tests for places ``x`` in an alphabet of ``size`` signs."""
    n = F.size(x).cast("double")
    # Chi-squared: sum of squared counts by runs of equal places in order.
    step = lambda a, v: F.struct(v.alias("last"), F.when(v == a["last"], a["run"] + 1).otherwise(F.lit(1)).cast("long").alias("run"), (a["sum"] + F.when(v == a["last"], 2 * a["run"] + 1).otherwise(F.lit(1))).cast("long").alias("sum"))
    squares = F.aggregate(F.array_sort(x), F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum")), step, lambda a: a["sum"])
    chi = (size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    # Runs above and below the middle.
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    high = total(F.transform(x, lambda v: (v * 2 >= size).cast("double")))
    turns = total(F.transform(x, lambda v, k: F.when(k == 0, 1.0).otherwise(((v * 2 >= size) != (F.get(x, k - 1) * 2 >= size)).cast("double"))))
    by_runs = lambda even: sp.let(even * (even - 1) / (n - 1), lambda spread: F.when(spread > 0, _two_sided((turns - even - 1) / F.sqrt(spread))).otherwise(0.0))
    runs = sp.let(sp.let(high, lambda h: 2 * h * (n - h) / n), by_runs)
    # Serial correlation of neighbours.
    mean = total(F.transform(x, lambda v: v.cast("double"))) / n
    serial = sp.let(mean, lambda m: total(F.transform(x, lambda v, k: F.when(k == 0, 0.0).otherwise((v - m) * (F.get(x, k - 1) - m)))) / F.nullif(total(F.transform(x, lambda v: (v - m) * (v - m))), F.lit(0.0)))
    least = F.least(_two_sided(chi), runs, F.coalesce(_two_sided((serial + 1 / n) * F.sqrt(n)), F.lit(0.0)))
    return F.least(3 * least, F.lit(1.0))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, first in enumerate(CLASSES[1:], 1):
        out = F.when(n >= first, k).otherwise(out)
    return out


def scored(candidates: Column) -> Column:
    """start, end, class of length and bin of -log10 p (0: as if random) of each candidate."""

    def one(c):
        return sp.let(F.regexp_replace(c["match"], "=+$", ""), lambda signs: placed(c, signs))

    def placed(c, signs):
        inside = [(F.translate(signs, a, "") == "") for a in ALPHABETS]
        alphabet = F.lit(ALPHABETS[-1])
        for a, has in reversed(list(zip(ALPHABETS[:-1], inside))):
            alphabet = F.when(has, F.lit(a)).otherwise(alphabet)

        def measured(a: Column) -> Column:
            x = F.transform(F.filter(F.split(signs, ""), lambda s: s != ""), lambda s: F.instr(a, s) - 1)
            p = sp.let(x, lambda v: _battery(v, F.length(a).cast("double")))
            bin_ = F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40)))), F.lit(BINS - 1)).cast("int")
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), length_class(F.length(signs)).alias("cls"), F.greatest(bin_, F.lit(0)).alias("bin"))

        return sp.let(alphabet, measured)

    return F.transform(candidates, one)


def decoys(n: int = DECOYS) -> list[str]:
    """Ordinary long names: made-up words joined as in identifiers, slugs, paths and headings."""
    rng = random.Random(7)
    syllable = lambda: rng.choice("bcdfghlmnprstv") + rng.choice("aaeeeioou") + rng.choice(("", "", "n", "r", "s", "t"))
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))
    number = lambda: str(rng.choice((1, 2, 3, 10, 64, 100, 2019, 2023, 2024, rng.randrange(1000))))
    out = []
    while len(out) < n:
        want, style, parts = rng.choice((20, 22, 26, 30, 36, 44, 60)), rng.randrange(8), []
        glue = ("", "", "_", "-", "/", "", "_", "-")[style]
        while len(glue.join(parts)) < want:
            w = word() if rng.random() < 0.9 else number()
            parts.append({1: w.capitalize(), 5: w.upper(), 6: w.upper()}.get(style, w))
        if style == 4 and rng.random() < 0.3:
            parts = [w.capitalize() for w in parts]
        whole = glue.join(parts)
        if style == 7 and rng.random() < 0.1:
            whole = rng.choice("ax_-=") * want + word()
        if any(x.isalpha() for x in whole) and len(whole) >= LEAST and "=" not in whole:
            out.append(whole)
    return out


_NULL: dict = {}


def ordinary_shares(spark: SparkSession) -> np.ndarray:
    """For each class and bin the share of ordinary names that look at least as random.

    Shares below a few names are carried on by a normal curve through the logarithms of the names' bins.
    """
    if "shares" not in _NULL:
        table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}')" for d in decoys()) + " AS s(text)")
        got = np.array([(s["cls"], s["bin"]) for r in table.select(scored(candidates(F.col("text"), F.lit(True))).alias("s")).collect() for s in r["s"]])  # one a decoy
        shares = np.ones((len(CLASSES), BINS))
        for k in range(len(CLASSES)):
            own = np.sort(got[got[:, 0] == k, 1])
            logs = np.log(own + 1.0)
            mean, spread = logs.mean(), max(logs.std(), 0.1)
            for b in range(BINS):
                below = np.searchsorted(own, b, side="right")
                curve = 0.5 * math.erfc((mean - math.log(b + 1.0)) / spread / math.sqrt(2))
                shares[k, b] = below / len(own) if below >= 10 else max(curve, below / len(own))
        _NULL["shares"] = shares
    return _NULL["shares"]


def cutoffs(found: DataFrame, column: str = "found", false: float = FALSE) -> list[int]:
    """For each class of lengths the last bin that is taken, -1 where none is: one pass over the candidates."""
    counts = np.zeros((len(CLASSES), BINS))
    each = found.select(F.explode(F.transform(plain(column), lambda s: s["cls"] * BINS + s["bin"])).alias("at")).groupBy("at").count()
    for r in each.collect():  # at most a row a class and bin
        counts.flat[r["at"]] = r["count"]
    return loosest(counts, ordinary_shares(found.sparkSession), false)


def loosest(counts: np.ndarray, shares: np.ndarray, false: float) -> list[int]:
    taken = counts.cumsum(axis=1)
    good = (taken > 0) & (shares * taken[:, -1:] <= false * taken)
    return [int(np.flatnonzero(g).max()) if g.any() else -1 for g in good]


def _selected(found: Column, last: list[int]) -> Column:
    most = F.array(*map(F.lit, last))
    good = F.filter(found, lambda s: s["bin"] <= F.get(most, s["cls"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), s["end"].alias("end")))


def _measured(docs: DataFrame, text: str, base: str, found: str) -> DataFrame:
    whole = F.coalesce(plain(text), F.lit(""))
    proposed, long_run = absent([*docs.columns, base, found], "proposed", "long_run")
    out = docs.withColumn(long_run, has_long_run(whole))
    out = out.withColumn(base, base_spans(whole, plain(long_run))).withColumn(proposed, candidates(whole, plain(long_run)))
    free = F.when(F.size(plain(proposed)) > 0, scored(sp.apart(plain(proposed), plain(base)))).otherwise(F.array().cast(SCORED))
    short = F.transform(plain(base), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return out.withColumn(found, free).withColumn(base, short).drop(proposed, long_run)


def _all_spans(base: str, found: str, last: list[int]) -> Column:
    return F.array_sort(F.concat(plain(base), _selected(plain(found), last)))


def find(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with two columns of spans, (start, kind, end) sorted by start and kind: base ones, and all.

    The texts are read twice: once for the cutoffs over all rows, once for the spans.
    """
    (found,) = absent([*docs.columns, base, spans], "found")
    last = cutoffs(_measured(docs.select(plain(text)), text, *absent([text], "base", "found")[:1], found), found)
    return _measured(docs, text, base, found).withColumn(spans, _all_spans(base, found, last)).drop(found)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, their digest, and all spans. Texts are read once, spans are written between."""
    got = written(_measured(docs.select("doc_id", "text"), "text", "base", "found").drop("text"), "secrets")
    last = cutoffs(got)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS[:3])]
    return got.select("doc_id", *counts, F.sha2(sp.listed(F.col("base"), KINDS), 256).alias("base_sha256"), sp.listed(_all_spans("base", "found", last), KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; all columns stay."""
    base, spans = absent(docs.columns, "base", "spans")
    found = find(docs, text, base, spans)
    return found.withColumn(text, sp.replaced(plain(text), plain(spans), F.array(*map(F.lit, KINDS)))).select(*map(plain, docs.columns))
