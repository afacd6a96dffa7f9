"""Frequent phrases, co-occurrence, exclusion and entropy of concepts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Words that begin or end no phrase.
STOP = ("the", "and", "for", "are", "with", "that", "this", "was", "from", "der", "die", "und", "les", "des", "est", "que", "los", "las", "una")


def kept_tokens(c: Column) -> Column:
    """Tokens of more than two signs that are no stop words."""
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*STOP))


def ngrams(docs: DataFrame, n: int, least: int = 3) -> DataFrame:
    """(phrase, freq, n_docs) of n kept tokens in a row that occur at least ``least`` times.

    Repeats within a document are counted where its words lie: sorted, equal phrases stand side by side. One shuffle
    by phrase, with partial sums, is left.
    """
    own = docs.filter("text is not null").select(kept_tokens(F.col("text")).alias("t"))  # a filter on the words would split the texts twice
    p = own.select(F.array_sort(F.transform(F.slice("t", F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(0))), lambda x, k: F.concat_ws(" ", x, *[F.get("t", k + i) for i in range(1, n)]))).alias("p"))
    last = F.filter(F.transform("p", lambda x, k: F.when(F.get("p", k + 1).eqNullSafe(x), -1).otherwise(k)), lambda k: k >= 0)
    runs = p.select("p", last.alias("l")).select(F.inline(F.transform("l", lambda k, i: F.struct(F.get("p", k).alias("phrase"), (k - F.when(i == 0, -1).otherwise(F.get("l", i - 1))).alias("f")))))
    return runs.groupBy("phrase").agg(F.sum("f").alias("freq"), F.count("*").alias("n_docs")).filter(F.col("freq") >= least)


def concept_flags(docs: DataFrame, concepts: list[str]) -> DataFrame:
    """(doc_id, found): the concepts (single tokens) of each document, sorted."""
    own = F.array_sort(F.array_intersect(tokens(F.col("text")), F.array(*map(F.lit, concepts))))
    return docs.select("doc_id", own.alias("found"))


def pair_counts(flags: DataFrame) -> DataFrame:
    """(a, b, n): in how many documents each pair of concepts (a < b) occurs together."""
    pairs = F.flatten(F.transform("found", lambda x: F.transform(F.filter("found", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return flags.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


def exclusion(flags: DataFrame, concepts: list[str], critical: float = 3.84) -> DataFrame:
    """For each pair of concepts: observed and expected documents, chi-square with correction, how far they exclude each other.

    One pass counts the concepts and their pairs; what comes out has as many rows as there are pairs of concepts.
    """
    names = sorted(concepts)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    has = lambda x: F.array_contains("found", x)
    counted = flags.agg(F.count("*").alias("n"), *[F.count_if(has(x)).alias(f"c_{x}") for x in names], *[F.count_if(has(a) & has(b)).alias(f"p_{a}_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{a}").alias("na"), F.col(f"c_{b}").alias("nb"), F.col(f"p_{a}_{b}").alias("nab")) for a, b in pairs]))
    t = counted.select("n", rows.alias("r")).select("n", "r.*").filter((F.col("na") > 0) & (F.col("nb") > 0) & (F.col("na") < F.col("n")) & (F.col("nb") < F.col("n")))
    n, na, nb, nab = (F.col(c).cast("double") for c in ("n", "na", "nb", "nab"))
    expected = na * nb / n
    ad_bc = F.abs(nab * (n - na - nb + nab) - (na - nab) * (nb - nab))
    chi = n * F.pow(F.greatest(F.lit(0.0), ad_bc - n / 2), F.lit(2)) / (na * nb * (n - na) * (n - nb))
    ratio = F.greatest(F.lit(0.0), expected - nab) / F.greatest(F.lit(1.0), expected)
    return t.select("a", "b", F.col("nab").alias("observed"), F.round(expected, 4).alias("expected"), F.round(chi, 4).alias("chi_square"), F.round(F.when(chi >= critical, ratio).otherwise(ratio * 0.5), 4).alias("exclusion"))


def entropy(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, entropy): Shannon entropy in bits of the shares of a key's values, over its largest possible."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    each = n.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    bits = F.log2("total") - F.col("s") / F.col("total")
    return each.select(key, F.col("k").alias("n_values"), F.round(F.when(F.col("k") > 1, bits / F.log2("k")).otherwise(0.0), 6).alias("entropy"))


#: Logarithms of the factorials of 0 to 50.
_LOG_FACTORIALS = [math.lgamma(n + 1) for n in range(51)]


def fisher_p(n: Column, na: Column, nb: Column, nab: Column) -> Column:
    """Two-sided p of Fisher's exact test for at most 50 rows: all tables with these margins that are no likelier."""
    table = F.array(*map(F.lit, _LOG_FACTORIALS))
    lf = lambda c: F.get(table, c.cast("int"))
    fixed = lf(na) + lf(n - na) + lf(nb) + lf(n - nb) - lf(n)
    chance = lambda k: F.exp(fixed - lf(k) - lf(na - k) - lf(nb - k) - lf(n - na - nb + k))
    every = F.transform(F.sequence(F.greatest(F.lit(0).cast("long"), na + nb - n), F.least(na, nb)), chance)
    return F.least(F.lit(1.0), F.aggregate(F.filter(every, lambda p: p <= chance(nab) * (1 + 1e-7)), F.lit(0.0), lambda a, p: a + p))


def exclusion_within(rows: DataFrame, group: str, found: str, least: int = 5, critical: float = 3.84, significance: float = 0.05, keep: float = 0.1) -> DataFrame:
    """(group, a, b, observed, expected, chi_square, p, exclusion): pairs of concepts that keep apart within a group.

    ``found`` holds the concepts of a row. Groups of fewer than 50 rows are tested exactly, others by chi-square with
    correction (``p`` is null there); a pair must occur in ``least`` rows, and its exclusion reach beyond ``keep``.
    """
    own = rows.select(group, F.array_sort(F.array_distinct(found)).alias("f"))
    total = own.groupBy(group).agg(F.count("*").alias("n"))
    ones = own.select(group, F.explode("f").alias("c")).groupBy(group, "c").agg(F.count("*").alias("k"))
    pairs = F.flatten(F.transform("f", lambda x: F.transform(F.filter("f", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = own.select(group, F.inline(pairs)).groupBy(group, "a", "b").agg(F.count("*").alias("nab"))
    left, right = ones.select(group, F.col("c").alias("a"), F.col("k").alias("na")), ones.select(group, F.col("c").alias("b"), F.col("k").alias("nb"))
    t = left.join(right, group).filter("a < b").join(both, [group, "a", "b"], "left").join(total, group).fillna(0, ["nab"])
    t = t.filter((F.col("na") + F.col("nb") - F.col("nab") >= least) & (F.col("na") < F.col("n")) & (F.col("nb") < F.col("n")))
    n, na, nb, nab = (F.col(c).cast("double") for c in ("n", "na", "nb", "nab"))
    expected = na * nb / n
    chi = n * F.pow(F.greatest(F.lit(0.0), F.abs(nab * (n - na - nb + nab) - (na - nab) * (nb - nab)) - n / 2), F.lit(2)) / (na * nb * (n - na) * (n - nb))
    small = F.col("n") < 50
    p = F.when(small, fisher_p(F.col("n"), F.col("na"), F.col("nb"), F.col("nab")))
    t = t.withColumns({"expected": expected, "chi_square": F.when(small, 0.0).otherwise(chi), "p": p})
    sure = F.when(small, F.col("p") < significance).otherwise(F.col("chi_square") >= critical)
    ratio = F.greatest(F.lit(0.0), F.col("expected") - F.col("nab")) / F.greatest(F.lit(1.0), F.col("expected"))
    out = t.withColumn("exclusion", F.least(F.lit(1.0), F.when(sure, ratio).otherwise(ratio * 0.5))).filter(F.col("exclusion") > keep)
    return out.select(group, "a", "b", F.col("nab").alias("observed"), F.round("expected", 4).alias("expected"), F.round("chi_square", 4).alias("chi_square"), F.round("p", 6).alias("p"), F.round("exclusion", 4).alias("exclusion"))
