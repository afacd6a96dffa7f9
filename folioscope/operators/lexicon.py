"""Lexicons as tables: all terms in one automaton, every text read once.

The terms are compiled to one Aho-Corasick automaton, so a lexicon of ten thousand terms costs about as much as one of a
hundred: a text is gone through once, sign by sign, whatever the terms. Terms are counted before they are sent to the
tasks; beyond ``TERMS`` they are taken in sets by a hash, a pass over the texts each.

A term is found anywhere, as ``contains`` finds it, or with ``edges`` only where no letter, digit or underscore stands before
or after it. Case is the caller's: lower both sides. Null texts hold nothing; empty terms are left out; repeated terms count
once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms that are sent to every task at once.
TERMS = 100_000


def hits(docs: DataFrame, lexicon: DataFrame, key: str, text: str, edges: bool = False) -> DataFrame:
    """(key, term): the terms of ``lexicon`` (term) that each row of ``docs`` holds, each once a row."""
    terms = lexicon.select("term").filter(F.col("term") != "").distinct()
    sets = max(1, math.ceil(2 * terms.count() / TERMS))
    found = None
    for k in range(sets if sets > 1 else 1):
        own = terms if sets == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(sets)) == k)
        part = _found(docs, own.toArrow()["term"].to_pylist(), key, text, edges)
        found = part if found is None else found.unionByName(part)
    return found


def _found(docs: DataFrame, terms: list[str], key: str, text: str, edges: bool) -> DataFrame:
    terms = sorted(terms)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, term string"

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for n, t in enumerate(terms):
            automaton.add_word(t, n)
        automaton.make_automaton()
        names = pa.array(terms, pa.string())
        inside = lambda c: c.isalnum() or c == "_"
        for batch in batches:
            at, own = [], []
            for row, t in enumerate(batch.column(1)):
                t = t.as_py()
                if not t or not terms:
                    continue
                if edges:
                    held = {n for end, n in automaton.iter(t) if not (end + 1 < len(t) and inside(t[end + 1])) and not (end >= len(terms[n]) and inside(t[end - len(terms[n])]))}
                else:
                    held = {n for _, n in automaton.iter(t)}
                at += [row] * len(held)
                own += sorted(held)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), names.take(pa.array(own, pa.int64()))], names=[key, "term"])

    return docs.select(key, text).mapInArrow(run, schema)


def categories(docs: DataFrame, lexicon: DataFrame, key: str, text: str, edges: bool = False) -> DataFrame:
    """(key, category, score): the weights of the terms (term, category, weight) that a row holds, as a share of its best."""
    found = hits(docs, lexicon, key, text, edges).join(lexicon, "term")
    points = found.groupBy(key, "category").agg(F.sum("weight").alias("points"))
    return points.withColumn("score", F.col("points") / F.max("points").over(Window.partitionBy(key))).drop("points")
