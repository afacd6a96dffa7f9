"""Blocks of postings and many questions at once: against plain Python, in sets, with bounds of the first blocks, and how much is kept."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_questions import PORTER, plain_search

from folioscope.functions.stem import stem, stem_word
from folioscope.operators import postings


def test_plain_stems_are_those_of_the_column(spark):
    rng = random.Random(3)
    ends = ["", "s", "es", "ies", "ed", "ing", "eed", "ational", "ization", "fulness", "icate", "ement", "ion", "tion", "sion", "ll", "e", "y", "ly", "ated", "izing", "tted", "able"]
    made = {"".join(rng.choice("aeioubcdlstyx") for _ in range(rng.randint(0, 5))) + rng.choice(ends) for _ in range(3000)}
    words = sorted(made | set(PORTER) | {"ab1s", "running2", "äing", "a", ""})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: stem_word(w) for w in words}


@pytest.mark.parametrize("terms, first", [(500_000, 10_000), (7, 10_000), (500_000, 3), (40, 2)])
def test_many_questions_over_many_blocks(spark, monkeypatch, terms, first):
    rng = random.Random(terms + first)
    monkeypatch.setattr(postings, "BATCH_BYTES", "2k")
    monkeypatch.setattr(postings, "QUESTION_TERMS", terms)
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "PAIRS", 50)
    vocab = ["alpha", "bravo", "kilo", "lima", "the", "november", "x", "zulu", "romeo"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, n)))
    docs = [(k, text(4), text(30)) for k in range(150)] + [(k, "kilo", "alpha bravo kilo") for k in range(200, 230)] + [(500, None, None)]
    rng.shuffle(docs)
    quoted = lambda t: f'"{t}"' if rng.random() < 0.5 else t
    questions = [quoted(text(4)) for _ in range(60)] + ["alpha bravo"] * 9 + ["bravo alpha alpha", '"alpha bravo kilo"', '"kilo"', '"the kilo x lima"', "nowhere kilo", "", None]
    df = spark.createDataFrame(docs, "doc_id long, title string, text string").repartition(5)
    own = postings.index(df, "doc_id", [F.col("title"), F.col("text")])
    assert own.n_blocks > 5
    asked = spark.createDataFrame(list(enumerate(questions)), "qid int, q string")
    got = defaultdict(list)
    for r in postings.search(own, asked, "qid", "q", 6).collect():
        got[r.qid].append((-r.score, r.doc_id))
    for n, q in enumerate(questions):
        want = plain_search(docs, q, 1000) if q else []
        scores = dict((d, s) for s, d in want)
        assert sorted(s for s, _ in got[n]) == pytest.approx([s for s, _ in want[:6]], abs=2e-4), q
        assert all(scores[d] == pytest.approx(s, abs=2e-4) for s, d in got[n]), q
    # Of 30 equal documents the first by key.
    n = questions.index('"alpha bravo kilo"')
    assert not (held := [d for _, d in got[n] if 200 <= d < 230]) or sorted(held) == list(range(200, 200 + len(held)))


def test_keys_of_text_and_null_keys(spark):
    docs = [("b", "alpha kilo"), (None, "alpha kilo"), ("a", "alpha kilo"), ("c", "zulu")]
    own = postings.index(spark.createDataFrame(docs, "name string, text string").coalesce(1), "name", [F.col("text")])
    asked = spark.createDataFrame([(1, "alpha"), (2, '"alpha kilo"'), (3, "kilo alpha")], "qid int, q string")
    got = defaultdict(list)
    for r in postings.search(own, asked, "qid", "q", 5).orderBy("qid", "name").collect():
        got[r.qid].append(r.name)
    assert own.n_docs == 4 and dict(got) == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"]}


def test_neither_words_nor_questions_become_rows(spark):
    """The index once had a row for each word of a document, and equal questions were searched each."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("alpha bravo kilo lima zulu").alias("text"))
    own = postings.index(docs.coalesce(2), "doc_id", [F.col("text")])
    assert spark.read.parquet(own.path).count() <= 4
    asked = spark.range(500).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, "bravo alpha").otherwise("alpha bravo alpha").alias("q"))
    assert postings.searches(asked, "qid", "q").select("search").distinct().count() == 1
    found = postings.search(own, asked, "qid", "q", 3)
    assert found.count() == 1500 and [r.doc_id for r in found.filter("qid = 7").orderBy("doc_id").collect()] == [0, 1, 2]


def test_no_documents_and_no_questions(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha")], "qid int, q string")
    for docs, q in ((none, asked), (one, asked.filter("qid > 1")), (one, asked.withColumn("q", F.lit("the")))):
        assert postings.search(postings.index(docs, "doc_id", [F.col("text")]), q, "qid", "q", 3).count() == 0


def test_texts_of_questions_are_worked_out_once(spark):
    """A filter on the words of a question once made Spark rewrite it again for each place that the rewriting is used in."""
    from folioscope.operators import questions as ask

    p = ask.parsed(spark.createDataFrame([("q1", "the reserve of the premium")], "qid string, query string"))
    rows = p.withColumn("focused", ask.focused(F.col("query"), F.col("phrases"), F.col("keywords"))).select("qid", "focused")
    plan = postings.searches(rows, "qid", "focused")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\p{L}\\p{N}_]+") == 1


def test_tiered_retrieval_joins_no_texts(spark):
    from folioscope.plans import concepts, questions

    a, b = concepts.CONCEPTS[:2]
    docs = spark.createDataFrame([(1, f"x{a.upper()}y {b}"), (2, None), (3, "")], "doc_id long, text string")
    got = questions._concepts_held(docs)
    assert got.columns == ["doc_id", "held"]
    held = {r.doc_id: set(r.held) for r in got.collect()}
    assert {a, b} <= held[1] and held[2] == held[3] == set()


def test_an_index_is_made_without_a_shuffle(spark):
    """What all searches took longest for: a shuffle of all words, and stems worked out twice by the ranges of a sort."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("alpha bravo kilo").alias("text")).coalesce(1)
    own = postings.index(docs, "doc_id", [F.col("text")])
    assert own.mean == [3.0] and spark.read.parquet(own.path).rdd.getNumPartitions() == 1 and "bucket" not in own.schema.names
