"""Ranked search and resampling against plain Python, the registered queries as they ship, and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import EXTRA, ROWS

from folioscope.llm import queries, resampling, term_index, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM, WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute_ranks(docs, items, k):
    """(item, rank, doc, score) as the contract words it; ``docs`` and ``items`` are lists of (id, text)."""
    counts = [Counter(terms(t)) for _, t in docs]
    length = [sum(c.values()) for c in counts]
    n, total, df = sum(x > 0 for x in length), sum(length), Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (d, _), c, own in zip(docs, counts, length):
            s = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * own * n) // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made_texts(rng, n, vocabulary=60):
    vocab = ["w%d" % k for k in range(vocabulary)] + ["Ünï", "日本", "x_y"]
    return [" ".join(vocab[min(int(rng.expovariate(0.15)), len(vocab) - 1)] for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(params=[(128, 8_000_000), (3, 600)])
def small(request, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", request.param[0])
    monkeypatch.setattr(term_index, "SHARD_BYTES", request.param[1])
    return request.param


def test_ranks_by_brute_force_over_shards_and_blocks(spark, small):
    rng = random.Random(small[0])
    docs = list(enumerate(made_texts(rng, 300))) + [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2 w3 w40"), (900, None), (901, "..."), (902, "w7 " * 3000)]
    items = list(enumerate(made_texts(rng, 25))) + [(100, None), (101, "nowhere"), (102, "w1 w1 W1 w2"), (None, "w1")]
    postings = term_index.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = term_index.search(spark.createDataFrame(items, "item_id long, text string"), postings, k=4)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_ranks(docs, [i for i in items if i[0] is not None], 4)


def test_question_sets_beyond_the_limit_are_parted(spark, monkeypatch):
    monkeypatch.setattr(term_index, "QUESTION_ROWS", 40)
    rng = random.Random(1)
    docs, items = list(enumerate(made_texts(rng, 60))), list(enumerate(made_texts(rng, 12)))
    postings = term_index.index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = term_index.search(spark.createDataFrame(items, "item_id long, text string"), postings, k=3)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_ranks(docs, items, 3)


def test_blocks_below_the_threshold_stay_packed():
    rng = np.random.default_rng(0)
    docs = np.arange(64 * 128)
    count = np.ones(len(docs), dtype=np.int64)
    count[5000:5010] = 40  # one block holds all the best documents
    length = np.full(len(docs), 50)
    starts = np.arange(0, len(docs), 128)
    gaps = np.where(np.arange(len(docs)) % 128 == 0, 0, 1)
    made = [term_index.packed(gaps, starts), term_index.packed(count, starts), term_index.frontiers(count, length, starts)]
    parts = [[bytes(d[a:b]) for a, b in zip(o, o[1:])] for d, o in made]
    shard = term_index.Shard(np.zeros(64, dtype=np.int64), docs[starts], docs[starts + 127], *parts, length, 8192, int(length.sum()))
    doc, score = shard.best(np.array([0]), np.array([7]), 0, 10, rng.permutation(len(docs)))
    assert set(doc) == set(range(5000, 5010)) and len(shard.open) <= term_index.OPEN
    assert shard.best(np.array([0]), np.array([7]), int(score.max()) + 1, 10, docs)[0].size == 0


def test_packing_round_trip_and_frontiers():
    rng = np.random.default_rng(2)
    values, starts = rng.integers(0, 10 ** rng.integers(1, 8, 500)), np.array([0, 1, 7, 200, 499])
    data, offsets = term_index.packed(values, starts)
    assert np.concatenate([term_index.unpacked(bytes(data[a:b])) for a, b in zip(offsets, offsets[1:])]).tolist() == values.tolist()
    count, length = rng.integers(1, 9, 500), rng.integers(1, 30, 500)
    data, offsets = term_index.frontiers(count, length, starts)
    for a, b, lo, hi in zip(starts, [*starts[1:], 500], offsets, offsets[1:]):
        own = {(int(c), int(n)) for c, n in zip(count[a:b], length[a:b])}
        best = {p for p in own if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in own)}
        assert set(map(tuple, np.frombuffer(bytes(data[lo:hi]), dtype="<u4").reshape(-1, 2).tolist())) == best


def test_op11_gives_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES["op11_block_max_wand"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    out = con.sql(queries.ORACLE["op11_block_max_wand"])
    assert sorted(map(tuple, df.select(*out.columns).collect())) == sorted(out.fetchall())


def test_ranked_search_on_odd_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for c in [*EXTRA, "shard", "term", "block", "rank"]:
        docs = docs.withColumn(c, F.lit("extra"))
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "score", "term", "rank")
    rows = [(d, t) for d, t, _ in ROWS]
    got = term_index.search(items, term_index.index(docs), k=10).select("item_id", "rank", "doc_id", "score").collect()
    want = brute_ranks(rows, list(dict(r for r in rows if r[0] is not None).items()), 10)
    # Items that are given twice count their terms twice.
    assert {r[:3] for r in map(tuple, got) if r[0] != 4} == {r[:3] for r in want if r[0] != 4}
    assert term_index.search(items, term_index.index(docs.filter("false"))).count() == 0
    assert term_index.search(items.filter("false"), term_index.index(docs)).count() == 0


# --- 13 ---------------------------------------------------------------------------------------------------------------


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[k : k + g]).encode()) % 10000 for g in (1, 2, 3) for k in range(len(w) - g + 1)]


def brute_resampled(docs, target, percent=5, least=20):
    made, wanted = [(d, *grams(t)) for d, t in docs], [grams(t)[1] for t in target]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for f in wanted for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    long_enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = long_enough[: percent * len(long_enough) // 100]
    ranks = {}
    for k, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(k)
    return sorted(((*r[:4], ranks[r].pop(0) if ranks.get(r) else None) for r in rows), key=repr)


@pytest.mark.parametrize("block, run", [(4_000_000, 1 << 20), (300, 7)])
def test_resampling_by_brute_force(spark, monkeypatch, block, run):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    monkeypatch.setattr(resampling, "RUN", run)
    rng = random.Random(block)
    docs = list(enumerate(made_texts(rng, 150, 400))) + [(d, t) for d, t, _ in ROWS] + [(7000, "Ab aB_c " * 30_000), (7001, "a"), (7002, "a b")]
    target = made_texts(rng, 10) + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("extra")).withColumn("part", F.lit(1)).repartition(3)
    wanted = spark.createDataFrame(list(enumerate(target)), "doc_id long, text string")
    got = resampling.resample(df, wanted, percent=40, least_words=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resampled(docs, target, 40, 3)


def test_op13_by_brute_force_on_the_smallest_tables(spark):
    con = duckdb.connect()
    docs = con.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    target = [r[0] for r in con.sql("SELECT text FROM '/root/testdata/sf0.001/benchmark.parquet'").fetchall()]
    df = queries.QUERIES["op13_importance_resampling"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, df.collect()), key=repr) == brute_resampled(docs, target)


def test_resampling_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    none = some.filter("false")
    assert resampling.resample(none, some).count() == 0
    assert [tuple(r) for r in resampling.resample(some, none, 100).collect()] == brute_resampled([(1, "a b c " * 30)], [], 100)


def test_gaps_round_trip_and_words():
    rng = np.random.default_rng(6)
    text, bucket = np.sort(rng.integers(0, 9, 4000)), rng.integers(0, 10_000, 4000)
    text[text == 4] = 3  # a text without features
    data, offsets = resampling.as_gaps(text.copy(), bucket, 10)
    own, back = resampling.from_gaps(data, offsets)
    assert sorted(zip(own.tolist(), back.tolist())) == sorted(zip(text.tolist(), bucket.tolist()))
    known = words.Dictionary()
    assert known("É ÀB ab aB_0 x".encode()).tolist() == [0, 1, 2, 2, 3, 4] and known(None).size == 0
    assert [w.decode() for w in known.words()] == ["É", "Àb", "ab", "0", "x"]


# --- 1, 7: bounded samples --------------------------------------------------------------------------------------------


def test_languages_beyond_the_bound_are_not_learned(spark, monkeypatch):
    from folioscope.llm import language_id

    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(k, "the cat and the dog sat there", "en") for k in range(30)] + [(100 + k, "le chat et le chien sont assis", "fr") for k in range(20)] + [(200 + k, "noise", f"dirt{k}") for k in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["en", "fr"] and model.predict("the dog and the cat")[0] == "en" and model.predict("le chien et le chat")[0] == "fr"


def test_a_small_share_of_labels_is_still_a_sample(spark):
    from folioscope.llm import toxicity

    rows = [(k, f"you {'zuppvile' if k % 3 == 0 else 'friendly'} person number {k} of the town", k % 3 == 0) for k in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, fit_rows=300)
    assert np.mean([(model.score([t])[0] >= 0.7) == y for _, t, y in rows[:200]]) > 0.95
