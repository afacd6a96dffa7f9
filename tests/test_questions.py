"""Stems, postings, lexicons, likeness, sampling and the breaker on rows made for them, against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.functions.stem import stem
from folioscope.operators import lexicon, postings, profile, sampling, similar
from folioscope.operators.questions import STOP
from folioscope.streaming import streams

PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
}


def test_stems_of_the_published_examples(spark):
    rows = spark.createDataFrame([(w,) for w in PORTER], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == PORTER


def plain_search(docs, question, k):
    """AND and phrase search with scores by plain Python; words are their own stems here."""
    words = lambda t: [(n, w) for n, w in enumerate(re.findall("[a-z0-9]+", (t or "").lower())) if len(w) >= 2 and w not in STOP]
    index, size = defaultdict(lambda: defaultdict(list)), defaultdict(int)
    for d, title, text in docs:
        for field, t in enumerate((title, text)):
            for n, w in words(t):
                index[w, field][d].append(n)
                size[d, field] += 1
    mean = [sum(size[d, f] for d, *_ in docs) / len(docs) for f in (0, 1)]
    import math

    idf = lambda w, f: math.log(len(docs) / (len(index[w, f]) + 1)) + 1
    part = lambda i, n, d, f: i * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[d, f] / mean[f]))
    asked, out = words(question), {}
    for d, *_ in docs:
        if question.startswith('"'):
            s = 0
            for f in (0, 1):
                starts = set.intersection(*({p - n for p in index[w, f].get(d, [])} for n, w in asked)) if asked else set()
                if starts:
                    s += part(sum(idf(w, f) for _, w in asked), len(starts), d, f)
            if s:
                out[d] = s
        elif asked and all(any(d in index[w, f] for f in (0, 1)) for _, w in asked):
            out[d] = sum(part(idf(w, f), len(index[w, f][d]), d, f) for w in {w for _, w in asked} for f in (0, 1) if d in index[w, f])
    return sorted((-round(s, 4), d) for d, s in out.items())[:k]


def test_postings_by_plain_search(spark):
    rng = random.Random(4)
    vocab = ["alpha", "bravo", "kilo", "lima", "the", "november", "x", "zulu", "romeo"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(rng.randint(0, n)))
    docs = [(k, text(4), text(30)) for k in range(60)] + [(100, None, None), (101, "", "alpha bravo " * 500)]
    questions = ["alpha", "alpha bravo", "zulu kilo lima", '"alpha bravo"', '"kilo the zulu"', '"lima lima"', "missing alpha", "the x", "", "romeo romeo"]
    df = spark.createDataFrame(docs, "doc_id long, title string, text string").repartition(3)
    own = postings.index(df, "doc_id", [F.col("title"), F.col("text")])
    asked = spark.createDataFrame(list(enumerate(questions)), "qid int, q string")
    found = postings.search(own, asked, "qid", "q", 7)
    got = defaultdict(list)
    for r in found.collect():
        got[r.qid].append((-r.score, r.doc_id))
    for n, q in enumerate(questions):
        want = plain_search(docs, q, 7)
        assert sorted(s for s, _ in got[n]) == pytest.approx([s for s, _ in want], abs=2e-4) and (not want or want[0][1] in {d for _, d in got[n]}), q
    one = postings.search(own, asked.filter("qid = 0"), "qid", "q", 3)
    assert one.count() == 3


def test_a_lexicon_is_found_as_contains_finds_it(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcé _9") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    terms = {"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {""}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(3)
    rows = spark.createDataFrame([(t,) for t in terms] * 2, "term string")
    inside = lambda c: c.isalnum() or c == "_"
    edged = lambda t, x: any(not (m.start() and inside(t[m.start() - 1])) and not (m.start() + len(x) < len(t) and inside(t[m.start() + len(x)])) for m in re.finditer(f"(?={re.escape(x)})", t))
    for size in (100_000, 30):
        monkeypatch.setattr(lexicon, "TERMS", size)
        got = [tuple(r) for r in lexicon.hits(docs, rows, "doc_id", "t").collect()]
        want = {(d, x) for d, t in enumerate(texts) for x in terms if t and x and x in t}
        assert len(got) == len(want) and set(got) == want
        assert {tuple(r) for r in lexicon.hits(docs, rows, "doc_id", "t", edges=True).collect()} == {(d, x) for d, t in enumerate(texts) for x in terms if t and x and edged(t, x)}


def test_no_likeness_is_lost(spark):
    rng = random.Random(5)
    rows = [(k, k, rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(0, 12))) for k in range(150)]
    got = {(r.id, r.earlier) for r in similar.held_by_earlier(spark.createDataFrame(rows, "id long, place long, w array<string>"), "id", "place", "w").collect()}
    want = {}
    for k, _, w in rows:
        for j, _, v in rows[:k]:
            if w and len(set(w) & set(v)) / len(set(w)) > 0.7:
                want.setdefault(k, j)
    assert got == set(want.items()) and want


def test_samples_keep_to_their_budget(spark):
    rng = random.Random(6)
    lines = lambda n: "\n".join(rng.choice(["plain words here", "the reserve standard", "SECTION OF CAPITALS", "3. numbered", "", "other %d" % rng.randrange(99)]) for _ in range(n))
    texts = [lines(n) for n in (1, 5, 9, 10, 40, 200, 3000)] + ["one line " * 900, None]
    got = {r.doc_id: r.sample for r in sampling.sampled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 900).collect()}
    for k, t in enumerate(texts):
        if len(t or "") <= 900:
            assert got[k] == (t or "")
        else:
            assert len(got[k]) <= 900 + 4 * len("...[TRIMMED]") + 3 * len(sampling.CUT) and got[k].startswith(sampling.CUT)
            kept = set(got[k].replace("...[TRIMMED]", "").split("\n"))
            assert sum(x in set(t.split("\n")) or "===" in x or any(y.startswith(x) for y in t.split("\n")) for x in kept) == len(kept)


def plain_breaker(calls, threshold, wait):
    state, n, last, out = "CLOSED", 0, 0, []
    for at, event, ok in calls:
        if state == "OPEN" and at - last <= wait:
            out.append((event, state, True))
            continue
        if state == "OPEN":
            state = "HALF_OPEN"
        if ok:
            state, n = ("CLOSED", 0) if state == "HALF_OPEN" else (state, n)
        else:
            n, last = n + 1, at
            state = "OPEN" if n >= threshold else state
        out.append((event, state, False))
    return out


def test_the_breaker_over_many_batches_and_late_calls(spark, tmp_path):
    rng = random.Random(8)
    calls = sorted((rng.randrange(40 * 86_400), k, rng.choice(["error", "view", "view"]), rng.randrange(4)) for k in range(600))
    schema = "s long, event_id long, event_type string, user_id long"
    for part in range(6):
        rows = spark.createDataFrame(calls[part * 100 : part * 100 + 100], schema).select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "user_id")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    late = spark.createDataFrame([(60, 9999, "error", 1)], schema).select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "user_id")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    own = streams.breaker_states(streams.read_events(spark, f"{tmp_path}/events", "*.parquet"), ["error"], 3, "6 hours", "1 hour")
    got = defaultdict(set)
    for r in streams.finished(own, f"file://{tmp_path}").collect():
        got[r.user_id].add((r.event_id, r.state, r.blocked))
    for u in range(4):
        assert got[u] == set(plain_breaker([(s * 1_000_000, e, kind != "error") for s, e, kind, who in calls if who == u], 3, 6 * 3_600_000_000))
    assert any(b for rows in got.values() for _, _, b in rows) and not any(e == 9999 for rows in got.values() for e, _, _ in rows)


def test_days_close_by_watermark_and_leave_the_state(spark, tmp_path):
    rows = [(day * 86_400 + k * 60, day * 10 + k, "view", 1) for day in range(8) for k in range(5)]
    for part in range(8):
        one = spark.createDataFrame(rows[part * 5 : part * 5 + 5], "s long, event_id long, event_type string, user_id long")
        one.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "user_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    late = spark.createDataFrame([(30, 999, "view", 1)], "s long, event_id long, event_type string, user_id long")
    late.select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "user_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    own = streams.daily_counts(streams.read_events(spark, f"{tmp_path}/events", "*.parquet"), "1 day").withColumn("day", F.to_date("start"))
    closed, state = streams.closed_and_open(own, f"file://{tmp_path}", "day")
    done = {(str(r.day), r.n) for r in closed.collect()}
    left = {(str(r.day), r.n) for r in state.select(F.to_date("key.window.start").alias("day"), F.col("value.count").alias("n")).collect()}
    days = [f"1970-01-0{d + 1}" for d in range(8)]
    assert done == {(d, 5) for d in days[:6]} and left == {(d, 5) for d in days[6:]}  # the late row counts nowhere
    assert "day=1970-01-01" in " ".join(r.path for r in closed.select(F.input_file_name().alias("path")).distinct().collect())


def test_quartiles_of_sketches(spark):
    df = spark.range(100_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("v"), F.when(F.col("id") < 0, 1).alias("none"), F.lit("x").alias("w"))
    got = {r.name: r for r in profile.profile(df).collect()}
    assert abs(got["v"].quarter - 25) < 1.5 and abs(got["v"].half - 50) < 1.5 and abs(got["v"].three_quarters - 75) < 1.5
    assert got["none"].n == 0 and got["none"].half is None and (got["w"].n_unique, got["w"].top, got["w"].freq) == (1, "x", 100_000)


def test_numbers_and_lags_of_sparse_ids(spark):
    from folioscope.operators import ingest

    rng = random.Random(9)
    ids = sorted({rng.randrange(-(2**62), 2**62) for _ in range(400)})
    rows = [(k, "hot" if n % 3 else "cold", n) for n, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, g string, n int").repartition(4)
    got = {r.id: r.i for r in ingest.numbered(df, "g", "id", "i").collect()}
    lag = {r.id: r.before for r in ingest.lagged(df, "g", "id", ["n"], "old").select("id", F.col("old.n").alias("before")).collect()}
    for g in ("hot", "cold"):
        own = [(k, n) for k, h, n in rows if h == g]
        assert [got[k] for k, _ in own] == list(range(1, len(own) + 1))
        assert [lag[k] for k, _ in own] == [None, *(n for _, n in own[:-1])]
