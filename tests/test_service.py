"""The service operators, document usage and the streams with state, on small rows against plain versions."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioscope.operators import layout, quality, service
from folioscope.plans import registry
from folioscope.streaming import streams

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Sixty events of three users in three files, in order of time over the files; user 1 has most of them."""
    import datetime as dt

    path, rows = str(tmp_path_factory.mktemp("events")), []
    for i in range(60):
        user = 1 if i % 2 else i % 3 + 1
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), user, "view" if i % 5 else "error", float(i), '{"k": %d}' % (i % 4)))
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events")
    return f"{path}/events", rows


def run(spark, path, stream, mode="append"):
    import tempfile

    return streams.finished(stream, "file://" + tempfile.mkdtemp(prefix="spark-"), mode).collect()


def read(spark, path):
    return streams.read_events(spark, path, "*.parquet")


def test_compressions_over_batches(spark, events):
    """State goes over the batches; a batch's files come in order of time, so ids do too."""
    path, rows = events
    got = sorted(tuple(r) for r in run(spark, path, streams.compressions(read(spark, path), 6, 0.5)))
    want, held, k = [], {}, {}
    for event, _, user, *_ in rows:
        own = held.setdefault(user, [])
        own.append(event)
        if len(own) >= 6:
            k[user] = k.get(user, 0) + 1
            want.append((user, k[user], own[0], own[2], 3))
            held[user] = own[3:]
    assert got == sorted(want) and len({u for u, *_ in got}) == 3


@pytest.mark.parametrize("hours", [5, 24, 1000])
def test_cached_requests_over_batches(spark, events, hours):
    """Hits are the same however the requests are dealt over batches, whether or not entries have left the state."""
    path, rows = events
    got = {r["event_id"]: r["hit"] for r in run(spark, path, streams.cached_requests(read(spark, path), ["user_id"], hours, "1 hour"))}
    put, want = {}, {}
    for event, at, user, *_ in rows:
        want[event] = user in put and (at - put[user]).total_seconds() <= hours * 3600
        if not want[event]:
            put[user] = at
    assert got == want and (hours == 5 or any(want.values()))


def test_learned_over_batches(spark, events):
    path, rows = events
    got = sorted(tuple(r) for r in run(spark, path, streams.learned(read(spark, path), ["event_type", "user_id"], 10.0)))
    assert got == sorted({(t, u) for _, _, u, t, v, _ in rows if v >= 10})


def test_upload_jobs(spark):
    rows = [(1, "a", True), (2, "a", False), (3, "a", True), (4, "a", False), (5, "b", True), (6, "c", False), (7, None, False)]
    got = {r[0]: tuple(r)[1:] for r in service.upload_jobs(spark.createDataFrame(rows, "job_id long, digest string, refused boolean")).collect()}
    assert got == {1: ("failed", None, None), 2: ("queued", None, 3), 3: ("completed", 2, 3), 4: ("completed", 2, 3), 5: ("failed", None, None), 6: ("queued", None, 1), 7: ("failed", None, None)}
    assert service.upload_jobs(spark.createDataFrame([], "job_id long, digest string, refused boolean")).count() == 0


def test_permissions_and_notes(spark):
    users = spark.createDataFrame([(1, True, False, None)], "user_id long, is_user boolean, can_upload boolean, is_admin boolean")
    assert {r["permission"] for r in service.granted(users).collect() if r["allowed"]} == {"view_responses", "submit_queries"}
    note = spark.range(1).select(*[c.alias(k) for k, c in service.file_notes(F.lit("A.PDF"), F.lit(1234567), F.lit("IFRS")).items()]).first()
    assert note["kind"].startswith("PDF (PDF document") and note["size"] == "1,234,567 bytes (1205.6 KB)"


def test_chart_texts(spark):
    text = spark.createDataFrame([("Revenue\nFY 23\nfy24\n0\n20\n90",), (None,), ("",)], "text string")
    kinds, *_ = text.select(layout.chart_kind(F.col("text")).alias("k")).collect()
    assert kinds["k"] == "bar"
    got = text.select(*[c.alias(k) for k, c in layout.chart_metadata(F.col("text")).items()]).collect()
    assert tuple(got[0]) == ("FY23,FY24,fy24", 20, 90, 1, "B")
    assert tuple(got[2]) == ("", 0, 0, 0, "")


def plain_usage(document, response, question):
    d, r = document.lower(), response.lower()
    score = 0.3 * sum(len(p) > 15 and p in r for p in re.findall(r"\b\w+(?:\s+\w+){2,}\b", d))
    for weight, pattern, a, b in (
        (0.2, r"\b(?:" + "|".join(quality.SHARED_TERMS) + r")\b", d, r),
        (0.15, r"\b\d+(?:\.\d+)?%?\b", d, r),
        (0.1, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}:", document, response),
    ):
        score += weight * len(set(re.findall(pattern, a)) & set(re.findall(pattern, b)))
    asked = [w for w in set(question.lower().split()) if len(w) > 3]
    score += 0.1 * min(sum(w in d for w in asked), sum(w in r for w in asked))
    alike = SequenceMatcher(None, d[:1000], r[:1000]).ratio() if d and r else 0.0
    return score + (0.2 * alike if alike > 0.1 else 0)


def test_document_usage(spark):
    rows = [
        ("Net Reserve: the premium of 12.5% is due, ééé ààà ôôô ûûû now. The premium of 12", "Net Reserve: the premium of 12.5% is due; ééé ààà ôôô ûûû now", "What premium is due now"),
        ("nothing alike", "0123456789", "question"), ("", "text", "text"), ("words " * 3000, "words " * 500, "words"), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "d string, r string, q string")
    got = [x[0] for x in df.select(quality.document_usage(F.col("d"), F.col("r"), F.col("q"))).collect()]
    assert got == pytest.approx([plain_usage(*[x or "" for x in row]) for row in rows])


def test_document_usage_query(spark):
    path = "/root/testdata/sf0.001"
    got = {(r["item_id"], r["doc_id"]): (r["usage"], r["used"]) for r in registry.QUERIES["document_usage"](spark, path).collect()}
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    b = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    want = {}
    for r in registry.QUERIES["term_overlap_topk"](spark, path).orderBy("item_id", F.desc("hits"), "doc_id").collect():
        item, doc = r["item_id"], r["doc_id"]
        want.setdefault(item, []).append((doc, plain_usage(d[doc], b[item], b[item].split("\n")[0])))
    flat = {}
    for item, docs in want.items():
        used = [x for x in docs if round(x[1], 6) > 0.1]
        flat |= {(item, doc): (u, True) for doc, u in used} if used else {(item, docs[0][0]): (docs[0][1], False)}
    assert got.keys() == flat.keys() and len(got) > 0
    assert all(got[k][0] == pytest.approx(u, abs=1e-5) and got[k][1] == used for k, (u, used) in flat.items())
