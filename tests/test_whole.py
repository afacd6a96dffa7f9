"""The queries named *_all do their job on every row of the tables."""

import re

import pytest

from folioscope.plans import registry


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


@pytest.fixture(scope="module")
def asked(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("asked"))
    write(spark, path, "benchmark", [(1, 'How does "fair value" follow the rules of ASC 944-40 in practice?'), (2, "rules of the reserve and the premium")], "item_id long, text string")
    write(spark, path, "conversations", [(1, 0, "user", "Rules of the reserve, and the premium!"), (1, 1, "assistant", "The GAAP reserve is 15%."), (2, 0, "user", "Should we ask for legal advice on this?")], "conv_id long, turn long, role string, text string")
    write(spark, path, "documents", [(1, "IFRS 17 contractual service margin international financial reporting " * 3), (2, "short"), (3, "the fair value of 944-40")], "doc_id long, text string")
    return path


def test_tags_of_all_rows(spark, asked):
    run = lambda name: {r["qid"]: r for r in registry.QUERIES[name](spark, asked).collect()}
    for name in ("compliance_gate_all", "query_tags_all", "domain_argmax_all", "critical_phrases_all", "query_weights_all", "processing_tier_all"):
        assert set(run(name)) == {"b1", "b2", "c1-0", "c2-0"}
    assert run("critical_phrases_all")["b1"]["quoted"] == "fair value"
    assert {k: r["tier"] for k, r in run("processing_tier_all").items() if k in ("b2", "c1-0")} == {"b2": "full", "c1-0": "cached"}
    assert run("message_entities_all")["1-1"]["entities"] == "calculation:reserve,percent:15%,regulation:GAAP"
    assert {k: r["framework"] for k, r in run("framework_detect_all").items()} == {1: "ifrs", 2: "general", 3: "general"}
    assert [(r["qid"], r["doc_id"]) for r in registry.QUERIES["relevance_rank_all"](spark, asked).collect()] == [(1, 3)]


def test_every_vector_query(spark, tmp_path):
    rows = [(k, [float(k % 7), float(k % 5), 1.0], k % 4) for k in range(1, 301)] + [(400, None, 1)]  # no row 0
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(q, v) for q in (100, 200, 300) for v in sorted(range(1, 301), key=lambda v: (-score(rows[q - 1][1], rows[v - 1][1]), v))[:10]}
    assert {(r["query_id"], r["vec_id"]) for r in registry.QUERIES["vector_topk_all"](spark, tmp_path).collect()} == want
    assert registry.QUERIES["vector_threshold_all"](spark, tmp_path).count() == 3 * 300
    assert {r["query_id"] for r in registry.QUERIES["alignment_aggregate_all"](spark, tmp_path).collect()} == {100, 200, 300}


def test_every_upload_is_looked_up(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (6, "c"), (5, "c"), (8, None), (10, None)]  # copies among odd ids, among even ids, an even id after an odd one
    write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["job"], r["duplicate"]) for r in registry.QUERIES["duplicate_uploads_all"](spark, tmp_path).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True), 4: (2, True), 5: (5, False), 6: (5, True), 8: (8, False), 10: (10, False)}


def test_audit_of_every_user(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-06 00:{k % 60:02}:00", 40 + k, "error") for k in range(30)], "event_id long, ts string, user_id long, event_type string")
    rows.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert [r["user_id"] for r in registry.QUERIES["audit_recent_all"](spark, tmp_path).collect()] == list(range(69, 39, -1))


def test_grounding_has_four_parts(spark, tmp_path):
    rows = [(1, 0, "user", "alpha beta gamma delta"), (1, 1, "assistant", "Alpha beta gamma delta."), (1, 2, "assistant", "Gammaalpha deltabeta unrelated wordsonly."), (1, 3, "assistant", "Ok."), (1, 4, "system", "x gammaalpha deltabeta")]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["score"], r["grounded"]) for r in registry.QUERIES["grounding_score_all"](spark, tmp_path).collect()}
    # no claims: evidence 0.5; numbers 1; concepts (1+1)/2, (0+2/4)/2, 0.5; sentences attributed 1, 1, none
    assert got == {1: (0.85, True), 2: (0.7, True), 3: (0.625, True)}


def test_entities_and_ten_messages_of_conversations(spark, tmp_path):
    rows = [(1, k, "user", f"The same twenty signs and more: {w}") for k, w in enumerate(["GAAP", "gaap and 5%", "the reserve", *"abcdefghi"])] + [(2, 0, "user", "nothing here")]
    write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_messages"], r["n_entities"]) for r in registry.QUERIES["session_stats_all"](spark, tmp_path).collect()}
    assert got == {1: (12, 3), 2: (1, 0)}
    got = {r["conv_id"]: r["context"] for r in registry.QUERIES["recent_context_all"](spark, tmp_path).collect()}
    assert got == {1: "\n".join(r[3] for r in rows[2:12]), 2: "nothing here"}


@pytest.mark.parametrize("name", ["citations", "version_diff"])
def test_hot_source_is_ordered_by_ranges(spark, tmp_path, name):
    rows = [(k * 1000, f"a license of kind {k // 2}", "hot", "en") for k in range(20)] + [(7, "a license", "cold", "en")]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, source string, lang string")
    df = registry.QUERIES[name](spark, tmp_path)
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    if name == "citations":
        assert got == {d: (k, f"{s} [{k}]", t) for d, t, s, _, k in [(*r, i + 1) for i, r in enumerate(rows[:20])] + [(*rows[20], 1)]}
    else:
        assert got == {k * 1000: ((k - 1) * 1000, "none" if k % 2 else "moderate") for k in range(1, 20)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\[source#\d+\], \[doc_id#", plan)
