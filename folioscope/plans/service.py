"""The service around the corpus: permissions, feedback, uploads, guided steps, notes on files, groups, rendered answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import search, service
from ..sources.shared import written
from ..sources.tables import QUESTIONS, literal, load, values
from .registry import query
from .retrieval import _BM25, TERMS

_USERS = {"is_user": "c_acctbal >= 0", "can_upload": "c_mktsegment = 'BUILDING'", "is_admin": "c_nationkey = 0"}
_GRANTS = "[" + ", ".join(f"{{'permission': {sql.quoted(k)}, 'allowed': coalesce({_USERS[v]}, false)}}" for k, v in service.PERMISSIONS.items()) + "]"


@query(f"SELECT user_id, p.permission AS permission, p.allowed AS allowed FROM (SELECT c_custkey AS user_id, unnest({_GRANTS}) AS p FROM customer)")
def permission_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user may do; columns of customers stand for roles."""
    return service.granted(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), *[F.expr(v).alias(k) for k, v in _USERS.items()]))


@query("""
    SELECT k AS asked, user_id AS doc_id, count(*) AS n, count_if(event_type = 'error') AS n_bad, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS last_kind
    FROM (SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k FROM events) GROUP BY k, user_id""")
def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on each document for each question: numbers, sum and the last kind; nothing is learned from it."""
    e = load(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("asked"), F.col("user_id").alias("doc_id"))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_bad"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind"))


@query("""
    WITH u AS (SELECT d.doc_id AS job_id, sha256(d.text) AS digest, coalesce(bool_or(toxic = 1), false) AS refused FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL GROUP BY ALL),
    f AS (SELECT *, min(job_id) FILTER (NOT refused) OVER (PARTITION BY digest) AS first FROM u),
    s AS (SELECT *, CASE WHEN first IS NULL OR job_id < first THEN 'failed' WHEN job_id = first THEN 'queued' ELSE 'completed' END AS status, count_if(job_id >= first) OVER (PARTITION BY digest) AS n FROM f)
    SELECT job_id, status, CASE WHEN status = 'completed' THEN first END AS duplicate_of, CASE WHEN status <> 'failed' THEN n END AS uploads FROM s""")
def upload_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads queued, linked to an earlier copy, or failed and taken back; toxic ones stand for those the store refuses."""
    refused = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("refused", F.lit(True))
    d = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    own = d.join(refused, "doc_id", "left")
    return service.upload_jobs(own.select(F.col("doc_id").alias("job_id"), "digest", F.coalesce("refused", F.lit(False)).alias("refused")))


#: Terms that questions may be widened by: key, related terms, aliases, confidence.
LEXICON = [
    ("reserve", ["valuation", "adequacy"], ["provision"], 0.9),
    ("premium", ["rate", "gross premium"], ["contribution"], 0.8),
    ("license", ["copyright", "warranty", "terms"], ["licence"], 0.95),
    ("policy", ["contract"], ["cover"], 0.85),
]
_ASKED = f"(SELECT 'l' || qid AS qid, query FROM {values(QUESTIONS, 'qid, query')} UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"
_LISTS = ", ".join(f"CASE WHEN contains(lower(query), {sql.quoted(k)}) THEN {r + (a if c > 0.8 else [])} ELSE [] END" for k, r, a, c in LEXICON)


@query(f"""
    WITH w AS (SELECT qid, query, list_sort(list_distinct([x FOR x IN flatten([{_LISTS}]) IF NOT list_contains(regexp_split_to_array(lower(query), '[ \\t\\n\\r\\f]+'), x)])) AS terms FROM {_ASKED})
    SELECT qid, CASE WHEN len(terms) > 0 THEN query || ' ' || array_to_string(terms[1:3], ' ') ELSE query END AS widened FROM w""")
def related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with up to three terms that belong to those they hold."""
    b = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("query"))
    c = load(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("qid"), F.col("text").alias("query"))
    q = literal(spark, QUESTIONS, "qid int, query string").select(F.concat(F.lit("l"), F.col("qid").cast("string")).alias("qid"), "query").unionByName(b).unionByName(c)
    return q.select("qid", service.with_related(F.col("query"), LEXICON).alias("widened"))


#: Steps with a choice that branches, two numbers and a free text; responses that pass, fail and come after the end.
STEPS = [
    {"id": "scope", "required": True, "choices": ["life", "property"], "branches": {"property": "claims"}, "next": "amount"},
    {"id": "amount", "required": True, "least": 0, "next": "notes"},
    {"id": "claims", "required": True, "least": 1, "next": "notes"},
    {"id": "notes", "required": False, "next": None},
]
RESPONSES = [
    (1, 1, "life"), (1, 2, "-5"), (1, 3, "abc"), (1, 4, "1200.5"), (1, 5, ""), (1, 6, "more"),
    (2, 1, "property"), (2, 2, "0"), (3, 1, "  "), (4, 1, "boat"), (5, 1, None), (5, 2, "life"), (5, 3, "0"),
]


@query("""
    SELECT session, step, n_done::BIGINT AS n_done, n_rejected::BIGINT AS n_rejected, message, progress::DOUBLE AS progress, status FROM (VALUES
        (1, NULL, 3, 2, 'Please enter a valid number', NULL, 'completed'), (2, 'claims', 1, 1, 'Value must be at least 1', 50.0, 'continue'),
        (3, 'scope', 0, 1, 'This field is required', 25.0, 'continue'), (4, 'scope', 0, 1, 'Please select one of: life, property', 25.0, 'continue'),
        (5, 'notes', 2, 1, 'This field is required', 75.0, 'continue')) AS t(session, step, n_done, n_rejected, message, progress, status)""")
def workflow_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where guided sessions stand; the SQL states the rows worked out by hand."""
    return service.guided(literal(spark, RESPONSES, "session int, ord int, response string"), STEPS)


#: Names, sizes and source types of files at the limits: no ending, two, capitals, ties of a tenth of a kilobyte.
FILES = [("Report.PDF", 1536, "US_GAAP"), ("noending", 256, "OTHER"), ("a.b.xlsx", 1234567, "ACTUARIAL"), ("x.", 0, None), ("odd.zip", 768, "IFRS")]
_FILES = f"(SELECT * FROM {values(FILES, 'name, size, source_type')} UNION ALL SELECT source || '-' || doc_id || '.txt', n_chars, 'COMPANY' FROM documents)"
_END = "CASE WHEN contains(name, '.') THEN split_part(lower(name), '.', -1) ELSE 'unknown' END"


def _case(table: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {sql.quoted(k)} THEN {sql.quoted(v)}" for k, v in table.items()) + f" ELSE {sql.quoted(other)} END"


@query(f"""
    SELECT name, upper(e) || ' (' || {_case(service.FILE_KINDS, 'e', 'Document file')} || ')' AS kind, {_case(service.SOURCE_KINDS, 'source_type', 'Business document')} AS category,
        format('{{:,}}', size::BIGINT) || ' bytes (' || printf('%.1f', size / 1024) || ' KB)' AS size, 0.7::DOUBLE AS confidence FROM (SELECT *, {_END} AS e FROM {_FILES})""")
def file_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of a file where no summary can be had."""
    d = load(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"), F.lit("COMPANY").alias("source_type"))
    own = literal(spark, FILES, "name string, size long, source_type string").unionByName(d)
    notes = service.file_notes(F.col("name"), F.col("size"), F.col("source_type"))
    return own.select("name", *[c.alias(k) for k, c in notes.items()], F.lit(0.7).alias("confidence"))


#: Groupings as a model words them, with the number of documents: full, too few, out of range, more than were shown.
GROUPINGS = [
    (1, "Group 1: Doc 1, Doc 3\nGroup 2: (law) Doc 2, Doc 4\nnothing", 4),
    (2, "Group 1: Doc 1\nDoc 2: Group", 5),
    (3, "Group 1: Doc 9, Doc 2, Doc 1\nGroup 2: none\nGroup 3: Doc 3", 3),
    (4, "", 3),
    (5, "Group 1: Doc 1, Doc 2, Doc 3\nGroup 2: Doc 4, Doc 5", 18),
]


@query("SELECT * FROM (VALUES (1, '1,3;2,4'), (2, '1,2,3,4,5'), (3, '2,1;3'), (4, '1,2,3'), (5, '1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18')) AS t(gid, grouping)")
def answer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that cover enough documents, or one of all; the SQL states the rows worked out by hand."""
    g = literal(spark, GROUPINGS, "gid int, text string, n int")
    return g.select("gid", _joined(service.covering_groups(F.col("text"), F.col("n"))).alias("grouping"))


@query("SELECT * FROM (VALUES (1, '1,3;2,4'), (2, '1,2;3,4,5'), (3, '2,1;3'), (4, '1;2,3'), (5, '1,2,3,17;4,5,16,18')) AS t(gid, grouping)")
def answer_groups_topped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the documents shown, or two halves, later documents added to the smallest; rows worked out by hand."""
    g = literal(spark, GROUPINGS, "gid int, text string, n int")
    return g.select("gid", _joined(service.topped_groups(F.col("text"), F.col("n"))).alias("grouping"))


def _joined(groups):
    return F.array_join(F.transform(groups, lambda g: F.array_join(g.cast("array<string>"), ",")), ";")


@query(_BM25 + """,
    h AS (SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 100),
    m AS (SELECT h.doc_id, score AS original, round(score * CASE quality WHEN 1 THEN 1.5 WHEN 0 THEN 0.5 ELSE 1 END::DOUBLE, 6) AS score FROM h LEFT JOIN labels USING (doc_id))
    SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM m""")
def framework_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits ranked anew by their score times a judged factor, 1 where none was given; labels stand for judgments."""
    best = written(search.top(search.bm25(load(spark, sf_dir, "documents"), TERMS), 100, "doc_id").select("doc_id", F.col("score").alias("original")), "hits")
    judged = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.5).when(F.col("quality") == 0, 0.5).alias("factor"))
    own = best.join(judged.join(F.broadcast(best.select("doc_id")), "doc_id"), "doc_id", "left")  # a hundred rows at most
    own = own.select("doc_id", "original", F.round(F.col("original") * F.coalesce("factor", F.lit(1.0)), 6).alias("score"))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


#: Structured answers: all parts, a section without content, no sections, not JSON.
ANSWERS = [
    (1, '{"summary": "S", "sections": [{"title": "T", "content": "C", "formulas": [{"name": "N", "readable": "a = b", "components": {"a": "left", "b": "right"}}], "numbered_items": ["one", "two"]}], "key_values": {"rates": ["5%", "6%"], "dates": ["2024"]}}'),
    (2, '{"summary": "S", "sections": [{"title": "T"}]}'),
    (3, '{"summary": "only"}'),
    (4, "no json"),
]


@query(r"""
    SELECT * FROM (VALUES
        (1, true, E'S\n\n**T**\nC\n\n**Key Formulas:**\n\n• N:\n  a = b\n  Where:\n  - a = left\n  - b = right\n\n**1.** one\n\n**2.** two\n\n\n**Important Values:**\n• 5%\n• 6%\n• 2024\n'),
        (2, false, E'S\n\n**T**\n'), (3, false, E'only\n'), (4, false, '')) AS t(aid, complete, text)""")
def rendered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured answers as text, and whether they are complete; the SQL states the rows worked out by hand."""
    a = literal(spark, ANSWERS, "aid int, json string").withColumn("a", service.answer_of(F.col("json")))
    return a.select("aid", service.complete(F.col("a")).alias("complete"), service.rendered(F.col("a")).alias("text"))
