"""Tags of questions, answers and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import n_words
from ..operators import similar, tags
from ..sources.tables import QUESTIONS, literal, load, values
from . import registry
from .registry import query

_Q = values(QUESTIONS, "qid, query")


def _questions(spark: SparkSession) -> DataFrame:
    return literal(spark, QUESTIONS, "qid int, query string")


def _all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query, place) of all benchmark items and of all user turns; ``place`` orders them, items first."""
    b = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("qid"), F.col("text").alias("query"), F.struct(F.lit(0).alias("o"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("turn")).alias("place"))
    c = load(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("qid"), F.col("text").alias("query"), F.struct(F.lit(1).alias("o"), F.col("conv_id").alias("id"), "turn").alias("place"))
    return b.unionByName(c)


_ALL = """(SELECT 'b' || item_id, text, 0, item_id, 0 FROM benchmark
    UNION ALL SELECT 'c' || conv_id || '-' || turn, text, 1, conv_id, turn FROM conversations WHERE role = 'user') AS t(qid, query, o, id, turn)"""


def _has(low: str, parts) -> str:
    return "(" + " OR ".join(f"contains({low}, '{p}')" for p in parts) + ")"


def _first_sql(c: str, rules: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" for n, p in rules.items()) + " END"


def _compliance_gate(rows: DataFrame) -> DataFrame:
    """The first rule that blocks a question."""
    rule = tags.first_rule(F.col("query"), tags.COMPLIANCE)
    return rows.select("qid", rule.alias("rule"), rule.isNotNull().alias("blocked"))


@query(f"SELECT qid, {_first_sql('query', tags.COMPLIANCE)} AS rule, {_first_sql('query', tags.COMPLIANCE)} IS NOT NULL AS blocked FROM {_Q}")
def compliance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that blocks a question."""
    return _compliance_gate(_questions(spark))


@query(registry.ORACLE["compliance_gate"].replace(_Q, _ALL))
def compliance_gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``compliance_gate`` over all benchmark items and user turns."""
    return _compliance_gate(_all_questions(spark, sf_dir))


@query("SELECT rule, count(*) AS n_hits, min(doc_id) AS first_doc FROM documents, "
       + values(list(tags.COMPLIANCE.items()), "rule, pattern").replace("\\", "\\") + " WHERE regexp_matches(text, '(?i)' || pattern) GROUP BY rule")
def compliance_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each rule hits; rules are tried in one pass over the texts."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + p), F.lit(n)) for n, p in tags.COMPLIANCE.items()]))
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("rule")).groupBy("rule").agg(F.count("*").alias("n_hits"), F.min("doc_id").alias("first_doc"))


_ISSUES = ", ".join([f"CASE WHEN contains(lower(text), '{a}') THEN 'advice_language: {a}' END" for a in tags.ADVICE]
                    + ["CASE WHEN NOT (contains(text, '[') AND contains(text, ']')) THEN 'missing_citations' END",
                       f"CASE WHEN {_has('lower(text)', tags.DUTY)} AND NOT contains(lower(text), 'professional judgment') THEN 'missing_disclaimer' END"])


@query(f"SELECT conv_id, turn, array_to_string([x FOR x IN [{_ISSUES}] IF x IS NOT NULL], '; ') AS issues FROM conversations WHERE role = 'assistant'")
def response_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return own.select("conv_id", "turn", F.array_join(tags.response_issues(F.col("text")), "; ").alias("issues"))


_KIND = "CASE " + " ".join(f"WHEN {_has('lower(query)', p)} THEN '{n}'" for n, p in tags.KINDS.items()) + " ELSE 'general' END"
_TOPICS = ", ".join(f"CASE WHEN {_has('lower(query)', p)} THEN '{n}' END" for n, p in tags.TOPICS.items())


def _query_tags(rows: DataFrame) -> DataFrame:
    q = F.col("query")
    return rows.select("qid", tags.kind_of_question(q).alias("kind"), tags.complexity(q).alias("complexity"), F.array_join(tags.topics(q), ",").alias("topics"))


@query(f"""
    SELECT qid, {_KIND} AS kind, CASE WHEN len(regexp_extract_all(query, '\\S+')) < 5 THEN 'simple' WHEN len(regexp_extract_all(query, '\\S+')) < 15 THEN 'medium'
           ELSE 'complex' END AS complexity, array_to_string([x FOR x IN [{_TOPICS}] IF x IS NOT NULL], ',') AS topics FROM {_Q}""")
def query_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_tags(_questions(spark))


@query(registry.ORACLE["query_tags"].replace(_Q, _ALL))
def query_tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_tags`` over all benchmark items and user turns."""
    return _query_tags(_all_questions(spark, sf_dir))


@query(f"""
    SELECT topic, count(*) AS n_docs FROM (SELECT unnest([x FOR x IN [{_TOPICS.replace('query', 'text')}] IF x IS NOT NULL]) AS topic FROM documents) GROUP BY topic""")
def topic_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = load(spark, sf_dir, "documents").select(F.lower("text").alias("low"))  # once, not by topic
    own = low.select(F.explode(tags.topics_in(F.col("low"))).alias("topic"))
    return own.groupBy("topic").agg(F.count("*").alias("n_docs"))


def _score(ps) -> str:
    return " + ".join(f"regexp_matches(lower(query), '{p}')::INT" for p in ps)


_D = list(tags.DOMAINS)


def _domain_argmax(rows: DataFrame) -> DataFrame:
    return rows.select("qid", tags.domain(F.col("query")).alias("domain"))


@query(f"""
    WITH s AS (SELECT qid, {_score(tags.DOMAINS[_D[0]])} AS a, {_score(tags.DOMAINS[_D[1]])} AS b, {_score(tags.DOMAINS[_D[2]])} AS c FROM {_Q})
    SELECT qid, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a = greatest(a, b, c) THEN '{_D[0]}' WHEN b = greatest(a, b, c) THEN '{_D[1]}' ELSE '{_D[2]}' END AS domain FROM s""")
def domain_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain_argmax(_questions(spark))


@query(registry.ORACLE["domain_argmax"].replace(_Q, _ALL))
def domain_argmax_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``domain_argmax`` over all benchmark items and user turns."""
    return _domain_argmax(_all_questions(spark, sf_dir))


def _framework_sql(c: str) -> str:
    parts = []
    for name, (keywords, indicators, boost) in tags.FRAMEWORKS.items():
        s = " + ".join([f"contains(lower({c}), '{k}')::INT * {0.1 * len(k.split())!r}::DOUBLE" for k in keywords] + [f"contains(lower({c}), '{k}')::INT * {0.15 * len(k.split())!r}::DOUBLE" for k in indicators])
        parts.append(f"least(1.0::DOUBLE, CASE WHEN {s} > 0 THEN {s} + {boost}::DOUBLE ELSE 0 END) AS {name}")
    return ", ".join(parts)


_NAMES = ", ".join(tags.FRAMEWORKS)
_PICK = " ".join(f"WHEN {n} = greatest({_NAMES}) THEN '{n}'" for n in tags.FRAMEWORKS)


def _framework_detect(rows: DataFrame) -> DataFrame:
    name, s = tags.framework(F.col("query"))
    return rows.select("qid", name.alias("framework"), F.round(s, 4).alias("confidence"))


@query(f"""
    WITH s AS (SELECT qid, length(query) >= 100 AS long, {_framework_sql('query')} FROM {_Q})
    SELECT qid, CASE WHEN NOT long OR greatest({_NAMES}) < 0.7 THEN 'general' ELSE CASE {_PICK} END END AS framework,
           round(CASE WHEN long THEN greatest({_NAMES}) ELSE 0 END, 4) AS confidence FROM s""")
def framework_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framework_detect(_questions(spark))


@query(registry.ORACLE["framework_detect"].replace(_Q, "(SELECT doc_id, text FROM documents) AS t(qid, query)"))
def framework_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``framework_detect`` over all documents."""
    return _framework_detect(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("query")))


@query(f"""
    WITH q AS (SELECT qid, query, trim(lower(query)) AS low, len(regexp_extract_all(query, '\\S+')) AS n,
        trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9_ \\t\\n]', '', 'g'), '[ \\t\\n]+', ' ', 'g')) AS plain FROM {_Q})
    SELECT qid, left(sha256(plain), 16) AS signature, CASE WHEN regexp_matches(low, '{tags.PLAIN}') OR n <= 3 THEN 'fast'
           WHEN qid % 4 = 0 THEN 'cached' ELSE 'full' END AS tier FROM q""")
def processing_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and signature; every fourth question stands for a cached one."""
    cached = literal(spark, [(qid,) for qid, _ in QUESTIONS if qid % 4 == 0], "qid int").withColumn("known", F.lit(True))
    own = _questions(spark).join(F.broadcast(cached), "qid", "left")
    q = F.col("query")
    return own.select("qid", tags.signature(q).alias("signature"), tags.processing_tier(q, F.coalesce("known", F.lit(False))).alias("tier"))


@query(f"""
    WITH q AS (SELECT qid, query, o, id, turn, trim(lower(query)) AS low, len(regexp_extract_all(query, '\\S+')) AS n,
        left(sha256(trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9_ \\t\\n]', '', 'g'), '[ \\t\\n]+', ' ', 'g'))), 16) AS signature FROM {_ALL})
    SELECT qid, signature, CASE WHEN regexp_matches(low, '{tags.PLAIN}') OR n <= 3 THEN 'fast'
           WHEN signature IS NOT NULL AND rank() OVER (PARTITION BY signature ORDER BY o, id, turn) > 1 THEN 'cached' ELSE 'full' END AS tier FROM q""")
def processing_tier_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and signature of all benchmark items and user turns; cached is one whose signature an earlier one has."""
    q = _all_questions(spark, sf_dir).withColumn("signature", tags.signature(F.col("query")))
    seen = q.filter("signature is not null").groupBy("signature").agg(F.min("place").alias("first"))
    known = F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return q.join(seen, "signature", "left").select("qid", "signature", tags.processing_tier(F.col("query"), known).alias("tier"))


@query(f"""
    WITH q AS (SELECT qid, query, row_number() OVER (ORDER BY o, id, turn) AS place, trim(lower(query)) AS low, len(regexp_extract_all(query, '\\S+')) AS n,
        trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9_ \\t\\n]', '', 'g'), '[ \\t\\n]+', ' ', 'g')) AS plain FROM {_ALL} WHERE query IS NOT NULL),
    w AS (SELECT *, list_distinct([x FOR x IN string_split(plain, ' ') IF x <> '']) AS w, row_number() OVER (PARTITION BY plain ORDER BY place) > 1 AS known FROM q),
    s AS (SELECT DISTINCT a.qid FROM w a JOIN w b ON b.place < a.place AND len(list_intersect(a.w, b.w)) > 0.7 * len(a.w) WHERE len(a.w) > 0)
    SELECT qid, CASE WHEN regexp_matches(low, '{tags.PLAIN}') OR n <= 3 THEN 'fast' WHEN known THEN 'cached' WHEN {_has('lower(query)', tags.HARD)} OR n > 10 THEN 'full'
        WHEN qid IN (SELECT qid FROM s) THEN 'cached' ELSE 'full' END AS tier FROM w""")
def processing_tier_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers by all rules: cached is a question that an earlier one equals, or one that is not hard and shares over 0.7 of
    its words with an earlier one.
    """
    q = _all_questions(spark, sf_dir).filter("query is not null").withColumn("plain", tags.plain_words(F.col("query")))
    first = q.groupBy("plain").agg(F.min("place").alias("first"), F.min_by("qid", "place").alias("one"))
    words = first.select("one", "first", F.filter(F.array_distinct(F.split("plain", " ")), lambda x: x != "").alias("w"))
    alike = similar.held_by_earlier(words, "one", "first", "w").select("one", F.lit(True).alias("alike"))
    own = q.join(first.join(alike, "one", "left"), "plain")
    return own.select("qid", tags.full_tier(F.col("query"), F.col("place") > F.col("first"), F.coalesce("alike", F.lit(False))).alias("tier"))


@query("""
    WITH v AS (SELECT conv_id, turn, text, 1.0::DOUBLE + CASE WHEN contains(text, '?') THEN 0.3 ELSE 0 END::DOUBLE
        + CASE WHEN contains(lower(text), 'calculate') OR contains(lower(text), 'formula') OR contains(lower(text), 'equation') THEN 0.4 ELSE 0 END::DOUBLE
        + CASE WHEN regexp_matches(text, '[0-9]+(?:\\.[0-9]+)?%') THEN 0.3 ELSE 0 END::DOUBLE
        + CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])(section|vm-|ldti|gaap)') THEN 0.2 ELSE 0 END::DOUBLE AS s FROM conversations)
    SELECT conv_id, turn, round(least(2.0::DOUBLE, CASE WHEN length(text) < 50 THEN s * 0.8::DOUBLE ELSE s END), 4) AS importance FROM v""")
def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(tags.importance(F.col("text")), 4).alias("importance"))


def entities_of(q: Column) -> Column:
    """Distinct entities of four classes, sorted."""
    def found(pattern: str, name: str, case) -> object:
        return F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(name + ":"), case(x)))

    own = F.concat(
        found(r"(?i)\b(universal life|UL|term life|whole life|variable life)\b", "policy", F.lower),
        found(r"[0-9]+(?:\.[0-9]+)?%", "percent", lambda x: x),
        found(r"(?i)\b(LDTI|GAAP|SAP|VM-[0-9]+|Valuation Manual)\b", "regulation", F.upper),
        found(r"(?i)\b(reserve|premium|calculation|NPR)\b", "calculation", F.lower),
    )
    return F.array_sort(F.array_distinct(own))


def _message_entities(rows: DataFrame) -> DataFrame:
    """Entities of four classes, sorted."""
    return rows.select("qid", F.array_join(entities_of(F.col("query")), ",").alias("entities"))


@query(f"""
    SELECT qid, array_to_string(list_sort(list_distinct([('policy:' || lower(x)) FOR x IN regexp_extract_all(query, '(?i)\\b(universal life|UL|term life|whole life|variable life)\\b')]
        || [('percent:' || x) FOR x IN regexp_extract_all(query, '[0-9]+(?:\\.[0-9]+)?%')]
        || [('regulation:' || upper(x)) FOR x IN regexp_extract_all(query, '(?i)\\b(LDTI|GAAP|SAP|VM-[0-9]+|Valuation Manual)\\b')]
        || [('calculation:' || lower(x)) FOR x IN regexp_extract_all(query, '(?i)\\b(reserve|premium|calculation|NPR)\\b')])), ',') AS entities FROM {_Q}""")
def message_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of four classes, sorted."""
    return _message_entities(_questions(spark))


@query(registry.ORACLE["message_entities"].replace(_Q, "(SELECT conv_id || '-' || turn, text FROM conversations) AS t(qid, query)"))
def message_entities_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_entities`` over all messages."""
    return _message_entities(load(spark, sf_dir, "conversations").select(F.concat("conv_id", F.lit("-"), "turn").alias("qid"), F.col("text").alias("query")))


@query("""
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(text) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
           CASE WHEN len(w) < 1000 THEN 'short' WHEN len(w) < 5000 THEN 'medium' WHEN len(w) < 10000 THEN 'long' ELSE 'very long' END AS band,
           CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?%'))) AS BIGINT) AS n_figures
    FROM (SELECT *, regexp_extract_all(text, '\\S+') AS w FROM documents)""")
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_words(F.col("text"))
    band = F.when(n < 1000, "short").when(n < 5000, "medium").when(n < 10000, "long").otherwise("very long")
    figures = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?%"), F.lit(0)))).cast("long")
    return load(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), band.alias("band"), figures.alias("n_figures"))


_LANGS = {"english": ["the ", " of ", " and "], "german": [" der ", " und ", " ein"], "french": [" le ", " les ", " des "]}


def _n(parts) -> str:
    return " + ".join(f"contains(lower(text), '{p}')::INT" for p in parts)


@query(f"""
    WITH s AS (SELECT doc_id, {_n(_LANGS['english'])} AS a, {_n(_LANGS['german'])} AS b, {_n(_LANGS['french'])} AS c FROM documents)
    SELECT doc_id, CASE WHEN a + b + c = 0 THEN NULL WHEN a = greatest(a, b, c) THEN 'english' WHEN b = greatest(a, b, c) THEN 'german' ELSE 'french' END AS name,
           round(CASE WHEN a + b + c = 0 THEN 0 ELSE greatest(a, b, c) / (a + b + c) END::DOUBLE, 6) AS share FROM s""")
def jurisdiction_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon with most hits and its share, as jurisdictions and products are told; a fixture lexicon stands for theirs."""
    name, share = tags.share_of(F.col("text"), _LANGS)
    return load(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.round(share, 6).alias("share"))


@query("""
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[[0-9]+\\]', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{2,}', chr(10), 'g')) AS cleaned,
           contains(lower(text), 'not enough information') OR contains(lower(text), 'no information') OR length(text) < 20 AS insufficient FROM documents""")
def answer_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation marks and repeated space go; answers that say nothing are marked."""
    low = F.lower("text")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\[[0-9]+\]", ""), r"[ \t]+", " "), r"\n{2,}", "\n")
    bad = F.contains(low, F.lit("not enough information")) | F.contains(low, F.lit("no information")) | (F.length("text") < 20)
    return load(spark, sf_dir, "documents").select("doc_id", F.trim(c).alias("cleaned"), bad.alias("insufficient"))


@query("""
    WITH s AS (SELECT doc_id, (regexp_matches(text, '[0-9]{3,}')::INT + contains(text, '@')::INT + contains(lower(text), 'license')::INT) AS n FROM documents)
    SELECT doc_id, round(least(1, n / 3 + CASE WHEN n > 1 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS confidence,
           CASE WHEN least(1, n / 3 + CASE WHEN n > 1 THEN 0.2 ELSE 0 END) >= 0.8 THEN 'contact' ELSE 'general' END AS extractor,
           CASE WHEN n >= 3 THEN 'pattern' WHEN n = 2 THEN 'light' WHEN n = 1 THEN 'full' ELSE 'fallback' END AS route FROM s""")
def extractor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched patterns over all, a fifth more for several; who extracts, and by which route."""
    t = F.col("text")
    n = t.rlike("[0-9]{3,}").cast("int") + F.contains(t, F.lit("@")).cast("int") + F.contains(F.lower(t), F.lit("license")).cast("int")
    own = load(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    conf = F.least(F.lit(1.0), F.col("n") / 3 + F.when(F.col("n") > 1, 0.2).otherwise(0.0))
    route = F.when(F.col("n") >= 3, "pattern").when(F.col("n") == 2, "light").when(F.col("n") == 1, "full").otherwise("fallback")
    return own.select("doc_id", F.round(conf, 6).alias("confidence"), F.when(conf >= 0.8, "contact").otherwise("general").alias("extractor"), route.alias("route"))


def _critical_phrases(rows: DataFrame) -> DataFrame:
    """Quoted phrases, codes and hyphenated words of questions."""
    q = F.col("query")
    bag = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "|")
    return rows.select(
        "qid",
        F.array_join(F.regexp_extract_all(q, F.lit('"([^"]+)"'), F.lit(1)), "|").alias("quoted"),
        bag(F.regexp_extract_all(q, F.lit("[A-Z]{2,6}[ -][0-9]+(?:-[0-9]+)*"), F.lit(0))).alias("codes"),
        bag(F.regexp_extract_all(F.lower(q), F.lit("[a-z]+-[a-z]+"), F.lit(0))).alias("hyphenated"),
    )


@query(f"""
    SELECT qid, array_to_string(regexp_extract_all(query, '"([^"]+)"', 1), '|') AS quoted,
           array_to_string(list_sort(list_distinct(regexp_extract_all(query, '[A-Z]{{2,6}}[ -][0-9]+(?:-[0-9]+)*'))), '|') AS codes,
           array_to_string(list_sort(list_distinct(regexp_extract_all(lower(query), '[a-z]+-[a-z]+'))), '|') AS hyphenated FROM {_Q}""")
def critical_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted phrases, codes and hyphenated words of questions."""
    return _critical_phrases(_questions(spark))


@query(registry.ORACLE["critical_phrases"].replace(_Q, _ALL))
def critical_phrases_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``critical_phrases`` over all benchmark items and user turns."""
    return _critical_phrases(_all_questions(spark, sf_dir))


_CAMEL = values([(1, "DeferredPolicyAcquisitionCosts"), (2, "LiabilityForFuturePolicyBenefits"), (3, "NetIncome"), (4, "x")], "id, term")


@query(f"""
    SELECT id, lower(trim(regexp_replace(term, '([A-Z])', ' \\1', 'g'))) AS alias, left(array_to_string(regexp_extract_all(term, '[A-Z]'), ''), 5) AS acronym,
           CASE WHEN contains(lower(term), 'liability') THEN 'liability' WHEN contains(lower(term), 'cost') THEN 'expense' WHEN contains(lower(term), 'income') THEN 'income' ELSE 'other' END AS class FROM {_CAMEL}""")
def term_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in camel case as words, as an acronym, and their class."""
    rows = [(1, "DeferredPolicyAcquisitionCosts"), (2, "LiabilityForFuturePolicyBenefits"), (3, "NetIncome"), (4, "x")]
    low = F.lower("term")
    kind = F.when(F.contains(low, F.lit("liability")), "liability").when(F.contains(low, F.lit("cost")), "expense").when(F.contains(low, F.lit("income")), "income").otherwise("other")
    return literal(spark, rows, "id int, term string").select("id", F.lower(F.trim(F.regexp_replace("term", "([A-Z])", " $1"))).alias("alias"), F.substring(F.array_join(F.regexp_extract_all("term", F.lit("[A-Z]"), F.lit(0)), ""), 1, 5).alias("acronym"), kind.alias("class"))


_TOKENS = [(1, "2023", 0.9, 10, 20, 30, 40), (2, "$1,200", 0.7, 0, 5, 20, 15), (3, "Revenue", 0.65, 1, 1, 9, 3), (4, "15%", 0.5, 2, 2, 4, 4), (5, "12.5%", 0.8, 2, 2, 4, 8)]


@query(f"""
    SELECT id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CASE WHEN regexp_matches(token, '^(19|20)[0-9]{{2}}$') THEN 'year' WHEN contains(token, '%') THEN 'percent'
           WHEN contains(token, '$') THEN 'currency' WHEN regexp_matches(token, '[0-9]') THEN 'number' ELSE 'legend' END AS class FROM {values(_TOKENS, 'id, token, confidence, x0, y0, x1, y1')} WHERE confidence >= 0.6""")
def ocr_token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read tokens with enough confidence: centre and class."""
    t = literal(spark, _TOKENS, "id int, token string, confidence double, x0 int, y0 int, x1 int, y1 int").filter("confidence >= 0.6")
    kind = F.when(F.col("token").rlike("^(19|20)[0-9]{2}$"), "year").when(F.contains("token", F.lit("%")), "percent").when(F.contains("token", F.lit("$")), "currency").when(F.col("token").rlike("[0-9]"), "number").otherwise("legend")
    return t.select("id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), kind.alias("class"))
