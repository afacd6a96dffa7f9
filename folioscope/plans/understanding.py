"""What questions ask for: compliance in full, rewriting, products, topics, routes and follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import questions as ask
from ..operators import search, tags
from ..sources.tables import QUESTIONS, literal, load, values
from .registry import query
from .tagging import _ALL, _all_questions

#: Questions that the rules are made for, beside those of the tables, where few of their words occur.
MORE = [
    "How can I minimize my tax liability?", "What tax planning strategies should I use?", "Give me tax advice for insurance companies",
    "Should I sue this company?", "Give me legal advice about this contract", "What legal interpretation should I use?",
    "How should insurance reserves be calculated under IFRS 17?", "What are the measurement models in IFRS 17?",
    "What should we do in this situation?", "Which method is better for our company?", "What would you do, and is it best practice?",
    "Does the secondary guarantee of a universal life policy add to the account value?", "whole life policy or term life insurance with level term",
    "whole life insurance in a whole contract view", "variable universal life with a separate account", "how does reinsurance work?",
    "what does solvency mean", "assess capital health of the insurer", "financial strength and risk", "who is the CFO, and list all employees with title controller",
    "breakdown by job title and role of the finance team", "who can approve the spending limit of the department", "football results of last week",
    "what is amortization?\n", 'Explain "contractual service margin" and 12.5% of the premium',
]
ASKED = [(f"q{k}", q) for k, q in QUESTIONS] + [(f"m{k}", q) for k, q in enumerate(MORE)]
_ASKED = f"(SELECT qid, query FROM {values(ASKED, 'qid, query')} UNION ALL SELECT qid, query FROM {_ALL}) AS a"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): the literal questions, all benchmark items and all user turns."""
    return literal(spark, ASKED, "qid string, query string").unionByName(_all_questions(spark, sf_dir).select("qid", "query"))


def _hits(c: str, patterns) -> str:
    return sql.labels_where({p: f"regexp_matches({c}, {sql.quoted('(?i)' + p)})" for p in patterns})


_RULE = "CASE " + " ".join(f"WHEN len({_hits('query', ps)}) > 0 THEN '{n}'" for n, ps in ask.RULES.items()) + " END"
_PATTERNS = "CASE " + " ".join(f"WHEN len({_hits('query', ps)}) > 0 THEN {sql.joined(_hits('query', ps), '; ')}" for n, ps in ask.RULES.items()) + " END"
_TEMPLATE = "CASE rule " + " ".join(f"WHEN '{n}' THEN {sql.quoted(t)}" for n, t in ask.TEMPLATES.items()) + " END"


@query(f"SELECT qid, rule, patterns, {_TEMPLATE} AS response FROM (SELECT qid, {_RULE} AS rule, {_PATTERNS} AS patterns FROM {_ASKED}) WHERE rule IS NOT NULL")
def compliance_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked questions with the first rule that blocks them, its patterns that matched and the answer instead."""
    name, hits = ask.first_blocking(F.col("query"))
    own = asked(spark, sf_dir).select("qid", name.alias("rule"), F.array_join(hits, "; ").alias("patterns")).filter("rule is not null")
    response = F.create_map(*[F.lit(x) for p in ask.TEMPLATES.items() for x in p])
    return own.withColumn("response", F.try_element_at(response, F.col("rule")))


_RULE_ROWS = [(k, n, p) for k, (n, ps) in enumerate([*ask.RULES.items(), ("no_forecast", (r"forecast", r"predict"))]) for p in ps]


@query(f"""
    WITH r AS (SELECT * FROM {values(_RULE_ROWS, 'ord, rule, pattern')}),
    h AS (SELECT qid, ord, rule, pattern FROM {_ASKED}, r WHERE regexp_matches(query, '(?i)' || pattern))
    SELECT qid, arg_min(rule, ord) AS rule, count(*) AS n_patterns FROM h GROUP BY qid""")
def compliance_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules kept as rows, one added at run time: the first rule of each question that breaks one, and all its hits."""
    rules = literal(spark, _RULE_ROWS, "ord int, rule string, pattern string")  # a short literal table
    hits = asked(spark, sf_dir).join(F.broadcast(rules), F.rlike("query", F.concat(F.lit("(?i)"), F.col("pattern"))))
    return hits.groupBy("qid").agg(F.min_by("rule", "ord").alias("rule"), F.count("*").alias("n_patterns"))


@query(f"""
    SELECT qid, {sql.joined(_hits('query', ask.JUDGMENT), '; ')} AS triggers, CASE WHEN len({_hits('query', ask.JUDGMENT)}) > 0 THEN {sql.quoted(ask.NOTICE)} END AS notice FROM {_ASKED}""")
def judgment_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What in a question calls for the notice on professional judgment, and the notice."""
    hits = ask.matched(F.col("query"), ask.JUDGMENT)
    return asked(spark, sf_dir).select("qid", F.array_join(hits, "; ").alias("triggers"), F.when(F.size(hits) > 0, ask.NOTICE).alias("notice"))


_STOP = ", ".join(f"'{w}'" for w in ask.STOP)
_GOOD = lambda x: f"(length({x}) > 2 AND {x} NOT IN ({_STOP}))"
_PLAIN = "regexp_replace(query, '[^\\p{L}\\p{M}\\p{N}_.%]+', '  ', 'g')"
_NAMED = f"""list_sort(list_distinct(regexp_extract_all(regexp_replace({_PLAIN}, '[.%]', '  ', 'g'), '(?:^| )([A-Z][a-z]+)(?: |$)', 1)
    || regexp_extract_all(regexp_replace({_PLAIN}, '[.%]', '  ', 'g'), '(?:^| )([A-Z]{{2,}})(?: |$)', 1)
    || regexp_extract_all({_PLAIN}, '(?:^| )([0-9]+(?:\\.[0-9]+)?)%?(?: |\\.|$)', 1)))"""


def _parsed(rows: str) -> str:
    """CTEs w, p and k over rows of (key, query) in ``rows``: words, phrases, keywords and names."""
    return f"""w AS (SELECT *, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {rows}),
    k AS (SELECT *, [x FOR x IN w IF {_GOOD('x')}] AS good, list_sort(list_distinct(regexp_extract_all(query, '"([^"]*)"', 1)
            || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w)) IF {_GOOD('w[i]')} AND {_GOOD('w[i + 1]')}]
            || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1) IF {_GOOD('w[i]')} AND {_GOOD('w[i + 2]')}])) AS phrases,
        {_NAMED} AS named FROM w),
    p AS (SELECT *, {sql.first_seen('good')} AS keywords FROM k)"""


_INTENT = "CASE " + " ".join(f"WHEN {sql.any_of('lower(query)', ps)} THEN '{n}'" for n, ps in ask.INTENTS.items()) + " ELSE 'general' END"


@query(f"""
    WITH {_parsed(_ASKED)},
    f AS (SELECT *, list_sort([{{'n': -(len(string_split(x, ' ')) + CASE WHEN regexp_matches(x, '^(?:a|an|the) ') THEN 0 ELSE 2 END), 'p': x}} FOR x IN phrases IF contains(x, ' ')]) AS ranked FROM p)
    SELECT qid, array_to_string(keywords, ' ') AS keywords, array_to_string(phrases, '|') AS phrases, array_to_string(named, '|') AS named, {_INTENT} AS intent,
           CASE WHEN len(ranked) > 0 THEN '"' || ranked[1].p || '"' WHEN len(keywords) > 0 THEN array_to_string(keywords[1:3], ' ') ELSE query END AS focused FROM f""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, phrases, names and intent of a question, and the query that is searched for in its place."""
    p, q = ask.parsed(asked(spark, sf_dir)), F.col("query")
    focused = ask.focused(q, F.col("phrases"), F.col("keywords"))
    return p.select("qid", F.array_join("keywords", " ").alias("keywords"), F.array_join("phrases", "|").alias("phrases"), F.array_join("named", "|").alias("named"), ask.intent(q).alias("intent"), focused.alias("focused"))


@query(f"""
    WITH q AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
    a AS (SELECT conv_id, c.turn, query, text FROM conversations c JOIN q USING (conv_id) WHERE role = 'assistant'), {_parsed('a')}
    SELECT conv_id, turn, round((3 * len([x FOR x IN phrases IF contains(lower(text), lower(x))]) + 2 * len([x FOR x IN named IF contains(lower(text), lower(x))])
        + len([x FOR x IN keywords IF contains(lower(text), x)])) / greatest(1.0::DOUBLE, length(text) / 1000), 6) AS score FROM p""")
def content_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each answer holds the phrases, names and keywords of the first question of its conversation."""
    c = load(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    own = c.filter("role = 'assistant'").join(ask.parsed(q), "conv_id")
    score = ask.validation_score(F.col("phrases"), F.col("named"), F.col("keywords"), F.col("text"))
    return own.select("conv_id", "turn", F.round(score, 6).alias("score"))


def _score_sql(low: str, products: dict) -> dict[str, str]:
    out = {n: sql.count_like(low, [ask.edged(p) for p in ps]) for n, ps in products.items()}
    out["whole_life"] = f"CASE WHEN regexp_matches({low}, {sql.quoted(ask.edged(ask.NOT_WHOLE))}) THEN 0 ELSE {out['whole_life']} END"
    return out


def _leading_sql(names) -> str:
    names = list(names)
    most = f"greatest({', '.join(names)})"
    return f"CASE WHEN {' + '.join(names)} > 0 THEN CASE " + " ".join(f"WHEN {n} = {most} THEN '{n}'" for n in names) + f" END END AS lead, CASE WHEN {' + '.join(names)} > 0 THEN {most} / ({' + '.join(names)}) ELSE 0 END AS share"


@query(f"""
    WITH s AS (SELECT qid, {', '.join(f'{s} AS {n}' for n, s in _score_sql('lower(query)', ask.PRODUCTS).items())} FROM {_ASKED}),
    l AS (SELECT *, {_leading_sql(ask.PRODUCTS)} FROM s), o AS (SELECT *, list_sort([{', '.join(ask.PRODUCTS)}], 'DESC') AS o FROM l)
    SELECT qid, CASE WHEN lead IS NULL THEN 'unknown' WHEN share < 0.6 THEN 'general' ELSE lead END AS product, round(share, 6) AS confidence, o[1] - o[2] < 0.3 AS ambiguous FROM o""")
def product_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product a question means; general if no product leads clearly, ambiguous if two are close."""
    scores = ask.product_scores(F.lower("query"), ask.PRODUCTS)
    own = asked(spark, sf_dir).select("qid", *[s.alias(n) for n, s in scores.items()])
    cols = {n: F.col(n) for n in scores}
    lead, share = ask.leading(cols)
    order = F.sort_array(F.array(*cols.values()), False)
    return own.select("qid", F.when(lead.isNull(), "unknown").when(share < 0.6, "general").otherwise(lead).alias("product"), F.round(share, 6).alias("confidence"), (F.get(order, F.lit(0)) - F.get(order, F.lit(1)) < 0.3).alias("ambiguous"))


#: Texts that the product patterns are made for, beside the documents of the tables.
POLICIES = [
    (-1, "A universal life policy with flexible premium and a no lapse guarantee."),
    (-2, "Traditional whole life and ordinary life are permanent insurance."),
    (-3, "The whole life policy is seen in a whole contract view; level term and term life differ."),
    (-4, "Term life, term insurance and level term beside universal life."),
    (-5, ""),
]
_TEXTS = f"(SELECT doc_id, text FROM {values(POLICIES, 'doc_id, text')} UNION ALL SELECT doc_id, text FROM documents) AS d"
_PRODUCT = f"""
    s AS (SELECT doc_id, {', '.join(f'{s} AS {n}' for n, s in _score_sql("lower(coalesce(text, ''))", ask.DOCUMENT_PRODUCTS).items())} FROM {_TEXTS}),
    l AS (SELECT *, {_leading_sql(ask.DOCUMENT_PRODUCTS)} FROM s),
    t AS (SELECT doc_id, coalesce(lead, 'general') AS product, round(CASE WHEN lead IS NULL THEN 1 ELSE share END, 6) AS confidence FROM l)"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = literal(spark, POLICIES, "doc_id long, text string").unionByName(load(spark, sf_dir, "documents").select("doc_id", "text"))
    scores = ask.product_scores(F.lower(F.coalesce("text", F.lit(""))), ask.DOCUMENT_PRODUCTS)
    own = texts.select("doc_id", *[s.alias(n) for n, s in scores.items()])
    lead, share = ask.leading({n: F.col(n) for n in scores})
    return own.select("doc_id", F.coalesce(lead, F.lit("general")).alias("product"), F.round(F.when(lead.isNull(), 1.0).otherwise(share), 6).alias("confidence"))


@query(f"WITH {_PRODUCT} SELECT * FROM t")
def product_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product a document is about, and its share of all hits."""
    return _typed(spark, sf_dir)


@query(f"WITH {_PRODUCT} SELECT product, count(*) AS n_docs, round(avg(confidence), 6) AS confidence FROM t GROUP BY product")
def product_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).groupBy("product").agg(F.count("*").alias("n_docs"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"""
    WITH {_PRODUCT}, c AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS dl,
        len([x FOR x IN regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') IF x = 'license']) AS a FROM documents),
    m AS (SELECT count(*) AS n, avg(dl) AS l, count_if(a > 0) AS f FROM c),
    r AS (SELECT doc_id, round(ln(1 + (n - f + 0.5::DOUBLE) / (f + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / l)), 4) AS score FROM c, m WHERE a > 0)
    SELECT doc_id, score, product, confidence FROM r JOIN t USING (doc_id) WHERE product = 'general' ORDER BY score DESC, doc_id LIMIT 10""")
def keyword_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search among the documents of one product."""
    hits = search.bm25(load(spark, sf_dir, "documents"), ["license"]).select("doc_id", "score")
    return search.top(hits.join(_typed(spark, sf_dir).filter("product = 'general'"), "doc_id").select("doc_id", "score", "product", "confidence"), 10, "doc_id")


@query(f"SELECT qid, CASE {' '.join(f'WHEN contains(lower(query), {sql.quoted(t)}) THEN query || {sql.quoted(chr(32) + m)}' for t, m in ask.EXPANSIONS.items())} ELSE query END AS expanded FROM {_ASKED}")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions widened by the words of the first general term in them."""
    return asked(spark, sf_dir).select("qid", ask.expanded(F.col("query")).alias("expanded"))


_GENERAL = "(" + " OR ".join(f"regexp_matches(lower(query), {sql.quoted(p.replace('$', chr(92) + 'z'))})" for p in ask.GENERAL) + ")"


@query(f"""
    SELECT qid, {sql.joined(sql.labels_where({n: sql.any_of('lower(query)', p) for n, p in ask.FIELDS.items()}))} AS fields, {' OR '.join(sql.any_of('lower(query)', p) for p in ask.FIELDS.values())} AS relevant,
           NOT {sql.like_any('lower(query)', [ask.edged(p) for p in ask.OF_DOCUMENTS])} AND {_GENERAL} AS general_knowledge FROM {_ASKED}""")
def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields a question touches, whether it touches any, and whether it asks for general knowledge."""
    own = asked(spark, sf_dir).select("qid", "query", ask.fields(F.col("query")).alias("f"))
    return own.select("qid", F.array_join("f", ",").alias("fields"), (F.size("f") > 0).alias("relevant"), ask.general_knowledge(F.col("query")).alias("general_knowledge"))


_FORMS = " + ".join(f"CASE WHEN regexp_matches(lower(query), {sql.quoted(p)}) THEN 0.2 ELSE 0 END::DOUBLE" for p in ask.FORMS)
_ROUTES = ", ".join(" + ".join(f"CASE WHEN contains(lower(query), {sql.quoted(w)}) THEN {ask.WEIGHT.get(w, 0.1)} ELSE 0 END::DOUBLE" for w in ws) + f" + {_FORMS} AS {n}" for n, ws in ask.EXTRACTION.items())
_ROUTE_MOST = f"greatest({', '.join(ask.EXTRACTION)})"


@query(f"""
    WITH s AS (SELECT qid, query, {_ROUTES} FROM {_ASKED})
    SELECT qid, CASE WHEN {_ROUTE_MOST} = 0 THEN 'standard' {' '.join(f'WHEN {n} = {_ROUTE_MOST} THEN {sql.quoted(n)}' for n in ask.EXTRACTION)} END AS kind,
           round({_ROUTE_MOST}, 4) AS confidence, round({_ROUTE_MOST}, 4) >= 0.3 AS extract,
           CASE WHEN {sql.any_of('lower(query)', ('financial structure', 'finance team'))} THEN 'financial' WHEN {sql.any_of('lower(query)', ('organizational', 'org chart'))} THEN 'organizational'
                WHEN {sql.any_of('lower(query)', ('approval', 'authorization'))} THEN 'approval' END AS document_type FROM s""")
def extraction_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question needs people and roles from the documents, which kind, and the documents it is limited to."""
    low = F.lower("query")
    kind = F.when(tags.any_of(low, ("financial structure", "finance team")), "financial").when(tags.any_of(low, ("organizational", "org chart")), "organizational").when(tags.any_of(low, ("approval", "authorization")), "approval")
    scores = ask.extraction_scores(F.col("query"))
    own = asked(spark, sf_dir).select("qid", kind.alias("document_type"), *[s.alias(n) for n, s in scores.items()])
    most = F.greatest(*scores)
    best = F.lit(None).cast("string")
    for n in reversed(scores):
        best = F.when(F.col(n) == most, n).otherwise(best)
    return own.select("qid", F.when(most == 0, "standard").otherwise(best).alias("kind"), F.round(most, 4).alias("confidence"), (F.round(most, 4) >= 0.3).alias("extract"), "document_type")


_SH = "[" + ", ".join(map(sql.quoted, ask.SHARED)) + "]"


@query(f"""
    WITH f AS (SELECT conv_id, arg_min(text, turn) AS asked FROM conversations WHERE role = 'user' GROUP BY conv_id),
    u AS (SELECT conv_id, turn, role, text AS question, lag(text) OVER w AS answer, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    t AS (SELECT conv_id, turn, question, lower(question) AS q, lower(asked) AS a, lower(answer) AS r FROM u JOIN f USING (conv_id) WHERE role = 'user' AND before = 'assistant'),
    c AS (SELECT conv_id, turn, question FROM t WHERE NOT {sql.any_of('q', ask.ANY_TALK)} AND ({sql.any_of('q', ask.SPEAKS_OF)} OR len([x FOR x IN {_SH} IF contains(q, x) AND contains(r, x)]) > 0
        OR len([x FOR x IN regexp_extract_all(r, '[0-9]+\\.[0-9]+%') IF contains(q, x)]) > 0 OR len([x FOR x IN regexp_extract_all(a, '\\S+') IF length(x) > 3 AND contains(q, x)]) >= 2
        OR len([x FOR x IN regexp_extract_all(r, '\\S+') IF length(x) > 4 AND contains(q, x)]) >= 3 OR (length(q) > 20 AND {sql.any_of('q', ask.OWN_TERMS)}))),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM c)
    SELECT conv_id, turn, nth, question FROM n WHERE nth <= 3""")
def contextual_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up questions that belong to their conversation, three of each at most."""
    c = load(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("asked"))
    own = c.withColumns({"answer": F.lag("text").over(w), "before": F.lag("role").over(w)}).filter("role = 'user' and before = 'assistant'").join(first, "conv_id")
    own = own.filter(ask.contextual(F.col("text"), F.col("asked"), F.col("answer")))
    return own.withColumn("nth", F.row_number().over(w).cast("long")).filter("nth <= 3").select("conv_id", "turn", "nth", F.col("text").alias("question"))
