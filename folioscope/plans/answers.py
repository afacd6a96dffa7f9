"""Answers scored in full, alignment of questions and sources, and the composed retrieval of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.text import n_words, words
from ..operators import quality, scoring, search, tags, vectors
from ..sources.tables import QUESTIONS, literal, load, values
from . import registry
from .grounding import _PAIRS, _pairs
from .registry import query
from .retrieval import _BM25, TERMS, _query_weights

_THREE = """
    WITH o AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'assistant'),
    s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY rn) AS sources, count(*) AS n_docs FROM o WHERE rn <= 3 GROUP BY conv_id),
    n AS (SELECT conv_id, count(*) AS n_all FROM o GROUP BY conv_id),
    q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    p AS (SELECT c.conv_id, c.turn, c.text AS response, lower(c.text) AS low, sources, n_docs, n_all, question, lower(question) AS ask FROM conversations c JOIN s USING (conv_id) JOIN n USING (conv_id) JOIN q USING (conv_id) WHERE role = 'assistant')"""


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, response, sources, question, n_all): answers with the first three other messages."""
    c = load(spark, sf_dir, "conversations")
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    o = c.filter("role <> 'assistant'").withColumn("rn", rn)
    few = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "text"))))  # three at most
    s = o.groupBy("conv_id").agg(F.array_join(F.transform(few, lambda x: x["text"]), " ").alias("sources"), F.count("*").alias("n_all"))
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response")).join(s, "conv_id").join(q, "conv_id")


_QW = "list_distinct(regexp_extract_all(ask, '\\S+'))"
_NUM = "list_distinct(regexp_extract_all(sources, '[0-9]+(?:\\.[0-9]+)?%?'))"


@query(_THREE + f""",
    v AS (SELECT conv_id, turn, least(1.0::DOUBLE, CASE WHEN len({_QW}) = 0 THEN 0 ELSE len(list_intersect({_QW}, regexp_extract_all(low, '\\S+'))) / len({_QW}) END * 1.5::DOUBLE) AS a,
        CASE WHEN len({_NUM}) = 0 THEN 0.8 ELSE least(1.0::DOUBLE, len(list_intersect({_NUM}, regexp_extract_all(response, '[0-9]+(?:\\.[0-9]+)?%?'))) / len({_NUM}) * 2) END::DOUBLE AS b,
        CASE WHEN regexp_matches(response, '(?m)^#{{1,3}}[ \\t\\n]+[A-Za-z0-9_]') THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN {sql.any_of('response', ('•', '-'))} THEN 0.3 ELSE 0 END::DOUBLE
            + CASE WHEN contains(response, chr(10) || chr(10)) THEN 0.3 ELSE 0 END::DOUBLE AS f,
        CASE WHEN {sql.count_of('ask', quality.IMPORTANT)} > 0 THEN least(1.0::DOUBLE, {sql.count_of('low', quality.IMPORTANT)} / {sql.count_of('ask', quality.IMPORTANT)}) ELSE 0.8 END::DOUBLE AS r FROM p)
    SELECT conv_id, turn, round(a, 6) AS completeness, round(b, 6) AS accuracy, round(f, 6) AS formatting, round(r, 6) AS relevance, round(a * 0.3::DOUBLE + b * 0.3::DOUBLE + f * 0.2::DOUBLE + r * 0.2::DOUBLE, 6) AS overall FROM v""")
def response_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, accuracy, formatting and relevance of each answer, and their weighted sum."""
    p, q, r = _three(spark, sf_dir), F.col("question"), F.col("response")
    v = p.select("conv_id", "turn", quality.completeness(q, r).alias("a"), quality.accuracy(F.col("sources"), r).alias("b"), quality.formatting(r).alias("f"), quality.relevance(q, r).alias("r"))
    total = F.col("a") * 0.3 + F.col("b") * 0.3 + F.col("f") * 0.2 + F.col("r") * 0.2
    return v.select("conv_id", "turn", *[F.round(k, 6).alias(n) for k, n in (("a", "completeness"), ("b", "accuracy"), ("f", "formatting"), ("r", "relevance"))], F.round(total, 6).alias("overall"))


_POINTS = f"""CASE WHEN length(question) > 100 THEN 2 WHEN length(question) > 50 THEN 1 ELSE 0 END + CASE WHEN w > 15 THEN 2 WHEN w > 8 THEN 1 ELSE 0 END
    + CASE WHEN {sql.count_of('ask', quality.COMPLEX)} > {sql.count_of('ask', quality.SIMPLE)} THEN {sql.count_of('ask', quality.COMPLEX)} WHEN {sql.count_of('ask', quality.SIMPLE)} > 0 THEN -1 ELSE 0 END + least(n_all // 3, 3)"""


@query(_THREE + f""", w AS (SELECT *, len(regexp_extract_all(question, '\\S+')) AS w FROM p), v AS (SELECT conv_id, turn, {_POINTS} AS points FROM w)
    SELECT conv_id, turn, CASE WHEN points <= 0 THEN 2000 WHEN points <= 2 THEN 2500 WHEN points <= 4 THEN 3000 WHEN points <= 6 THEN 3500 ELSE 4000 END::BIGINT AS token_budget FROM v""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that an answer may take, by its question and the number of documents."""
    return _three(spark, sf_dir).select("conv_id", "turn", quality.token_budget(F.col("question"), F.col("n_all")).alias("token_budget"))


def _signs(response: str, sources: str) -> str:
    own = [f"(regexp_matches({response}, '{p}') AND NOT regexp_matches({sources}, '{p}'))::INT" for p in quality.MADE_UP] + [f"regexp_matches({response}, '{p}')::INT" for p in quality.TEMPLATES]
    return f"(({' + '.join(own)}) / {len(own)}::DOUBLE)"


#: Answers that the signs are made for, beside those of the table: id, answer, sources.
MADE = [
    (-1, "Here are the steps.\n1. First\n2. Second\n3. Third", "none"), (-2, "The current ratio is current assets\nover current liabilities.", "assets"),
    (-3, "In general, generally accepted accounting principles hold.", "Generally Accepted Accounting Principles"), (-4, "Typically international financial reporting standards apply.", ""),
]


@query(_PAIRS + f", r AS (SELECT conv_id, turn, response, sources FROM p UNION ALL SELECT id, 0, response, sources FROM {values(MADE, 'id, response, sources')}) SELECT conv_id, turn, round({_signs('response', 'sources')}, 6) AS risk FROM r")
def hallucination_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of eight signs of made-up text that an answer shows."""
    made = literal(spark, [(k, 0, r, s) for k, r, s in MADE], "conv_id long, turn long, response string, sources string")
    own = _pairs(spark, sf_dir).select("conv_id", "turn", "response", "sources").unionByName(made)
    return own.select("conv_id", "turn", F.round(quality.made_up(F.col("response"), F.col("sources")), 6).alias("risk"))


_COVER = registry.ORACLE["evidence_coverage"]
_GROUND = registry.ORACLE["grounding_score_all"]
_SEM = "CASE WHEN len(list_distinct(regexp_extract_all(lower(question), '\\S+'))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(regexp_extract_all(lower(question), '\\S+')), regexp_extract_all(src, '\\S+'))) / len(list_distinct(regexp_extract_all(lower(question), '\\S+'))) END"


@query(_PAIRS + f""", e AS ({_COVER}), g AS ({_GROUND}), h AS (SELECT conv_id, turn, {_signs('response', 'sources')} AS risk FROM p),
    v AS (SELECT p.conv_id, p.turn, round(({_SEM})::DOUBLE, 6) AS sem, e.coverage AS cov, g.score AS ground, round(risk, 6) AS risk FROM p JOIN e USING (conv_id, turn) JOIN g USING (conv_id, turn) JOIN h USING (conv_id, turn)),
    t AS (SELECT *, (sem * 0.3::DOUBLE + (ground + cov) / 2 * 0.4::DOUBLE + (1 - risk) * 0.2::DOUBLE) / 0.9::DOUBLE AS overall,
        {sql.labels_where({"alignment": "sem < 0.25", "grounding": "ground < 0.2", "risk": "risk > 0.7"})} AS f FROM v)
    SELECT conv_id, turn, round(overall, 5) AS overall, array_to_string(f, ',') AS failures, len(f) = 0 AND overall >= 0.25 AS valid, round((0.5::DOUBLE + 1 - risk + least(1.0::DOUBLE, ground * 1.2::DOUBLE) + overall) / 4, 5) AS confidence FROM t""")
def unified_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score of alignment, grounding and risk by weights, what fails, and the confidence in it."""
    keys = ["conv_id", "turn"]
    p = _pairs(spark, sf_dir).select(*keys, F.round(scoring.word_overlap(F.col("question"), F.col("sources")), 6).alias("sem"), F.round(quality.made_up(F.col("response"), F.col("sources")), 6).alias("risk"))
    e = registry.QUERIES["evidence_coverage"](spark, sf_dir).withColumnRenamed("coverage", "cov")
    g = registry.QUERIES["grounding_score_all"](spark, sf_dir).select(*keys, F.col("score").alias("ground"))
    c = F.col
    v = p.join(e, keys).join(g, keys).withColumn("overall", quality.unified({"semantic": [c("sem")], "grounding": [c("ground"), c("cov")], "risk": [c("risk")]}))
    bad = {"alignment": c("sem") < quality.LEAST_SEMANTIC, "grounding": c("ground") < quality.LEAST_GROUNDING, "risk": c("risk") > quality.MOST_RISK}
    f = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()]))
    sure = (0.5 + 1 - c("risk") + F.least(F.lit(1.0), c("ground") * 1.2) + c("overall")) / 4
    return v.select(*keys, F.round("overall", 5).alias("overall"), F.array_join(f, ",").alias("failures"), ((F.size(f) == 0) & (c("overall") >= quality.LEAST_OVERALL)).alias("valid"), F.round(sure, 5).alias("confidence"))


@query("""
    WITH q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    d AS (SELECT conv_id, count(*) AS n_docs, avg(len(list_intersect(list_distinct(regexp_extract_all(lower(question), '\\S+')), regexp_extract_all(lower(text), '\\S+'))) / len(list_distinct(regexp_extract_all(lower(question), '\\S+')))) AS r
          FROM conversations JOIN q USING (conv_id) WHERE role <> 'assistant' GROUP BY conv_id),
    a AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '\\S+')) AS w, len(regexp_extract_all(text, '\\[[0-9]+\\]')) AS c FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, n_docs, c AS n_citations, w AS n_words, len(regexp_extract_all(question, '\\S+')) AS n_question_words, round(r, 6) AS doc_relevance, round(CASE WHEN c > 0 THEN c / w * 100 ELSE 0 END::DOUBLE, 6) AS citation_density
    FROM a JOIN d USING (conv_id) JOIN q USING (conv_id)""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents, citations and words, the mean relevance of documents, citations by a hundred words."""
    c = load(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    d = c.filter("role <> 'assistant'").join(q, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n_docs"), F.avg(scoring.word_overlap(F.col("question"), F.col("text"))).alias("r"))
    n = F.size(F.regexp_extract_all("text", F.lit(r"\[[0-9]+\]"), F.lit(0))).cast("long")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", n.alias("n_citations"), n_words(F.col("text")).alias("n_words"))
    density = F.when(F.col("n_citations") > 0, F.col("n_citations") / F.col("n_words") * 100).otherwise(0.0)
    return a.join(d, "conv_id").join(q, "conv_id").select("conv_id", "turn", "n_docs", "n_citations", "n_words", n_words(F.col("question")).alias("n_question_words"), F.round("r", 6).alias("doc_relevance"), F.round(density, 6).alias("citation_density"))


@query(_THREE + """,
    f AS (SELECT conv_id, regexp_extract_all(lower(text), '\\S+')[1:200] AS w FROM o WHERE rn <= 3), d AS (SELECT conv_id, list_distinct(flatten(list(w))) AS w FROM f GROUP BY conv_id),
    j AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(question), '\\S+')) AS a, w AS b FROM q JOIN d USING (conv_id))
    SELECT conv_id, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END::DOUBLE, 6) AS jaccard,
           CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END < 0.1 AS misaligned FROM j""")
def jaccard_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared part of a question's words and of the first 200 words of each of three sources."""
    c = load(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    d = c.filter("role <> 'assistant'").withColumn("rn", rn).filter("rn <= 3").groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(F.slice(words(F.lower("text")), 1, 200)))).alias("b"))
    own = q.join(d, "conv_id").withColumn("a", F.array_distinct(words(F.lower("question"))))
    every = F.size(F.array_union("a", "b"))
    j = F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect("a", "b")) / every)
    return own.select("conv_id", F.round(j, 6).alias("jaccard"), (j < 0.1).alias("misaligned"))


_EN = "the and for are was with that this from have has not but you all any can had her his our out who its".split()
_EN_SQL = ", ".join(f"'{w}'" for w in _EN)


@query(f"""
    WITH x AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role <> 'assistant' ORDER BY turn) AS rn FROM conversations),
    u AS (SELECT conv_id, 0 AS doc, arg_min(text, turn) AS text FROM x WHERE role = 'user' GROUP BY conv_id UNION ALL SELECT conv_id, rn, left(text, 1000) FROM x WHERE role <> 'assistant' AND rn <= 5),
    g AS (SELECT u.* FROM u WHERE conv_id IN (SELECT conv_id FROM x WHERE role = 'user')),
    w AS (SELECT conv_id, doc, [y FOR y IN regexp_extract_all(lower(text), '[a-z0-9_]+') IF length(y) > 1 AND y NOT IN ({_EN_SQL})] AS w FROM g),
    t AS (SELECT conv_id, doc, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM w),
    c AS (SELECT conv_id, doc, term, count(*) AS tf FROM t GROUP BY ALL),
    f AS (SELECT conv_id, term, count(*) AS df, row_number() OVER (PARTITION BY conv_id ORDER BY sum(tf) DESC, term) AS rn FROM c GROUP BY conv_id, term),
    n AS (SELECT conv_id, count(*) AS n FROM g GROUP BY conv_id),
    i AS (SELECT conv_id, doc, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS v FROM c JOIN f USING (conv_id, term) JOIN n USING (conv_id) WHERE rn <= 100),
    z AS (SELECT conv_id, doc, sqrt(sum(v * v)) AS z FROM i GROUP BY conv_id, doc), k AS (SELECT conv_id, doc, term, v / z AS v FROM i JOIN z USING (conv_id, doc)),
    a AS (SELECT q.conv_id, d.doc, sum(q.v * d.v) AS s FROM k q JOIN k d ON q.conv_id = d.conv_id AND q.term = d.term WHERE q.doc = 0 AND d.doc > 0 GROUP BY ALL),
    m AS (SELECT g.conv_id, max(coalesce(s, 0)) AS top, avg(coalesce(s, 0)) AS mean FROM g LEFT JOIN a USING (conv_id, doc) WHERE doc > 0 GROUP BY g.conv_id),
    b AS (SELECT q.conv_id, q.term, count(d.doc) / any_value(n.n - 1) AS share FROM k q JOIN n USING (conv_id) LEFT JOIN k d ON q.conv_id = d.conv_id AND q.term = d.term AND d.doc > 0 WHERE q.doc = 0 AND q.v > 0.3 GROUP BY q.conv_id, q.term),
    e AS (SELECT conv_id, avg(share) AS cov FROM b GROUP BY conv_id)
    SELECT conv_id, round(top, 5) AS top, round(mean, 5) AS mean, round(coalesce(cov, 0.5)::DOUBLE, 5) AS coverage, round(0.4::DOUBLE * top + 0.3::DOUBLE * mean + 0.3::DOUBLE * coalesce(cov, 0.5)::DOUBLE, 4) AS alignment FROM m LEFT JOIN e USING (conv_id)""")
def tfidf_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of TF-IDF vectors (one and two words, a hundred terms) between a question and up to five sources.

    Fitted for each conversation on its few texts; smoothed as ln((1 + n) / (1 + df)) + 1 and normed.
    """
    c = load(spark, sf_dir, "conversations")
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).withColumn("doc", F.lit(0))
    d = c.filter("role <> 'assistant'").withColumn("doc", rn).filter("doc <= 5").select("conv_id", F.substring("text", 1, 1000).alias("text"), "doc").join(q.select("conv_id"), "conv_id")
    g = q.unionByName(d)
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda y: (F.length(y) > 1) & ~y.isin(*_EN))
    two = F.when(F.size("w") > 1, F.transform(F.slice("w", 2, F.size("w")), lambda y, k: F.concat(F.get("w", k), F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
    t = g.select("conv_id", "doc", w.alias("w")).select("conv_id", "doc", F.explode(F.concat("w", two)).alias("term"))
    tf = t.groupBy("conv_id", "doc", "term").agg(F.count("*").alias("tf"))
    f = tf.groupBy("conv_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all"))
    f = f.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("all"), "term"))).filter("rn <= 100")
    n = g.groupBy("conv_id").agg(F.count("*").alias("n"))
    i = tf.join(f, ["conv_id", "term"]).join(n, "conv_id").withColumn("v", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    k = i.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("conv_id", "doc")))).select("conv_id", "doc", "term", "v", "n")
    ask, own = k.filter("doc = 0"), k.filter("doc > 0").select("conv_id", "doc", "term", F.col("v").alias("u"))
    both = ask.drop("doc").join(own, ["conv_id", "term"], "left")
    s = both.filter("doc is not null").groupBy("conv_id", "doc").agg(F.sum(F.col("v") * F.col("u")).alias("s"))
    m = g.filter("doc > 0").select("conv_id", "doc").join(s, ["conv_id", "doc"], "left").groupBy("conv_id").agg(F.max(F.coalesce("s", F.lit(0.0))).alias("top"), F.avg(F.coalesce("s", F.lit(0.0))).alias("mean"))
    b = both.filter("v > 0.3").groupBy("conv_id", "term").agg((F.count("doc") / F.first(F.col("n") - 1)).alias("share")).groupBy("conv_id").agg(F.avg("share").alias("cov"))
    out, cov = m.join(b, "conv_id", "left"), F.coalesce("cov", F.lit(0.5))
    return out.select("conv_id", F.round("top", 5).alias("top"), F.round("mean", 5).alias("mean"), F.round(cov, 5).alias("coverage"), F.round(0.4 * F.col("top") + 0.3 * F.col("mean") + 0.3 * cov, 4).alias("alignment"))


_ONE = lambda w: _BM25.replace("'license'", "'-'").replace("'der'", "'-'").replace("'the'", f"'{w}'")


@query("WITH " + ", ".join(f"u{k} AS (SELECT doc_id, score, {k} AS part FROM ({_ONE(w)} SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 10))" for k, w in enumerate(TERMS)) + f""",
    a AS ({' UNION ALL '.join(f'SELECT * FROM u{k}' for k in range(len(TERMS)))}), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS nth FROM a)
    SELECT doc_id, part, score FROM d WHERE nth = 1 ORDER BY part, score DESC, doc_id LIMIT 20""")
def multi_query_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten documents of each part of a question, each document once, by its first part; twenty in all."""
    docs, found = load(spark, sf_dir, "documents"), None
    for k, term in enumerate(TERMS):
        own = search.top(search.bm25(docs, [term]), 10, "doc_id").select("doc_id", "score", F.lit(k).alias("part"))
        found = own if found is None else found.unionByName(own)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("part"))
    return found.withColumn("nth", nth).filter("nth = 1").select("doc_id", "part", "score").orderBy("part", F.desc("score"), "doc_id").limit(20)


_WEIGHTS = registry.ORACLE["query_weights"]
_DOMAIN = registry.ORACLE["domain_argmax"]
_CONTEXT = "CASE domain " + " ".join(
    f"WHEN '{d}' THEN least(1.0::DOUBLE, {sql.count_of('body', keys)} / {len(keys)} * 0.5::DOUBLE + CASE WHEN {sql.any_of('lower(coalesce(source, ' + chr(39) * 2 + '))', hints)} THEN 0.3 ELSE 0 END::DOUBLE)" for d, (keys, hints) in quality.KNOWLEDGE.items()
) + " ELSE 0 END"
_LIMIT = "CASE WHEN len(regexp_extract_all(query, '\\S+')) > 20 THEN 15 WHEN len(regexp_extract_all(query, '\\S+')) > 10 THEN 10 ELSE 8 END"


@query(_BM25 + f""",
    qs AS (SELECT w.*, query, domain, {_LIMIT} AS lim FROM ({_WEIGHTS}) w JOIN {values(QUESTIONS, 'qid, query')} USING (qid) JOIN ({_DOMAIN}) USING (qid)),
    e AS (SELECT vec_id // 100 + 1 AS qid, embedding AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
    vs AS (SELECT qid, vec_id AS doc_id, lim, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, e JOIN qs USING (qid) WHERE embedding IS NOT NULL),
    v AS (SELECT qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rn FROM vs) WHERE rn <= lim),
    ks AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM r), km AS (SELECT max(score) AS most FROM r),
    k AS (SELECT qid, doc_id, round(score / most, 6) AS score FROM e JOIN qs USING (qid), ks, km WHERE rn <= lim),
    b AS (SELECT qid, doc_id, greatest(v.score, k.score) AS score, CASE WHEN v.score IS NULL THEN 'keyword' WHEN k.score IS NULL THEN 'vector' ELSE 'hybrid' END AS search_type FROM v FULL JOIN k USING (qid, doc_id)),
    x AS (SELECT b.*, qs.* EXCLUDE (qid), lower(text) AS body, source, CASE WHEN entities = '' THEN [] ELSE string_split(entities, '|') END AS ents FROM b JOIN qs USING (qid) JOIN documents USING (doc_id)),
    y AS (SELECT *, [z FOR z IN ents IF contains(body, lower(z))] AS hit FROM x),
    sc AS (SELECT *, CASE WHEN len(ents) = 0 THEN 0 ELSE least(1, coalesce(list_sum([CASE WHEN length(z) > 10 THEN 0.3 WHEN regexp_matches(z, '[0-9]+(?:[.-][0-9]+)+') THEN 0.25 ELSE 0.15 END::DOUBLE FOR z IN hit]), 0) * len(hit) / len(ents)) END AS exact_match,
        CASE WHEN len(ents) = 0 THEN 0 ELSE len(hit) / len(ents) END AS coverage, {_CONTEXT} AS context FROM y),
    f AS (SELECT *, round(w_exact * exact_match + w_semantic * score + w_context * context + w_coverage * coverage, 5) AS final FROM sc)
    SELECT qid, doc_id, search_type, round(score, 6) AS semantic, round(exact_match::DOUBLE, 6) AS exact_match, round(context::DOUBLE, 6) AS context, round(coverage::DOUBLE, 6) AS coverage, final,
           {sql.joined(sql.labels_where({"strong exact match": "exact_match > 0.2", "high semantic similarity": "score > 0.7", "good context": "context > 0.3", "covers the entities": "coverage > 0.5"}), '; ')} || ' (' || query_type || ')' AS explanation
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, doc_id) AS nth FROM f) WHERE nth <= lim""")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from question to documents: both searches, their merge, the relevance score with its parts and
    weights, the limit by question, and an explanation.

    Question k of the literal ones goes with vector 100 (k - 1); keyword scores are shares of the best one.
    """
    rows = literal(spark, QUESTIONS, "qid int, query string")
    q = F.col("query")
    about = rows.select("qid", scoring.entities(q).alias("ents"), tags.domain(q).alias("domain"), scoring.document_limit(q).alias("lim"))
    qs = about.join(_query_weights(rows).select("qid", "query_type", "w_exact", "w_semantic", "w_context", "w_coverage"), "qid")
    emb, docs = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "documents")
    ids = emb.filter("vec_id % 100 = 0 and embedding is not null")
    asked = ids.select((F.floor(F.col("vec_id") / 100) + 1).cast("int").alias("qid")).join(qs.select("qid", "lim"), "qid")
    near = vectors.nearest(emb, ids, 15).select((F.floor(F.col("query_id") / 100) + 1).cast("int").alias("qid"), F.col("vec_id").alias("doc_id"), "score")
    v = near.join(asked, "qid").withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).filter("rn <= lim")
    best = search.top(search.bm25(docs, TERMS), 15, "doc_id").select("doc_id", "score")  # as many as any question takes
    every = Window.partitionBy(F.lit(0))  # fifteen rows
    best = best.withColumns({"rn": F.row_number().over(every.orderBy(F.desc("score"), "doc_id")), "most": F.max("score").over(every)})
    k = asked.join(F.broadcast(best), F.col("rn") <= F.col("lim")).select("qid", "doc_id", F.round(F.col("score") / F.col("most"), 6).alias("k"))
    kind = F.when(F.col("v").isNull(), "keyword").when(F.col("k").isNull(), "vector").otherwise("hybrid")
    both = v.select("qid", "doc_id", F.col("score").alias("v")).join(k, ["qid", "doc_id"], "full_outer").select("qid", "doc_id", F.greatest("v", "k").alias("score"), kind.alias("search_type"))
    x = docs.select("doc_id", "text", "source").join(F.broadcast(both), "doc_id").join(qs, "qid")  # at most 30 rows a question
    c = F.col
    x = x.select("qid", "doc_id", "search_type", "score", "lim", "query_type", "w_exact", "w_semantic", "w_context", "w_coverage", scoring.exact_match(c("ents"), c("text")).alias("exact_match"), scoring.coverage(c("ents"), c("text")).alias("coverage"), F.coalesce(quality.context(c("domain"), c("source"), c("text")), F.lit(0.0)).alias("context"))
    final = c("w_exact") * c("exact_match") + c("w_semantic") * c("score") + c("w_context") * c("context") + c("w_coverage") * c("coverage")
    x = x.withColumn("final", F.round(final, 5)).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final"), "doc_id"))).filter("nth <= lim")
    why = {"strong exact match": c("exact_match") > 0.2, "high semantic similarity": c("score") > 0.7, "good context": c("context") > 0.3, "covers the entities": c("coverage") > 0.5}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in why.items()])), "; ")
    return x.select("qid", "doc_id", "search_type", F.round("score", 6).alias("semantic"), F.round("exact_match", 6).alias("exact_match"), F.round("context", 6).alias("context"), F.round("coverage", 6).alias("coverage"), "final", F.concat(reasons, F.lit(" ("), "query_type", F.lit(")")).alias("explanation"))


@query()
def document_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the documents found for an item it uses, from 0.1; the best one found where none reaches that.

    Items stand for responses, their first lines for the questions. Likeness of sequences has no SQL.
    """
    found = registry.QUERIES["term_overlap_topk"](spark, sf_dir)
    b = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("response"))
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    pairs = found.join(b, "item_id").join(d, "doc_id")  # five documents an item
    own = pairs.select("item_id", "doc_id", "hits", F.round(quality.document_usage(F.col("document"), F.col("response"), F.substring_index("response", "\n", 1)), 6).alias("usage"))
    best = own.groupBy("item_id").agg(F.max("usage").alias("most"), F.min_by("doc_id", F.struct(-F.col("hits"), "doc_id")).alias("first"))
    kept = (F.col("usage") > 0.1) | ((F.col("most") <= 0.1) & (F.col("doc_id") == F.col("first")))
    return own.join(best, "item_id").filter(kept).select("item_id", "doc_id", "usage", (F.col("usage") > 0.1).alias("used"))
