"""Answers of conversations against the other messages of theirs, which stand for the sources they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, dot, n_words, sentences, terms
from ..operators import ingest, scoring, vectors
from ..sources.tables import load
from . import registry
from .registry import query

_PAIRS = """
    WITH s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS sources FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
    q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
    p AS (SELECT c.conv_id, c.turn, c.text AS response, lower(c.text) AS low, sources, lower(sources) AS src, question FROM conversations c JOIN s USING (conv_id) JOIN q USING (conv_id) WHERE role = 'assistant')"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, response, sources, question): grouped and joined on the conversation alone."""
    c = load(spark, sf_dir, "conversations")
    parts = F.array_sort(F.collect_list(F.when(F.col("role") != "assistant", F.struct("turn", "text"))))
    s = c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("sources"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("question"), F.count_if(F.col("role") == "user").alias("_n"))
    own = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response"))
    return own.join(s.filter("_n > 0").drop("_n"), "conv_id")


_T4 = "list_distinct(regexp_extract_all(low, '[a-z0-9_]{4,}'))"
_GROUNDED = f"CASE WHEN len({_T4}) = 0 THEN 0.5 ELSE len([t FOR t IN {_T4} IF contains(src, t)]) / len({_T4}) END"
_RISK = "(" + " + ".join(f"contains(low, '{g}')::INT" for g in scoring.GENERIC) + f") / {len(scoring.GENERIC)}"
_QW = "list_distinct(regexp_extract_all(lower(question), '\\S+'))"
_OVER = f"CASE WHEN len({_QW}) = 0 THEN 0 ELSE len(list_intersect({_QW}, regexp_extract_all(src, '\\S+'))) / len({_QW}) END"


@query(_PAIRS + f""", v AS (SELECT conv_id, turn, least(1, {_OVER} * 2)::DOUBLE AS rel, ({_GROUNDED})::DOUBLE AS grounded, ({_RISK})::DOUBLE AS risk FROM p)
    SELECT conv_id, turn, round(rel, 6) AS relevance, round(grounded, 6) AS grounding, round(risk, 6) AS risk, round((rel + grounded + 1 - risk) / 3, 6) AS score,
           (rel + grounded + 1 - risk) / 3 >= 0.3 AS valid FROM v""")
def simple_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    rel = F.least(F.lit(1.0), scoring.word_overlap(F.col("question"), F.col("sources")) * 2)
    v = p.select("conv_id", "turn", rel.alias("rel"), scoring.grounded_terms(F.col("response"), F.col("sources")).alias("g"), scoring.generic_risk(F.col("response")).alias("k"))
    s = (F.col("rel") + F.col("g") + 1 - F.col("k")) / 3
    return v.select("conv_id", "turn", F.round("rel", 6).alias("relevance"), F.round("g", 6).alias("grounding"), F.round("k", 6).alias("risk"), F.round(s, 6).alias("score"), (s >= 0.3).alias("valid"))


_CLAIM = "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in scoring.CLAIMING) + ")"
_EMPTY = ", ".join(f"'{w}'" for w in scoring.EMPTY_WORDS)
_COVER = f"""
    , c AS (SELECT conv_id, turn, src, unnest([lower(trim(x)) FOR x IN regexp_split_to_array(response, '[.!?]+') IF length(trim(x)) > 9 AND {_CLAIM}]) AS claim FROM p),
    t AS (SELECT conv_id, turn, src, [w FOR w IN regexp_extract_all(claim, '[a-z0-9_]{{4,}}') IF w NOT IN ({_EMPTY})] AS w FROM c),
    e AS (SELECT conv_id, turn, count_if(len(w) > 0 AND len([x FOR x IN w IF contains(src, x)]) >= 0.7::DOUBLE * len(w)) / count(*) AS cover FROM t GROUP BY conv_id, turn)"""


@query(_PAIRS + _COVER + " SELECT p.conv_id, p.turn, round(coalesce(cover, 0.5)::DOUBLE, 6) AS coverage FROM p LEFT JOIN e USING (conv_id, turn)")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(scoring.evidence_coverage(F.col("response"), F.col("sources")), 6).alias("coverage"))


def _alignment() -> Column:
    """From the terms of question, answer and sources in q, r and d; 0.5 without terms."""
    both = (F.size(F.array_intersect("q", "r")) / F.size("q") + F.size(F.array_intersect("r", "d")) / F.size("r")) / 2
    return F.when((F.size("q") == 0) | (F.size("r") == 0), 0.5).otherwise(both)


@query(_PAIRS + f"""
    , v AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]{{4,}}')) AS qc, {_T4} AS rc, list_distinct(regexp_extract_all(src, '[a-z0-9_]{{4,}}')) AS dc FROM p)
    SELECT conv_id, turn, round(CASE WHEN len(qc) = 0 OR len(rc) = 0 THEN 0.5 ELSE (len(list_intersect(qc, rc)) / len(qc) + len(list_intersect(rc, dc)) / len(rc)) / 2 END::DOUBLE, 6) AS alignment FROM v""")
def concept_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _pairs(spark, sf_dir).select("conv_id", "turn", terms(F.col("question")).alias("q"), terms(F.col("response")).alias("r"), terms(F.col("sources")).alias("d"))
    return v.select("conv_id", "turn", F.round(_alignment(), 6).alias("alignment"))


def _attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, n_segments, share) of answers that have sentences."""
    c = load(spark, sf_dir, "conversations")
    seg = c.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(sentences(F.col("text"), 10)).alias("pos", "s")).select("conv_id", "turn", "pos", terms(F.col("s")).alias("w"))
    d = c.filter("role <> 'assistant'").select("conv_id", terms(F.col("text")).alias("d"))
    over = F.when(F.size("w") > 0, F.size(F.array_intersect("w", "d")) / F.size("w")).otherwise(0.0)
    best = seg.join(d, "conv_id").groupBy("conv_id", "turn", "pos").agg(F.max(over).alias("best"))
    return best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_segments"), (F.count_if(F.col("best") >= 0.25) / F.count("*")).alias("share"))

@query(_PAIRS + """
    , g AS (SELECT conv_id, turn, pos, list_distinct(regexp_extract_all(lower(seg), '[a-z0-9_]{4,}')) AS w FROM (SELECT conv_id, turn, unnest([trim(x) FOR x IN regexp_split_to_array(response, '[.!?]+') IF length(trim(x)) > 10]) AS seg,
            unnest(range(0, len([x FOR x IN regexp_split_to_array(response, '[.!?]+') IF length(trim(x)) > 10]))) AS pos FROM p)),
    d AS (SELECT conv_id, turn AS source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS w FROM conversations WHERE role <> 'assistant'),
    m AS (SELECT g.conv_id, g.turn, pos, max(CASE WHEN len(g.w) > 0 THEN len(list_intersect(g.w, d.w)) / len(g.w) ELSE 0 END) AS best FROM g JOIN d ON d.conv_id = g.conv_id GROUP BY ALL)
    SELECT conv_id, turn, count(*) AS n_segments, round(count_if(best >= 0.25::DOUBLE) / count(*), 6) AS attributed FROM m GROUP BY conv_id, turn""")
def source_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of sentences of which one source holds at least a quarter of the terms."""
    return _attribution(spark, sf_dir).select("conv_id", "turn", "n_segments", F.round("share", 6).alias("attributed"))


_RISKS = [r"(?is)current ratio.*current assets.*current liabilities", r"(?i)generally accepted accounting principles", r"(?im)^(?:here are|the following are|these include)", r"(?i)in general|typically|usually|commonly", r"(?i)license"]


@query(_PAIRS + " SELECT conv_id, turn, round((" + " + ".join(f"(regexp_matches(response, '{r}') AND NOT regexp_matches(sources, '{r}'))::INT" for r in _RISKS) + f") / {len(_RISKS)}::DOUBLE, 6) AS risk FROM p")
def hallucination_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of template phrases that an answer has and its sources don't."""
    signs = sum(((F.col("response").rlike(r) & ~F.col("sources").rlike(r)).cast("int") for r in _RISKS), F.lit(0))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(signs / float(len(_RISKS)), 6).alias("risk"))


@query(_PAIRS + _COVER + f"""
    , v AS (SELECT p.conv_id, p.turn, coalesce(cover, 0.5)::DOUBLE AS a, ({_GROUNDED})::DOUBLE AS b, ({_RISK})::DOUBLE AS r FROM p LEFT JOIN e USING (conv_id, turn))
    SELECT conv_id, turn, round((0.3::DOUBLE * a + 0.25::DOUBLE * b) / 0.55::DOUBLE * (1 - 0.5::DOUBLE * r), 6) AS score,
           (0.3::DOUBLE * a + 0.25::DOUBLE * b) / 0.55::DOUBLE * (1 - 0.5::DOUBLE * r) >= 0.4 + CASE WHEN r > 0.7 THEN 0.2 ELSE 0 END AS grounded FROM v""")
def grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("response")
    v = _pairs(spark, sf_dir).select("conv_id", "turn", scoring.evidence_coverage(r, F.col("sources")).alias("a"), scoring.grounded_terms(r, F.col("sources")).alias("b"), scoring.generic_risk(r).alias("k"))
    s = scoring.grounding_score({"a": F.col("a"), "b": F.col("b")}, {"a": 0.3, "b": 0.25}, F.col("k"))
    return v.select("conv_id", "turn", F.round(s, 6).alias("score"), (s >= 0.4 + F.when(F.col("k") > 0.7, 0.2).otherwise(0.0)).alias("grounded"))


@query(_PAIRS + _COVER + f"""
    , ca AS (SELECT conv_id, turn, response, low, src, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]{{4,}}')) AS qc, {_T4} AS rc, list_distinct(regexp_extract_all(src, '[a-z0-9_]{{4,}}')) AS dc FROM p),
    att AS (SELECT conv_id, turn, attributed FROM ({registry.ORACLE["source_attribution"].replace("round(count_if(best >= 0.25::DOUBLE) / count(*), 6)", "count_if(best >= 0.25::DOUBLE) / count(*)")})),
    v AS (SELECT ca.conv_id, ca.turn, 0.3::DOUBLE * coalesce(cover, 0.5)::DOUBLE + 0.25::DOUBLE
            + 0.2::DOUBLE * CASE WHEN len(qc) = 0 OR len(rc) = 0 THEN 0.5 ELSE (len(list_intersect(qc, rc)) / len(qc) + len(list_intersect(rc, dc)) / len(rc)) / 2 END::DOUBLE
            + 0.25::DOUBLE * coalesce(attributed, 0.5)::DOUBLE AS s, ({_RISK})::DOUBLE AS r FROM ca LEFT JOIN e USING (conv_id, turn) LEFT JOIN att USING (conv_id, turn))
    SELECT conv_id, turn, round(s * (1 - 0.5::DOUBLE * r), 6) AS score, s * (1 - 0.5::DOUBLE * r) >= 0.4 + CASE WHEN r > 0.7 THEN 0.2 ELSE 0 END AS grounded FROM v""")
def grounding_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts by weights, less by risk; an answer without sentences counts as half attributed.

    Numbers are not checked: their part is always 1.
    """
    r = F.col("response")
    parts = {"evidence": scoring.evidence_coverage(r, F.col("sources")), "numbers": F.lit(1.0), "concepts": _alignment(), "attribution": F.coalesce("share", F.lit(0.5))}
    v = _pairs(spark, sf_dir).join(_attribution(spark, sf_dir), ["conv_id", "turn"], "left").withColumns({"q": terms(F.col("question")), "r": terms(r), "d": terms(F.col("sources"))})
    v = v.select("conv_id", "turn", *[c.alias(k) for k, c in parts.items()], scoring.generic_risk(r).alias("k"))
    s = scoring.grounding_score({k: F.col(k) for k in parts}, {"evidence": 0.3, "numbers": 0.25, "concepts": 0.2, "attribution": 0.25}, F.col("k"))
    return v.select("conv_id", "turn", F.round(s, 6).alias("score"), (s >= 0.4 + F.when(F.col("k") > 0.7, 0.2).otherwise(0.0)).alias("grounded"))


@query(_PAIRS + """
    SELECT conv_id, turn, CAST(len(n) AS BIGINT) AS n_numbers, len([x FOR x IN n IF NOT contains(sources, x)]) = 0 AS all_found
    FROM (SELECT *, [x FOR x IN list_distinct(regexp_extract_all(response, '[0-9]+')) IF length(x) > 1] AS n FROM p)""")
def strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all numbers of two digits and more of an answer occur in its sources."""
    n = F.filter(F.array_distinct(F.regexp_extract_all("response", F.lit("[0-9]+"), F.lit(0))), lambda x: F.length(x) > 1)
    p = _pairs(spark, sf_dir).withColumn("n", n)
    return p.select("conv_id", "turn", F.size("n").cast("long").alias("n_numbers"), F.forall("n", lambda x: F.contains("sources", x)).alias("all_found"))


@query("""
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT label, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS c FROM embeddings, q)
    SELECT label, round(0.7::DOUBLE * max(c) + 0.3::DOUBLE * avg(c), 6) AS alignment, round(stddev_pop(c), 6) AS spread,
           CASE WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'medium' ELSE 'low' END AS confidence FROM s GROUP BY label""")
def alignment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    q = v.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    s = v.crossJoin(F.broadcast(q)).select("label", dot(F.col("embedding"), F.col("q")).alias("c"))
    n = F.count("*")
    return s.groupBy("label").agg(F.round(0.7 * F.max("c") + 0.3 * F.avg("c"), 6).alias("alignment"), F.round(F.stddev_pop("c"), 6).alias("spread"), F.when(n >= 50, "high").when(n >= 20, "medium").otherwise("low").alias("confidence"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
    s AS (SELECT query_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS c FROM embeddings, q WHERE embedding IS NOT NULL)
    SELECT query_id, label, round(0.7::DOUBLE * max(c) + 0.3::DOUBLE * avg(c), 6) AS alignment, round(stddev_pop(c), 6) AS spread,
           CASE WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'medium' ELSE 'low' END AS confidence FROM s GROUP BY query_id, label""")
def alignment_aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``alignment_aggregate`` for every row whose id is divisible by 100."""
    v = load(spark, sf_dir, "embeddings")
    s = vectors.above(v, v.filter("vec_id % 100 = 0"), -1e9)  # every pair is summed where it is made
    n = F.count("*")
    return s.groupBy("query_id", "label").agg(F.round(0.7 * F.max("score") + 0.3 * F.avg("score"), 6).alias("alignment"), F.round(F.stddev_pop("score"), 6).alias("spread"), F.when(n >= 50, "high").when(n >= 20, "medium").otherwise("low").alias("confidence"))


@query("""
    WITH r AS (SELECT conv_id, turn, text, lower(text) AS low, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, round(0.3::DOUBLE * least(1, n / 200) + 0.3::DOUBLE * CASE WHEN contains(text, '[') THEN 1 ELSE 0.5 END::DOUBLE
           + 0.2::DOUBLE * CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0.5 END::DOUBLE + 0.2::DOUBLE * CASE WHEN contains(low, ' the ') THEN 1 ELSE 0 END, 6) AS quality,
           CAST(least(4000, 2000 + 500 * (n > 50)::INT + 500 * (n > 200)::INT + 1000 * contains(low, 'compare')::INT) AS BIGINT) AS token_budget FROM r""")
def response_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, accuracy, format and relevance of answers; tokens that they may take."""
    t, n = F.col("text"), n_words(F.col("text"))
    q = 0.3 * F.least(F.lit(1.0), n / 200) + 0.3 * F.when(F.contains(t, F.lit("[")), 1.0).otherwise(0.5) + 0.2 * F.when(F.contains(t, F.lit("\n")), 1.0).otherwise(0.5) + 0.2 * F.when(any_of(F.lower(t), [" the "]), 1.0).otherwise(0.0)
    budget = F.least(F.lit(4000), 2000 + 500 * (n > 50).cast("int") + 500 * (n > 200).cast("int") + 1000 * F.contains(F.lower(t), F.lit("compare")).cast("int"))
    return load(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.round(q, 6).alias("quality"), budget.cast("long").alias("token_budget"))


@query("""
    WITH v AS (SELECT conv_id, turn, 1.0::DOUBLE - 0.1::DOUBLE * (contains(lower(text), 'der')::INT + contains(lower(text), 'les')::INT + contains(lower(text), 'que')::INT) AS s,
                      contains(lower(text), 'der')::INT + contains(lower(text), 'les')::INT + contains(lower(text), 'que')::INT AS k FROM conversations),
    w AS (SELECT *, count_if(k <= 1) OVER (PARTITION BY conv_id) AS kept, count(*) OVER (PARTITION BY conv_id) AS n FROM v)
    SELECT conv_id, turn, round(CASE WHEN kept < 0.3 * n THEN 1.0 ELSE s END::DOUBLE, 6) AS score FROM w WHERE k <= 1 OR kept < 0.3 * n""")
def negative_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth less for each conflicting word, at most one; undone where under three tenths would stay."""
    low = F.lower("text")
    k = sum((F.contains(low, F.lit(x)).cast("int") for x in ("der", "les", "que")), F.lit(0))
    w = Window.partitionBy("conv_id")
    v = load(spark, sf_dir, "conversations").select("conv_id", "turn", k.alias("k")).withColumns({"kept": F.count_if(F.col("k") <= 1).over(w), "n": F.count("*").over(w)})
    undone = F.col("kept") < 0.3 * F.col("n")
    return v.filter((F.col("k") <= 1) | undone).select("conv_id", "turn", F.round(F.when(undone, 1.0).otherwise(1.0 - 0.1 * F.col("k")), 6).alias("score"))


@query("""
    WITH v AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS id FROM documents WHERE contains(lower(text), 'license') AND source IS NOT NULL)
    SELECT doc_id, id AS citation, source || ' [' || id || ']' AS label, left(text, 200) AS excerpt FROM v""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered citations with an excerpt, after the filter."""
    own = load(spark, sf_dir, "documents").filter(F.contains(F.lower("text"), F.lit("license")) & F.col("source").isNotNull())
    v = ingest.numbered(own.select("doc_id", "source", F.substring("text", 1, 200).alias("excerpt")), "source", "doc_id", "id")
    return v.select("doc_id", F.col("id").alias("citation"), F.concat("source", F.lit(" ["), F.col("id").cast("string"), F.lit("]")).alias("label"), "excerpt")


@query("""
    SELECT conv_id, turn, k AS chunk, array_to_string(w[k * 5 + 1 : k * 5 + 5], ' ') AS part FROM (SELECT conv_id, turn, w, unnest(range(0, CAST(ceil(len(w) / 5.0) AS BIGINT))) AS k
        FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS w FROM conversations WHERE role = 'assistant'))""")
def answer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they are streamed, five words at a time."""
    own = load(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), (F.ceil(F.size("w") / 5) - 1).cast("long")), lambda k: F.array_join(F.slice("w", (k * 5 + 1).cast("int"), F.lit(5)), " "))
    return own.select("conv_id", "turn", F.posexplode(cut).alias("chunk", "part")).withColumn("chunk", F.col("chunk").cast("long"))


_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_SET = lambda c: f"list_distinct([w FOR w IN regexp_extract_all(lower({c}), '{scoring.WORD}') IF w IN ({_IN(scoring.FIELD_CONCEPTS)})] || [w FOR w IN regexp_extract_all(lower({c}), '{scoring.WORD}') IF regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN ({_IN(scoring.NO_CONCEPTS)})][1:10])"


@query(f"""
    WITH q AS (SELECT conv_id, {_SET('arg_min(text, turn)')} AS q FROM conversations WHERE role = 'user' GROUP BY conv_id),
    d AS (SELECT conv_id, list_distinct(flatten(list({_SET('text')}))) AS d FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
    a AS (SELECT conv_id, turn, {_SET('text')} AS r FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, round(CASE WHEN len(q) = 0 OR len(r) = 0 THEN 0.5 ELSE (len(list_intersect(q, r)) / len(q) + len(list_intersect(r, d)) / len(r)) / 2 END::DOUBLE, 6) AS alignment
    FROM a JOIN q USING (conv_id) JOIN d USING (conv_id)""")
def concept_alignment_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the question's concepts in the answer and of the answer's in the sources: words of the field, and the first
    ten meaning words of the question, the answer and each source.
    """
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", scoring.concepts(F.col("text")).alias("c"))
    q = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("c", "turn").alias("q"))
    d = c.filter("role <> 'assistant'").select("conv_id", F.explode("c").alias("w")).groupBy("conv_id").agg(F.collect_set("w").alias("d"))
    a = c.filter("role = 'assistant'").join(q, "conv_id").join(d, "conv_id", "left")
    both = (F.size(F.array_intersect("q", "c")) / F.size("q") + F.coalesce(F.size(F.array_intersect("c", "d")), F.lit(0)) / F.size("c")) / 2
    return a.select("conv_id", "turn", F.round(F.when((F.size("q") == 0) | (F.size("c") == 0), 0.5).otherwise(both), 6).alias("alignment"))


_BARE = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(_PAIRS + f"""
    , x AS (SELECT conv_id, turn, sources, src, regexp_extract_all(response, '{scoring.FORMULA}') AS f, regexp_extract_all(response, '{scoring.NUMBER}') AS n,
        [w FOR w IN regexp_extract_all(response, '{scoring.WORD}') IF regexp_matches(w, '^[A-Z]{{2,5}}$')]
        || [t FOR t IN regexp_extract_all(regexp_replace(response, '{scoring.MASKED}', '#', 'g'), '{scoring.THREE}') IF {' OR '.join(f"contains(lower(t), '{w}')" for w in scoring.TECHNICAL)}] AS c FROM p),
    y AS (SELECT conv_id, turn,
        len([g FOR g IN f IF NOT (len([h FOR h IN regexp_split_to_array(g, '[=+*/()-]') IF length({_BARE('h')}) > 2 AND contains(sources, {_BARE('h')})]) > 0 OR contains(sources, g) OR contains(sources, replace(replace(g, '×', '*'), ' ', '')))]) AS f,
        len([m FOR m IN n IF m NOT IN ('1', '2', '3') AND length(m) > 1 AND NOT contains(sources, m) AND NOT contains(sources, regexp_replace(m, '^\\$+|%+$', '', 'g'))]) AS n,
        len([t FOR t IN c IF NOT contains(src, lower(t)) AND len([w FOR w IN regexp_split_to_array(t, '\\s+') IF length(w) > 3 AND contains(src, lower(w))]) = 0]) AS c FROM x)
    SELECT conv_id, turn, f::BIGINT AS n_formulas, n::BIGINT AS n_numbers, c::BIGINT AS n_claims, round(((f = 0)::INT + (n = 0)::INT + (c = 0)::INT) / 3, 6) AS score, f = 0 AND n = 0 AND c = 0 AS grounded,
           round(least(1, ((f = 0)::INT + (n = 0)::INT + (c = 0)::INT) / 3 + 0.3), 6) AS confidence FROM y""")
def strict_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas, numbers and technical claims of an answer that its sources don't hold; grounded only without any."""
    p = _pairs(spark, sf_dir)
    missing = scoring.ungrounded(F.col("response"), F.col("sources"))
    own = p.select("conv_id", "turn", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in missing.items()])
    passed = sum(((F.col(f"n_{k}") == 0).cast("int") for k in missing), F.lit(0))
    return own.withColumns({"score": F.round(passed / 3, 6), "grounded": passed == 3, "confidence": F.round(F.least(F.lit(1.0), passed / 3 + 0.3), 6)})
