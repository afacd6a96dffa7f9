"""Questions searched by their own words: stored postings of titles and texts, parts of a question, and both searches fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stem import stem, stem_sql
from ..operators import lexicon, postings, vectors
from ..operators import questions as ask
from ..sources.tables import load
from . import concepts, registry
from .registry import query
from .tagging import _ALL, _all_questions
from .understanding import asked

_STOP = ", ".join(f"'{w}'" for w in ask.STOP)
_OK = lambda w: f"length({w}) >= 2 AND {w} NOT IN ({_STOP})"

#: The index as rows: iw (document, field, place, word), it (with stems), ip (term, field, document, positions), sizes, idf.
_INDEX = f"""
    ib AS (SELECT doc_id, 0 AS field, lower(left(split_part(coalesce(text, ''), chr(10), 1), 80)) AS t FROM documents UNION ALL SELECT doc_id, 1, lower(coalesce(text, '')) FROM documents),
    iu AS (SELECT doc_id, field, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(t, '[a-z0-9]+'), 1) AS pos FROM ib),
    iw AS MATERIALIZED (SELECT * FROM iu WHERE {_OK('word')}),
    iv AS ({stem_sql('(SELECT DISTINCT word FROM iw)', 'word')}), it AS (SELECT doc_id, field, pos, stem AS term FROM iw JOIN iv USING (word)),
    ip AS (SELECT term, field, doc_id, count(*) AS n, list(pos) AS pos FROM it GROUP BY ALL),
    isz AS (SELECT doc_id, field, count(*) AS size FROM it GROUP BY ALL), im AS (SELECT field, count(*) / (SELECT count(*) FROM documents) AS mean FROM it GROUP BY field),
    idf AS (SELECT term, field, ln((SELECT count(*) FROM documents)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM ip GROUP BY ALL),
    ir AS (SELECT ip.*, idf, 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean) AS norm FROM ip JOIN isz USING (doc_id, field) JOIN im USING (field) JOIN idf USING (term, field))"""


def _found(rows: str) -> str:
    """CTEs that search each (ask, text) of ``rows``; ``found`` holds ask, doc_id, score."""
    return f"""
    qu AS (SELECT ask, text LIKE '"%' AS phrase, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), 1) AS pos FROM {rows}),
    qw AS (SELECT * FROM qu WHERE {_OK('word')}), qv AS ({stem_sql('(SELECT DISTINCT word FROM qw)', 'word')}),
    qt AS (SELECT ask, phrase, stem AS term, pos - min(pos) OVER (PARTITION BY ask) AS place FROM qw JOIN qv USING (word)),
    qn AS (SELECT ask, any_value(phrase) AS phrase, count(*) AS places, count(DISTINCT term) AS n_terms FROM qt GROUP BY ask),
    fa AS (SELECT ask, doc_id, sum(idf * n * 2.2::DOUBLE / (n + norm)) AS score FROM (SELECT DISTINCT ask, term FROM qt WHERE NOT phrase) JOIN ir USING (term) JOIN qn USING (ask) GROUP BY ask, doc_id HAVING count(DISTINCT term) = any_value(n_terms)),
    fp AS (SELECT ask, doc_id, field, p, sum(idf) AS idf, any_value(norm) AS norm FROM (SELECT ask, doc_id, field, idf, norm, place, unnest(pos) - place AS p FROM qt JOIN ir USING (term) WHERE phrase) JOIN qn USING (ask)
           GROUP BY ask, doc_id, field, p HAVING count(*) = any_value(places)),
    fq AS (SELECT ask, doc_id, sum(s) AS score FROM (SELECT ask, doc_id, field, any_value(idf) * count(*) * 2.2::DOUBLE / (count(*) + any_value(norm)) AS s FROM fp GROUP BY ask, doc_id, field) GROUP BY ask, doc_id),
    found AS (SELECT ask, doc_id, round(score, 4) AS score FROM (SELECT * FROM fa UNION ALL SELECT * FROM fq)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS rn FROM found) WHERE rn <= 10)"""


def _index(spark: SparkSession, sf_dir: str) -> postings.PostingIndex:
    """Postings of titles (the first line, 80 signs of it) and whole texts."""
    title = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 80)
    return postings.index(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", [title, F.col("text")])


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ask.parsed(asked(spark, sf_dir))
    return p.withColumn("focused", ask.focused(F.col("query"), F.col("phrases"), F.col("keywords")))


_REWRITTEN = f"rw AS ({registry.ORACLE['query_rewrite']})"


@query(f"WITH {_REWRITTEN}, {_INDEX}, {_found('(SELECT qid AS ask, focused AS text FROM rw)')} SELECT ask AS qid, doc_id, score FROM best")
def question_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every question by its own rewritten words: a phrase, or all of its keywords."""
    rows = _rewritten(spark, sf_dir).select("qid", "focused")
    return postings.search(_index(spark, sf_dir), rows, "qid", "focused", 10)


_PARTS = """pq AS (SELECT qid, unnest(list_prepend(focused, [x FOR x IN string_split(named, '|') IF x <> '']
        || [x FOR x IN string_split(keywords, ' ')[1:3] IF x <> ''])) AS text, generate_subscripts(list_prepend(focused, [x FOR x IN string_split(named, '|') IF x <> '']
        || [x FOR x IN string_split(keywords, ' ')[1:3] IF x <> '']), 1) - 1 AS part FROM rw)"""


@query(f"""WITH {_REWRITTEN}, {_PARTS}, {_INDEX}, {_found("(SELECT qid || '#' || part AS ask, text FROM pq)")},
    fo AS (SELECT qid, part, doc_id, score, row_number() OVER (PARTITION BY qid, doc_id ORDER BY part, score DESC) AS nth FROM best JOIN pq ON ask = qid || '#' || part)
    SELECT qid, CAST(part AS INTEGER) AS part, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, score DESC, doc_id) AS rn FROM fo WHERE nth = 1) WHERE rn <= 20""")
def question_parts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question in parts (rewritten, its names, its first three keywords), each searched; twenty documents in all."""
    texts = F.concat(F.array("focused"), F.col("named"), F.slice("keywords", 1, 3))
    parts = _rewritten(spark, sf_dir).select("qid", F.posexplode(texts).alias("part", "text"))
    parts = parts.filter(F.col("text") != "").select(F.struct("qid", "part").alias("ask"), "text")
    found = postings.search(_index(spark, sf_dir), parts, "ask", "text", 10).select("ask.*", "doc_id", "score")
    return postings.first_parts(found, "qid", "part", "doc_id", 20).select("qid", "part", "doc_id", "score")


#: Fixed value: codes of a standard in a question.
_CODE = r"ASC\s+[0-9]{3}-[0-9]{2}-[0-9]{2}-[0-9]{1,2}"


@query(f"""WITH rw AS (SELECT * FROM ({registry.ORACLE['query_rewrite']}) AS x WHERE qid LIKE 'b%'), {_INDEX}, {_found('(SELECT qid AS ask, focused AS text FROM rw)')},
    ve AS (SELECT 'b' || (vec_id // 100) AS ask, embedding AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL AND 'b' || (vec_id // 100) IN (SELECT qid FROM rw)),
    vs AS (SELECT ask, vec_id AS doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, ve WHERE embedding IS NOT NULL),
    vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS rn FROM vs) WHERE rn <= 10),
    vn AS (SELECT ask, doc_id, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS v FROM vt WINDOW w AS (PARTITION BY ask)),
    kn AS (SELECT ask, doc_id, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 0 END AS k FROM best WINDOW w AS (PARTITION BY ask)),
    co AS (SELECT 'b' || item_id AS ask, regexp_extract_all(upper(text), '{_CODE}') AS codes FROM benchmark WHERE regexp_matches(upper(text), '{_CODE}')),
    bo AS (SELECT ask, doc_id, coalesce(v, 0) AS v, coalesce(k, 0) AS k FROM vn FULL JOIN kn USING (ask, doc_id)),
    fu AS (SELECT bo.ask, bo.doc_id, round(0.6::DOUBLE * v + 0.4::DOUBLE * k + 0.5::DOUBLE * coalesce(len([c FOR c IN codes IF contains(upper(text), c)]), 0), 4) AS score FROM bo LEFT JOIN co USING (ask) LEFT JOIN documents d ON d.doc_id = bo.doc_id)
    SELECT ask AS qid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id) AS rn FROM fu) WHERE rn <= 20""")
def question_fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector search of every benchmark item, fused with a bonus for codes that a document holds word by word.

    Item k asks with vector 100 k, where there is one.
    """
    rows = _rewritten(spark, sf_dir).filter(F.startswith("qid", F.lit("b"))).select("qid", "focused")
    keyword = postings.search(_index(spark, sf_dir), rows, "qid", "focused", 10)
    v = load(spark, sf_dir, "embeddings")
    named = F.concat(F.lit("b"), F.floor(F.col("query_id") / 100).cast("string"))
    near = vectors.nearest(v, v.filter("vec_id % 100 = 0"), 10).select(named.alias("qid"), F.col("vec_id").alias("doc_id"), "score").join(rows.select("qid"), "qid", "left_semi")
    hits = near.select("qid", "doc_id").union(keyword.select("qid", "doc_id")).distinct()
    coded = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.regexp_extract_all(F.upper("text"), F.lit(_CODE), F.lit(0)).alias("codes")).filter(F.size("codes") > 0)
    texts = load(spark, sf_dir, "documents").select("doc_id", F.upper("text").alias("t"))
    codes = hits.join(coded, "qid").join(texts, "doc_id").select("qid", "doc_id", F.size(F.filter("codes", lambda c: F.contains("t", c))).alias("n"))
    return postings.fused(near, keyword, codes, "qid", "doc_id", 20).select("qid", "doc_id", "score")


#: Terms of a lexicon that the benchmark items give: their words of seven signs and more, and the words' stems as aliases.
_LEXICON = f"""lw AS (SELECT DISTINCT item_id AS category, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark),
    ls AS (SELECT category, word, stem FROM ({stem_sql('lw', 'word')}) WHERE length(word) >= 7),
    lx AS (SELECT category, word AS term, 1.0::DOUBLE AS weight FROM ls UNION ALL SELECT category, stem, 0.8::DOUBLE FROM ls WHERE stem <> word)"""


@query(f"""WITH {_LEXICON}, lt AS (SELECT DISTINCT term FROM lx), lh AS (SELECT doc_id, term FROM (SELECT doc_id, lower(text) AS body FROM documents), lt WHERE contains(body, term)),
    lg AS (SELECT doc_id, category, sum(weight) AS points FROM lh JOIN lx USING (term) GROUP BY ALL)
    SELECT doc_id, category, round(points / max(points) OVER (PARTITION BY doc_id), 6) AS score FROM lg""")
def lexicon_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each category of a lexicon a document holds, as a share of its best: 1 a term, 0.8 an alias.

    The lexicon is a table: each benchmark item is a category, its long words are terms, their stems aliases.
    """
    words = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("category"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    own = words.filter(F.length("word") >= 7).distinct().withColumn("stem", stem(F.col("word")))
    rows = own.select("category", F.col("word").alias("term"), F.lit(1.0).alias("weight")).unionByName(own.filter("stem <> word").select("category", F.col("stem").alias("term"), F.lit(0.8).alias("weight")))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body"))
    return lexicon.categories(docs, rows, "doc_id", "body").select("doc_id", "category", F.round("score", 6).alias("score"))


@query("""
    WITH t AS (SELECT item_id, term, place FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[^\t-\r\x1C-\x20\x85\xA0]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[^\t-\r\x1C-\x20\x85\xA0]+'), 1) AS place FROM benchmark)),
    s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.!?]+'))) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?]+'), 1) AS pos FROM documents),
    h AS (SELECT item_id, doc_id, place, pos, s FROM s, t WHERE length(s) > 10 AND contains(lower(s), term)),
    f AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS nth FROM (SELECT DISTINCT item_id, doc_id FROM h)),
    n AS (SELECT item_id, doc_id, left(s, 200) || '...' AS sentence, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY place, pos) AS rn FROM h JOIN f USING (item_id, doc_id) WHERE nth <= 2)
    SELECT item_id, doc_id, rn, sentence FROM n WHERE rn <= 3""")
def upload_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item three sentences of each of the first two documents that hold one of its words in a sentence."""
    b = load(spark, sf_dir, "benchmark")
    terms = b.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[^\\t-\\r\\x1C-\\x20\\x85\\xA0]+"), F.lit(0))).alias("place", "term"))
    parts = F.transform(F.split("text", "[.!?]+"), lambda x, k: F.struct(k.alias("pos"), F.trim(x).alias("s")))
    docs = load(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.filter(parts, lambda x: F.length(x["s"]) > 10)).alias("x")).select("doc_id", F.lower("x.s").alias("low"))
    # The first two documents of an item are among the first two of one of its words.
    rn = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))
    first = lexicon.hits(lines, terms.select("term"), "doc_id", "low").distinct().withColumn("rn", rn("term")).filter("rn <= 2").drop("rn")
    chosen = first.join(terms.select("item_id", "term").distinct(), "term").select("item_id", "doc_id").distinct().withColumn("rn", rn("item_id")).filter("rn <= 2").drop("rn")
    own = docs.select("doc_id", F.filter(parts, lambda x: F.length(x["s"]) > 10).alias("xs")).join(chosen, "doc_id").join(terms, "item_id")
    held = own.select("item_id", "doc_id", "place", F.explode(F.filter("xs", lambda x: F.contains(F.lower(x["s"]), F.col("term")))).alias("x"))
    nth = F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("place", "x.pos"))
    return held.withColumn("rn", nth.cast("long")).filter("rn <= 3").select("item_id", "doc_id", "rn", F.concat(F.substring("x.s", 1, 200), F.lit("...")).alias("sentence"))


_PAIRS = registry.ORACLE["mutual_exclusion"]


def _concepts_held(docs: DataFrame) -> DataFrame:
    """(doc_id, held): the concepts that each text holds anywhere, so that a join by document carries no texts."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    return low.select("doc_id", F.array_compact(F.array(*[F.when(F.contains("body", F.lit(c)), F.lit(c)) for c in concepts.CONCEPTS])).alias("held"))


@query(f"""
    WITH s AS ({registry.ORACLE['question_search']}), t AS ({registry.ORACLE['processing_tier_similar']}), z AS (SELECT a, b FROM ({_PAIRS}) WHERE exclusion > 0.1),
    q AS (SELECT qid, lower(query) AS low FROM {_ALL}),
    c AS (SELECT DISTINCT qid, unnest([a, b]) AS concept FROM q, z WHERE contains(low, a) OR contains(low, b)),
    h AS (SELECT s.qid, tier, s.doc_id, s.score, lower(text) AS body FROM s JOIN t USING (qid) JOIN documents USING (doc_id)),
    n AS (SELECT h.qid, h.tier, h.doc_id, h.score, count(c.concept) AS n FROM h LEFT JOIN c ON c.qid = h.qid AND h.tier <> 'fast' AND contains(h.body, c.concept) GROUP BY ALL),
    k AS (SELECT *, count_if(n <= 1) OVER (PARTITION BY qid) < 0.3 * count(*) OVER (PARTITION BY qid) AS all_stay FROM n)
    SELECT qid, tier, doc_id, round(score - 0.1::DOUBLE * n, 4) AS score, n AS n_conflicts FROM k WHERE n <= 1 OR all_stay""")
def tiered_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each question by its tier: as they are on the fast one; on the others a tenth less for each concept in the
    document that conflicts with the question, and without documents that hold more than one, unless too few would stay.

    Concepts conflict that keep apart over the corpus, where the question speaks of one of the two.
    """
    tiers = registry.QUERIES["processing_tier_similar"](spark, sf_dir)
    pairs = registry.QUERIES["mutual_exclusion"](spark, sf_dir).filter("exclusion > 0.1").select("a", "b")
    q = _all_questions(spark, sf_dir).select("qid", F.lower("query").alias("low"))
    words = pairs.select(F.array("a", "b").alias("p"), F.explode(F.array("a", "b")).alias("term"))
    spoken = lexicon.hits(q, words.select("term"), "qid", "low").join(words, "term")
    conflicts = spoken.select("qid", F.explode("p").alias("concept")).distinct().groupBy("qid").agg(F.collect_set("concept").alias("concepts"))
    hits = question_search(spark, sf_dir).join(tiers, "qid")
    own = hits.join(_concepts_held(load(spark, sf_dir, "documents")), "doc_id").join(conflicts, "qid", "left")
    n = F.when(F.col("tier") == "fast", 0).otherwise(F.size(F.array_intersect(F.coalesce("concepts", F.array().cast("array<string>")), "held")))
    w = Window.partitionBy("qid")  # ten rows at most
    own = own.withColumn("n", n.cast("long"))
    own = own.withColumn("all_stay", F.sum((F.col("n") <= 1).cast("int")).over(w) < 0.3 * F.count("*").over(w))
    return own.filter("n <= 1 or all_stay").select("qid", "tier", "doc_id", F.round(F.col("score") - 0.1 * F.col("n"), 4).alias("score"), F.col("n").alias("n_conflicts"))
