"""Search, merge, filter and question scoring over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import n_words, sentences, tokens
from ..operators import lexicon, scoring, search, vectors
from ..sources.tables import QUESTIONS, literal, load, values
from . import registry
from .registry import query
from .tagging import _ALL, _all_questions

TERMS = ["the", "license", "der"]
_Q = values(QUESTIONS, "qid, query")

_BM25 = """
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS dl, len([x FOR x IN w IF x = 'the']) AS a, len([x FOR x IN w IF x = 'license']) AS b,
                 len([x FOR x IN w IF x = 'der']) AS d FROM t),
    s AS (SELECT count(*) AS n, avg(dl) AS l, count_if(a > 0) AS fa, count_if(b > 0) AS fb, count_if(d > 0) AS fd FROM c),
    r AS (SELECT doc_id, CAST((a > 0)::INT + (b > 0)::INT + (d > 0)::INT AS BIGINT) AS n_terms, round(
            ln(1 + (n - fa + 0.5::DOUBLE) / (fa + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / l))
          + ln(1 + (n - fb + 0.5::DOUBLE) / (fb + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / l))
          + ln(1 + (n - fd + 0.5::DOUBLE) / (fd + 0.5::DOUBLE)) * d * 2.2::DOUBLE / (d + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / l)), 4) AS score
          FROM c, s WHERE a + b + d > 0)"""


@query(_BM25 + " SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.bm25(load(spark, sf_dir, "documents"), TERMS), 10, "doc_id")


@query(_BM25 + " SELECT * FROM r WHERE n_terms = 3 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.bm25(load(spark, sf_dir, "documents"), TERMS, every=True), 10, "doc_id")


@query("""
    WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS p FROM documents)
    SELECT doc_id, CAST(len(string_split(p, ' of the ')) - 1 AS BIGINT) AS n_hits FROM t WHERE contains(p, ' of the ')""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    hits = load(spark, sf_dir, "documents").select("doc_id", p.alias("p")).filter(F.contains("p", F.lit(" of the ")))
    return hits.select("doc_id", (F.size(F.split("p", " of the ")) - 1).cast("long").alias("n_hits"))


@query("""
    WITH s AS (SELECT doc_id, unnest([trim(x) FOR x IN regexp_split_to_array(text, '[.!?]+')]) AS s,
                      unnest(range(1, len(regexp_split_to_array(text, '[.!?]+')) + 1)) AS pos FROM documents),
    m AS (SELECT doc_id, term, s, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) AS nth
          FROM s, (VALUES ('license'), ('reserve')) t(term) WHERE length(s) > 10 AND contains(lower(s), term))
    SELECT doc_id, term, CAST(nth AS BIGINT) AS nth, left(s, 200) AS sentence FROM m WHERE nth <= 3""")
def substring_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three sentences a document and term."""
    parts = F.transform(F.split("text", "[.!?]+"), lambda x: F.trim(x))
    s = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("pos", "s")).filter(F.length("s") > 10)
    s = s.withColumn("term", F.explode(F.array(F.lit("license"), F.lit("reserve")))).filter(F.contains(F.lower("s"), F.col("term")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "term").orderBy("pos")).cast("long")
    return s.withColumn("nth", nth).filter("nth <= 3").select("doc_id", "term", "nth", F.substring("s", 1, 200).alias("sentence"))


_SIM = """
    WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    s AS (SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return search.similarity(v, v.filter("vec_id = 0")).select("vec_id", "label", "score")


@query(_SIM + " SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_similar(spark, sf_dir), 10, "vec_id")


@query(_SIM + " SELECT * FROM s WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    own = search.similarity(v.filter(F.col("label").isin(1, 3)), v.filter("vec_id = 0"))
    return search.top(own.select("vec_id", "label", "score"), 10, "vec_id")


@query(_SIM + ", t AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 50) SELECT * FROM t WHERE label IN (1, 3)")
def vector_topk_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_similar(spark, sf_dir), 50, "vec_id").filter(F.col("label").isin(1, 3))


@query(_SIM + " SELECT * FROM s WHERE score >= 0.3")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).filter("score >= 0.3")


_LISTS = _BM25 + """, k AS (SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 100),
    q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
    v AS (SELECT vec_id AS doc_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score
          FROM embeddings, q ORDER BY score DESC, doc_id LIMIT 100)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = search.top(_similar(spark, sf_dir), 100, "vec_id").select(F.col("vec_id").alias("doc_id"), "score")
    return v, search.top(search.bm25(load(spark, sf_dir, "documents"), TERMS), 100, "doc_id").select("doc_id", "score")


@query(_LISTS + """
    SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, greatest(v.score, k.score) AS score,
           CASE WHEN v.doc_id IS NULL THEN 'keyword' WHEN k.doc_id IS NULL THEN 'vector' ELSE 'hybrid' END AS search_type
    FROM v FULL JOIN k ON v.doc_id = k.doc_id""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_merge(*_lists(spark, sf_dir), "doc_id")


@query(_LISTS + """
    SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, round(0.6::DOUBLE * coalesce(v.score / (SELECT max(score) FROM v), 0)
           + 0.4::DOUBLE * coalesce(k.score / (SELECT max(score) FROM k), 0), 4) AS score
    FROM v FULL JOIN k ON v.doc_id = k.doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(search.hybrid_weighted(*_lists(spark, sf_dir), "doc_id"), 20, "doc_id")


#: Each row whose id is divisible by 100 asks for its like among all rows.
_SIM_ALL = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
    s AS (SELECT query_id, vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE embedding IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)"""


def _asking(v: DataFrame) -> DataFrame:
    return v.filter("vec_id % 100 = 0")


def _nearest_all(spark: SparkSession, sf_dir: str, k: int, labels: tuple[int, ...] = ()) -> DataFrame:
    """The best ``k`` for every query, by matrix products in the tasks."""
    v = load(spark, sf_dir, "embeddings")
    own = v.filter(F.col("label").isin(*labels)) if labels else v
    return vectors.nearest(own, _asking(v), k).select("query_id", "vec_id", "label", "score")


@query(_SIM_ALL + " SELECT query_id, vec_id, label, score FROM n WHERE rn <= 10")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every query."""
    return _nearest_all(spark, sf_dir, 10)


@query(_SIM_ALL + ", f AS (SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE label IN (1, 3)) SELECT query_id, vec_id, label, score FROM f WHERE rn <= 10")
def vector_topk_filtered_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_all(spark, sf_dir, 10, (1, 3))


@query(_SIM_ALL + " SELECT query_id, vec_id, label, score FROM n WHERE rn <= 50 AND label IN (1, 3)")
def vector_topk_postfilter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_all(spark, sf_dir, 50).filter(F.col("label").isin(1, 3))


@query(_SIM_ALL + " SELECT * FROM s WHERE score >= 0.3")
def vector_threshold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    return vectors.above(v, _asking(v), 0.3).select("query_id", "vec_id", "label", "score")


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_topk_all`` through a partitioned index that is built first: every row is in it, recall is set to 0.97.

    Which rows an approximate search finds has no SQL; a test measures its recall against ``vector_topk_all``.
    """
    v = load(spark, sf_dir, "embeddings")
    return vectors.probe(vectors.index(v, k=10), _asking(v), 10).select("query_id", "vec_id", "label", "score")


_LISTS_ALL = _BM25 + ", " + _SIM_ALL.strip().removeprefix("WITH ") + """, ids AS (SELECT query_id FROM q),
    k AS (SELECT query_id, doc_id, score FROM ids, (SELECT doc_id, score FROM r ORDER BY score DESC, doc_id LIMIT 100) AS x),
    v AS (SELECT query_id, vec_id AS doc_id, score FROM n WHERE rn <= 100)"""
# the row of totals in _BM25 is also called s
_LISTS_ALL = _LISTS_ALL.replace("    s AS (SELECT query_id", "    sim AS (SELECT query_id").replace("AS rn FROM s)", "AS rn FROM sim)")


def _lists_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Hit lists (query_id, doc_id, score) by vector and by keyword; the keywords are the same for every query."""
    v = _nearest_all(spark, sf_dir, 100).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    ids = load(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"))
    k = search.top(search.bm25(load(spark, sf_dir, "documents"), TERMS), 100, "doc_id").select("doc_id", "score")
    return v, ids.crossJoin(F.broadcast(k)).select("query_id", "doc_id", "score")


@query(_LISTS_ALL + """
    SELECT query_id, doc_id, greatest(v.score, k.score) AS score,
           CASE WHEN v.score IS NULL THEN 'keyword' WHEN k.score IS NULL THEN 'vector' ELSE 'hybrid' END AS search_type
    FROM v FULL JOIN k USING (query_id, doc_id)""")
def hybrid_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists of every query, merged."""
    v, k = (x.select("query_id", "doc_id", F.col("score").alias(n)) for x, n in zip(_lists_all(spark, sf_dir), ("v", "k")))
    kind = F.when(F.col("v").isNull(), "keyword").when(F.col("k").isNull(), "vector").otherwise("hybrid")
    return v.join(k, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.greatest("v", "k").alias("score"), kind.alias("search_type"))


@query(_LISTS_ALL + """, vm AS (SELECT query_id, max(score) AS most FROM v GROUP BY query_id), km AS (SELECT query_id, max(score) AS most FROM k GROUP BY query_id),
    w AS (SELECT query_id, doc_id, round(0.6::DOUBLE * coalesce(v.score / vm.most, 0) + 0.4::DOUBLE * coalesce(k.score / km.most, 0), 4) AS score
          FROM v FULL JOIN k USING (query_id, doc_id) LEFT JOIN vm USING (query_id) LEFT JOIN km USING (query_id))
    SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rn FROM w) WHERE rn <= 20""")
def hybrid_weighted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists of every query, normalised by their maxima and added with weights: the best twenty."""
    most = F.max("score").over(Window.partitionBy("query_id"))  # at most 100 rows
    v, k = (x.withColumn("most", most).select("query_id", "doc_id", (F.col("score") / F.col("most")).alias(n)) for x, n in zip(_lists_all(spark, sf_dir), ("v", "k")))
    total = 0.6 * F.coalesce("v", F.lit(0.0)) + 0.4 * F.coalesce("k", F.lit(0.0))
    both = v.join(k, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.round(total, 4).alias("score"))
    return search.top_each(both, 20, "query_id", "doc_id")


@query("SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')")
def payload_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.filter(search.payload_filter(dict(d.dtypes), {"lang": ["en", "de"], "source": ["src1", "src2", "src3"]}))


@query("SELECT doc_id, source, lang FROM documents WHERE coalesce(lang = 'fr', false) AND NOT coalesce(source IN ('src1', 'src2'), false)")
def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.filter(search.payload_filter(dict(d.dtypes), {"lang": "fr", "source_excluded": ["src1", "src2"]}))


@query("""
    SELECT doc_id, CASE lang WHEN 'en' THEN 'us_gaap' WHEN 'fr' THEN 'ifrs' WHEN 'de' THEN 'actuarial' ELSE 'company' END AS doc_type
    FROM documents""")
def source_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a source's kind turned into document types, with a default."""
    kinds = F.create_map(*[F.lit(x) for p in {"en": "us_gaap", "fr": "ifrs", "de": "actuarial"}.items() for x in p])
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(kinds, F.col("lang")), F.lit("company")).alias("doc_type"))


@query(_BM25 + """
    , f AS (SELECT r.doc_id, r.score, length(text) >= 200 AND NOT contains(lower(text), 'license') AND r.score >= 2 AS ok,
                   row_number() OVER (ORDER BY r.score DESC, r.doc_id) AS rn
            FROM (SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 20) r JOIN documents d ON d.doc_id = r.doc_id)
    SELECT doc_id, score FROM f WHERE ok OR (NOT (SELECT bool_or(ok) FROM f) AND rn <= 5)""")
def relevance_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best 20 those that pass; if none passes, the best five."""
    d = load(spark, sf_dir, "documents")
    best = search.top(search.bm25(d, TERMS), 20, "doc_id").select("doc_id", "score")
    own = d.join(F.broadcast(best), "doc_id")
    ok = (F.length("text") >= 200) & ~F.contains(F.lower("text"), F.lit("license")) & (F.col("score") >= 2)
    rows = own.select("doc_id", "score", ok.alias("ok"))
    every = Window.partitionBy(F.lit(0))  # at most 20 rows
    rows = rows.withColumns({"some": F.max("ok").over(every), "rn": F.row_number().over(every.orderBy(F.desc("score"), "doc_id"))})
    return rows.filter("ok or (not some and rn <= 5)").select("doc_id", "score")


@query("""
    SELECT doc_id, CAST(n AS BIGINT) AS n_issues, issues FROM (
      SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN text IS NULL OR text = '' THEN 'missing text' END,
             CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown language' END,
             CASE WHEN n_chars > 10000 THEN 'too long' END] IF x IS NOT NULL], '; ') AS issues,
             len([x FOR x IN [text IS NULL OR text = '', lang NOT IN ('en', 'de', 'fr'), n_chars > 10000] IF x]) AS n FROM documents)""")
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import labels_where

    own = labels_where({"missing text": F.col("text").isNull() | (F.col("text") == ""), "unknown language": ~F.col("lang").isin("en", "de", "fr"), "too long": F.col("n_chars") > 10000})
    return load(spark, sf_dir, "documents").select("doc_id", F.size(own).cast("long").alias("n_issues"), F.array_join(own, "; ").alias("issues"))


_ENT = """
    WITH q AS (SELECT qid, query, list_sort(list_distinct(regexp_extract_all(query, '[0-9]+(?:[.-][0-9]+)+')
        || regexp_extract_all(query, '"([^"]+)"', 1) || regexp_extract_all(query, '\\b[A-Z]{2,6}\\b'))) AS ents,
        len(regexp_extract_all(query, '\\S+')) AS w, lower(query) AS low FROM """ + _Q + """),
    a AS (SELECT *, CASE
        WHEN contains(low, 'that document') OR contains(low, 'this document') OR contains(low, 'the document') OR contains(low, 'it say') OR contains(low, 'above') OR contains(low, 'previous') THEN 'contextual'
        WHEN len([e FOR e IN ents IF regexp_matches(e, '[0-9]+(?:[.-][0-9]+)+')]) > 0 THEN 'specific_reference'
        WHEN contains(low, 'difference') OR contains(low, 'compare') OR contains(low, 'versus') OR contains(low, 'vs') OR contains(low, 'between') OR contains(low, 'contrast') THEN 'comparison'
        WHEN contains(low, 'how to') OR contains(low, 'steps') OR contains(low, 'process') OR contains(low, 'procedure') OR contains(low, 'calculate') OR contains(low, 'determine') THEN 'procedural'
        ELSE 'conceptual' END AS query_type,
        (least(w / 10.0::DOUBLE, 1) + least(len(ents) / 3.0::DOUBLE, 1) + CASE WHEN regexp_matches(query, '[0-9]') THEN 0.5 ELSE 0 END
         + CASE WHEN contains(query, '"') THEN 0.3 ELSE 0 END) / 4 AS spec FROM q)"""


def _query_weights(questions: DataFrame) -> DataFrame:
    """Entities, type, specificity and search weights of questions."""
    q = F.col("query")
    rows = questions.select("qid", scoring.entities(q).alias("e"), scoring.query_type(q).alias("query_type"), scoring.specificity(q).alias("s"))
    w = scoring.weights(F.col("query_type"), F.col("s"))
    names = ("w_exact", "w_semantic", "w_context", "w_coverage")
    return rows.select("qid", F.array_join("e", "|").alias("entities"), "query_type", F.round("s", 6).alias("specificity"), *[F.round(c, 6).alias(n) for c, n in zip(w, names)])


@query(_ENT + """, b AS (SELECT *, CASE query_type WHEN 'specific_reference' THEN 0.6 WHEN 'contextual' THEN 0.3 ELSE 0.2 END::DOUBLE AS e,
        CASE query_type WHEN 'specific_reference' THEN 0.2 WHEN 'contextual' THEN 0.4 ELSE 0.6 END::DOUBLE AS s,
        CASE query_type WHEN 'contextual' THEN 0.2 ELSE 0.1 END::DOUBLE AS c FROM a),
    m AS (SELECT *, CASE WHEN spec > 0.7 THEN least(0.8::DOUBLE, e + 0.2::DOUBLE) WHEN spec < 0.3 THEN greatest(0.1::DOUBLE, e - 0.1::DOUBLE) ELSE e END AS e2,
        CASE WHEN spec > 0.7 THEN greatest(0.1::DOUBLE, s - 0.1::DOUBLE) WHEN spec < 0.3 THEN least(0.7::DOUBLE, s + 0.2::DOUBLE) ELSE s END AS s2 FROM b)
    SELECT qid, array_to_string(ents, '|') AS entities, query_type, round(CAST(spec AS DOUBLE), 6) AS specificity, round(e2 / (e2 + s2 + c + 0.1::DOUBLE), 6) AS w_exact,
        round(s2 / (e2 + s2 + c + 0.1::DOUBLE), 6) AS w_semantic, round(c / (e2 + s2 + c + 0.1::DOUBLE), 6) AS w_context, round(0.1::DOUBLE / (e2 + s2 + c + 0.1::DOUBLE), 6) AS w_coverage FROM m""")
def query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, type, specificity and search weights of questions."""
    return _query_weights(literal(spark, QUESTIONS, "qid int, query string"))


def _words_bound(sql: str) -> str:
    """RE2's word boundary is ASCII: capitals are looked for between signs that are no letters of any script."""
    out = sql.replace("regexp_extract_all(query, '\\b[A-Z]{2,6}\\b')", "regexp_extract_all(regexp_replace(query, '[^\\p{L}\\p{M}\\p{N}_]+', '  ', 'g'), '(?:^| )([A-Z]{2,6})(?: |$)', 1)")
    assert out != sql
    return out


@query(_words_bound(registry.ORACLE["query_weights"]).replace(_Q, _ALL))
def query_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_weights`` over all benchmark items and user turns."""
    return _query_weights(_all_questions(spark, sf_dir))


@query("""
    WITH t AS (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)
    SELECT item_id, CASE WHEN len(w) > 20 THEN 15 WHEN len(w) > 10 THEN 10 ELSE 8 END::BIGINT AS doc_limit,
           round(greatest(0.5::DOUBLE, least(0.9::DOUBLE, 0.7::DOUBLE + CASE WHEN len(w) > 15 THEN -0.05::DOUBLE
               WHEN len([x FOR x IN w IF length(x) > 6]) > 3 THEN 0.05::DOUBLE ELSE 0 END)), 6) AS threshold FROM t""")
def query_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a question may take, and from which similarity."""
    q = F.col("text")
    return load(spark, sf_dir, "benchmark").select("item_id", scoring.document_limit(q).alias("doc_limit"), F.round(scoring.similarity_threshold(q), 6).alias("threshold"))


@query(_ENT + """
    , x AS (SELECT qid, doc_id, ents, lower(text) AS body, len([e FOR e IN ents IF contains(lower(text), lower(e))]) AS h FROM a, documents WHERE len(ents) > 0),
    s AS (SELECT qid, doc_id, least(1, list_sum([CASE WHEN length(e) > 10 THEN 0.3 WHEN regexp_matches(e, '[0-9]+(?:[.-][0-9]+)+') THEN 0.25 ELSE 0.15 END::DOUBLE
              FOR e IN ents IF contains(body, lower(e))]) * h / len(ents)) AS exact, h / len(ents) AS cov FROM x WHERE h > 0),
    r AS (SELECT qid, doc_id, round(exact, 6) AS exact_match, round(cov, 6) AS entity_coverage,
              row_number() OVER (PARTITION BY qid ORDER BY round(exact, 6) DESC, round(cov, 6) DESC, doc_id) AS rn FROM s)
    SELECT qid, doc_id, exact_match, entity_coverage FROM r WHERE rn <= 10""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question (a short literal table) the ten documents that hold its entities best."""
    q = literal(spark, QUESTIONS, "qid int, query string").select("qid", scoring.entities(F.col("query")).alias("e")).filter(F.size("e") > 0)
    own = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body"))
    pairs = own.join(F.broadcast(q), F.exists("e", lambda x: F.contains("body", F.lower(x))))
    scored = pairs.select("qid", "doc_id", F.round(scoring.exact_match(F.col("e"), F.col("body")), 6).alias("exact_match"), F.round(scoring.coverage(F.col("e"), F.col("body")), 6).alias("entity_coverage"))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("exact_match"), F.desc("entity_coverage"), "doc_id"))
    return scored.withColumn("rn", rn).filter("rn <= 10").drop("rn")


@query(_words_bound(registry.ORACLE["relevance_rank"]).replace(_Q, "(SELECT item_id, text FROM benchmark) AS t(qid, query)"))
def relevance_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``relevance_rank`` for all benchmark items: every text is read once for the entities of all of them."""
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), scoring.entities(F.col("text")).alias("e")).filter(F.size("e") > 0)
    terms = q.select("qid", "e", F.explode("e").alias("x")).select("qid", "e", "x", F.lower("x").alias("term"))
    found = lexicon.hits(load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("body")), terms.select("term"), "doc_id", "body")
    own = found.join(terms, "term").groupBy("qid", "doc_id").agg(F.first("e").alias("e"), F.collect_list("x").alias("hit"))
    score, share = scoring.exact_points(F.col("e"), F.col("hit")), F.size("hit") / F.size("e")
    scored = own.select("qid", "doc_id", F.round(score, 6).alias("exact_match"), F.round(share, 6).alias("entity_coverage"))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("exact_match"), F.desc("entity_coverage"), "doc_id"))
    return scored.withColumn("rn", rn).filter("rn <= 10").drop("rn")


@query("""
    WITH d AS (SELECT conv_id, count(*) FILTER (WHERE role <> 'assistant') AS n FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, c.turn, round(CASE WHEN n = 0 OR length(text) = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, least(0.8::DOUBLE, n / 5) * 0.6::DOUBLE
        + least(1.0::DOUBLE, len(regexp_extract_all(text, '\\S+')) / 100) * 0.2::DOUBLE + least(1.0::DOUBLE, n / 10) * 0.2::DOUBLE)) END, 6) AS confidence
    FROM conversations c JOIN d USING (conv_id) WHERE role = 'assistant'""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg(F.count_if(F.col("role") != "assistant").alias("n"))
    own = c.filter("role = 'assistant'").join(n, "conv_id")
    return own.select("conv_id", "turn", F.round(scoring.confidence(F.col("n"), F.col("text")), 6).alias("confidence"))


@query("""
    SELECT c_custkey, c_name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS code FROM customer
    WHERE contains(lower(c_name), '0011') OR contains(lower(c_mktsegment), '0011') ORDER BY c_custkey LIMIT 10""")
def company_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains(F.lower("c_name"), F.lit("0011")) | F.contains(F.lower("c_mktsegment"), F.lit("0011"))
    return load(spark, sf_dir, "customer").filter(hit).select("c_custkey", "c_name", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("code")).orderBy("c_custkey").limit(10)


@query("""
    WITH t AS (SELECT doc_id, unnest(list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9_]{4,}') IF TRUE])) AS term FROM documents),
    q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{4,}'))) AS term FROM benchmark),
    n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
    h AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN t USING (term) GROUP BY item_id, doc_id),
    r AS (SELECT item_id, doc_id, hits, round(hits / n, 6) AS share, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rn FROM h JOIN n USING (item_id))
    SELECT item_id, doc_id, hits, share FROM r WHERE rn <= 5""")
def term_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question the five documents that share most terms with it."""
    from ..functions.text import terms

    q = load(spark, sf_dir, "benchmark").select("item_id", terms(F.col("text")).alias("t"))
    d = load(spark, sf_dir, "documents").select("doc_id", terms(F.col("text")).alias("t"))
    best = search.overlap_top(d, q, 5)
    return best.select("item_id", "doc_id", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("share"))
