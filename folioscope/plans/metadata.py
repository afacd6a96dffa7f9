"""Domains, frameworks, insights and profiles of documents; people they name, checked and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.text import any_of
from ..operators import metadata as meta
from ..sources.tables import literal, load, values
from .registry import query

#: Documents that hold what the rules look for, beside those of the tables, where little of it occurs.
PAPERS = [
    (-1, "RGA guide", "IFRS 17 and US GAAP compared.\n1. Scope of the standard\nThe reserve of $1,250.00 and 12.5% from 01/31/2024 to March 5, 2025; in 2024 and 2025."),
    (-2, "licat capital", "The valuation manual of 2023 sets statutory reserves.\nACTUARIAL ASSUMPTIONS\nMortality and lapse; see [Page 1] and [Page 2] on 2024-06-30."),
    (-3, "pwc fx", "A contract on foreign currency at the exchange rate of 1 May 2024 for $3 million, vs the present value."),
    (-4, None, "Ann Miller, Chief Financial Officer, and Bob R. Stone approve it. Ann Miller signs. Cara Lane - Controller."),
    (-5, "notes", ""),
]
_PAPERS = f"(SELECT doc_id, source, text FROM {values(PAPERS, 'doc_id, source, text')} UNION ALL SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL) AS d"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text): the literal documents and all of the table that have a text."""
    own = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", "text")
    return literal(spark, PAPERS, "doc_id long, source string, text string").unionByName(own)


def _case(c: str, lexicon: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql.any_of(c, p)} THEN '{n}'" for n, p in lexicon.items()) + f" ELSE '{otherwise}' END"


_FW = sql.labels_where({n: sql.any_of("lower(text)", p) for n, p in meta.FRAMEWORKS.items()})


@query(f"""
    WITH v AS (SELECT *, {_FW} AS f, lower(coalesce(source, '')) AS s, lower(text) AS t FROM {_PAPERS})
    SELECT doc_id, {_case('t', meta.CONTENT, 'general')} AS domain, array_to_string(f, ',') AS frameworks,
           CASE WHEN len(f) > 1 OR {sql.any_of('t', meta.COMPARING)} THEN 'comparison' WHEN len(f) = 1 THEN f[1] ELSE 'unknown' END AS primary_framework,
           CASE WHEN contains(s, 'manual') OR contains(s, 'guide') THEN 'manual' WHEN contains(t, 'comparison') OR contains(t, 'compare') THEN 'comparison_guide'
                WHEN contains(t, 'regulation') OR contains(t, 'statutory') THEN 'regulation' ELSE 'other' END AS document_type,
           CASE WHEN list_contains(f, 'usstat') OR list_contains(f, 'gaap') THEN 'us' END AS jurisdiction,
           array_to_string(f || regexp_extract_all(text, '20[0-9][0-9]'), ',') AS tags FROM v""")
def metadata_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, frameworks, document type, jurisdiction and tags by words of texts and source names."""
    low, f = F.lower("text"), F.col("f")
    own = papers(spark, sf_dir).withColumn("f", meta.frameworks(F.col("text")))
    first = F.when((F.size(f) > 1) | any_of(low, meta.COMPARING), "comparison").when(F.size(f) == 1, F.get(f, F.lit(0))).otherwise("unknown")
    return own.select(
        "doc_id", meta.first_of(low, meta.CONTENT).alias("domain"), F.array_join(f, ",").alias("frameworks"), first.alias("primary_framework"), meta.document_type(F.col("source"), F.col("text")).alias("document_type"),
        F.when(F.arrays_overlap(f, F.array(F.lit("usstat"), F.lit("gaap"))), "us").alias("jurisdiction"), F.array_join(F.concat(f, F.regexp_extract_all("text", F.lit("20[0-9][0-9]"), F.lit(0))), ",").alias("tags"),
    )


def _domain_sql() -> str:
    out = []
    for n, (by_source, by_text) in meta.DOMAINS.items():
        hit = sql.any_of("lower(coalesce(source, ''))", by_source) + (" OR " + sql.any_of("lower(text)", by_text) if by_text else "")
        out.append(f"WHEN {hit} THEN '{n}'")
    return "CASE " + " ".join(out) + " ELSE 'general' END"


_SERVES = sql.labels_where({n: "domain IN (" + ", ".join(f"'{x}'" for x in p) + ")" for n, p in meta.COMPATIBLE.items()})


@query(f"SELECT doc_id, domain, {sql.joined(_SERVES)} AS serves FROM (SELECT doc_id, {_domain_sql()} AS domain FROM {_PAPERS})")
def domain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each document, and the domains of questions that it may serve."""
    own = papers(spark, sf_dir).select("doc_id", meta.domain(F.col("source"), F.col("text")).alias("domain"))
    serves = F.array_compact(F.array(*[F.when(F.col("domain").isin(*p), F.lit(n)) for n, p in meta.COMPATIBLE.items()]))
    return own.withColumn("serves", F.array_join(serves, ","))


def _first(pattern: str, most: int, c: str = "text") -> str:
    found = f"regexp_extract_all({c}, {sql.quoted(pattern)})"
    return f"({sql.first_seen(found)})[1:{most}]"


@query(f"""
    SELECT doc_id, {sql.joined(sql.labels_where({s: f"contains(upper(text), '{s}')" for s in meta.STANDARDS}))} AS standards, array_to_string(regexp_extract_all(text, {sql.quoted(meta.DATES)})[1:5], '|') AS dates,
           {sql.joined(sql.labels_where({t: f"contains(lower(text), '{t}')" for t in meta.INSIGHT_TERMS}))} AS terms FROM {_PAPERS}""")
def key_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards, the first five dates and key terms of each document."""
    t = F.col("text")
    has = lambda c, parts: F.array_join(F.array_compact(F.array(*[F.when(F.contains(c, F.lit(p)), F.lit(p)) for p in parts])), ",")
    dates = F.slice(F.regexp_extract_all(t, F.lit(meta.DATES), F.lit(0)), 1, 5)
    return papers(spark, sf_dir).select("doc_id", has(F.upper(t), meta.STANDARDS).alias("standards"), F.array_join(dates, "|").alias("dates"), has(F.lower(t), meta.INSIGHT_TERMS).alias("terms"))


_CATS = ", ".join(f"len({sql.labels_where({t: f'contains(lower(text), {sql.quoted(t)})' for t in ts})})" for ts in meta.CATEGORIES.values())
_HEADS = f"([trim(x, ' ') FOR x IN string_split(text, chr(10))[1:50] IF length(trim(x, ' ')) > 5 AND length(trim(x, ' ')) < 80 AND regexp_matches(trim(x, ' '), {sql.quoted(meta.HEADING)})])[1:8]"


@query(f"""
    WITH v AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_words, length(text) AS n_chars, CASE WHEN contains(text, '[Page ') THEN len(string_split(text, '[Page ')) ELSE 1 END AS n_pages,
        [{_CATS}] AS cats, {_first(meta.DATES, 8)} AS dates, {_first(meta.FIGURES, 10)} AS figures, {_HEADS} AS heads FROM {_PAPERS})
    SELECT doc_id, n_words, n_chars, n_pages, array_to_string(cats, '/') AS categories, array_to_string(dates, '|') AS dates, array_to_string(figures, '|') AS figures, array_to_string(heads, '|') AS headings,
           CASE WHEN n_words > 5000 THEN 'substantial' WHEN n_words > 1000 THEN 'moderate' ELSE 'basic' END || '/' || CASE WHEN len([x FOR x IN cats IF x > 0]) > 2 THEN 'multiple' ELSE 'specific' END
           || '/' || CASE WHEN n_pages > 20 THEN 'complex' ELSE 'standard' END || '/' || CASE WHEN n_words > 10000 THEN 'detailed' ELSE 'standard' END AS bands FROM v""")
def document_profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, signs, pages, terms by category, dates, figures, headings and bands of each document."""
    t, low = F.col("text"), F.lower("text")
    cats = [sum((F.contains(low, F.lit(x)).cast("int") for x in ts), F.lit(0)) for ts in meta.CATEGORIES.values()]
    pages = F.when(F.contains(t, F.lit("[Page ")), F.size(F.split(t, r"\[Page "))).otherwise(1).cast("long")
    v = papers(spark, sf_dir).select(
        "doc_id", meta.n_words(t).alias("n_words"), F.length(t).cast("long").alias("n_chars"), pages.alias("n_pages"), F.array(*cats).alias("cats"),
        meta.distinct_first(t, meta.DATES, 8).alias("d"), meta.distinct_first(t, meta.FIGURES, 10).alias("f"), meta.headings(t).alias("h"),
    )
    some = F.size(F.filter("cats", lambda x: x > 0))
    join = lambda c: F.array_join(c, "|")
    return v.select("doc_id", "n_words", "n_chars", "n_pages", F.array_join(F.transform("cats", lambda x: x.cast("string")), "/").alias("categories"), join("d").alias("dates"), join("f").alias("figures"), join("h").alias("headings"), meta.bands(F.col("n_words"), F.col("n_pages"), some).alias("bands"))


@query(f"SELECT doc_id, len(n) AS n_names, array_to_string(n[1:10], '|') AS names FROM (SELECT doc_id, {sql.first_seen(f'regexp_extract_all(text, {sql.quoted(meta.NAME)})')} AS n FROM {_PAPERS}) WHERE len(n) > 0")
def general_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two words, with or without an initial: how many, and the first ten."""
    n = F.array_distinct(F.regexp_extract_all("text", F.lit(meta.NAME), F.lit(0)))
    own = papers(spark, sf_dir).select("doc_id", n.alias("n")).filter(F.size("n") > 0)
    return own.select("doc_id", F.size("n").cast("long").alias("n_names"), F.array_join(F.slice("n", 1, 10), "|").alias("names"))


#: People as an extractor returns them: document, name, title, department, authority, confidence.
PEOPLE = [
    (-4, "Ann Miller", "Chief Financial Officer", "Finance", None, 0.9), (-4, "  Cara Lane ", "Controller", "Finance", "$5,000", 1.7), (-4, "Bob R. Stone", "n/a", None, None, -0.2),
    (-4, "Dan Absent", "Director", "Operations", None, 0.8), (-4, "", "Manager", None, None, 0.5), (-4, None, None, None, None, 0.5), (-4, "Ann Miller", "Operations Engineer", "IT", None, 0.6),
    (-1, "Scope", "General Counsel", "Legal", None, 0.4),
]
_PEOPLE = values(PEOPLE, "doc_id, name, title, department, authority, confidence")
_PERSON = "doc_id long, name string, title string, department string, authority string, confidence double"
#: The same from the documents themselves.
_BARE = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_BY_FORM = " UNION ALL ".join(f"SELECT doc_id, {_BARE('n')} AS name, {_BARE('t')} AS title, 0.6::DOUBLE AS confidence FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS n, unnest(regexp_extract_all(text, '{p}', 2)) AS t FROM {_PAPERS})" for p in meta.NAME_AND_TITLE)
_BY_TITLE = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p.format(title=t)}', 1)) AS name, '{t}' AS title, 0.7::DOUBLE AS confidence FROM {_PAPERS}" for t in meta.FINANCE for p in meta.BESIDE)
_FOUND = f"""(SELECT doc_id, name, title, NULL::VARCHAR AS department, NULL::VARCHAR AS authority, confidence FROM (SELECT * FROM ({_BY_FORM}) WHERE regexp_matches(name, '\\S\\s+\\S') AND length(title) > 2 UNION ALL {_BY_TITLE})) AS t"""
_CHECKED = f"""
    e AS (SELECT doc_id, trim(name, ' ') AS name, CASE WHEN lower(trim(title, ' ')) NOT IN ('not specified', 'none', 'n/a', '') THEN trim(title, ' ') END AS title, department, authority,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence)) AS confidence FROM {_PEOPLE} WHERE trim(name, ' ') <> ''),
    k AS (SELECT e.*, lower(d.text) AS low, lower(title) AS t FROM e JOIN {_PAPERS} ON d.doc_id = e.doc_id),
    v AS (SELECT doc_id, name, title, department, authority, confidence FROM k WHERE contains(low, lower(name)) AND (title IS NULL OR contains(low, t)
        OR contains(low, replace(t, ' ', '')) OR (trim(replace(t, 'chief', ''), ' ') <> '' AND contains(low, trim(replace(t, 'chief', ''), ' '))) OR (trim(replace(t, 'officer', ''), ' ') <> '' AND contains(low, trim(replace(t, 'officer', ''), ' ')))))"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People whose name and title occur in their document, with tidy titles and confidences from 0 to 1."""
    own = F.broadcast(literal(spark, PEOPLE, _PERSON))  # a short literal table
    return _tidy(papers(spark, sf_dir), own)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_checked`` for the people that the forms of names and titles find in the documents themselves."""
    d = papers(spark, sf_dir)
    each = d.select("doc_id", F.explode(meta.people(F.col("text"))).alias("p"))
    return _tidy(d, each.select("doc_id", "p.name", "p.title", F.lit(None).cast("string").alias("department"), F.lit(None).cast("string").alias("authority"), "p.confidence"))


def _tidy(docs: DataFrame, people: DataFrame) -> DataFrame:
    own = people.filter(F.trim("name") != "")
    own = own.select("doc_id", F.trim("name").alias("name"), meta.clean_title(F.col("title")).alias("title"), "department", "authority", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")).alias("confidence"))
    both = docs.select("doc_id", "text").join(own, "doc_id")
    return both.filter(meta.in_content(F.col("name"), F.col("title"), F.col("text"))).drop("text")


@query(f"WITH {_CHECKED} SELECT * FROM v")
def entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


@query(f"""
    WITH {_CHECKED} SELECT doc_id, count(*) AS n_entities, count(title) AS n_titles, count(department) AS n_departments, count(DISTINCT department) AS n_distinct, count(authority) AS n_authority,
        round(avg(confidence), 4) AS confidence FROM v GROUP BY doc_id""")
def entity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(_checked(spark, sf_dir))


def _statistics(checked: DataFrame) -> DataFrame:
    own = checked.groupBy("doc_id")
    return own.agg(F.count("*").alias("n_entities"), F.count("title").alias("n_titles"), F.count("department").alias("n_departments"), F.countDistinct("department").alias("n_distinct"), F.count("authority").alias("n_authority"), F.round(F.avg("confidence"), 4).alias("confidence"))


_FIELDS = sql.labels_where({n: sql.any_of("lower(title)", p) for n, p in meta.TITLES.items()})


@query(f"""
    WITH {_CHECKED}, f AS (SELECT doc_id, unnest({_FIELDS}) AS field FROM v),
    g AS (SELECT doc_id, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM f GROUP BY doc_id)
    SELECT DISTINCT v.doc_id, coalesce(fields, 'general') AS fields FROM v LEFT JOIN g USING (doc_id)""")
def entity_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of work that the titles in a document speak of."""
    return _fields_of_work(_checked(spark, sf_dir))


def _fields_of_work(checked: DataFrame) -> DataFrame:
    own = checked.select("doc_id", F.explode_outer(meta.work_fields(F.col("title"))).alias("field"))
    fields = F.array_join(F.array_sort(F.collect_set("field")), ",")  # five names at most
    return own.groupBy("doc_id").agg(F.when(fields == "", "general").otherwise(fields).alias("fields"))


@query(f"""
    WITH {_CHECKED}, c AS (SELECT doc_id, avg(CASE WHEN confidence > 0 THEN confidence END) AS a, count(*) AS n FROM v GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN a IS NULL THEN 0.3 ELSE least(1.0::DOUBLE, a + least(n * 0.1::DOUBLE, 0.3::DOUBLE) + least({sql.count_of('lower(text)', ('officer', 'controller', 'approve'))} * 0.1::DOUBLE, 0.2::DOUBLE)) END::DOUBLE, 3) AS confidence
    FROM c JOIN {_PAPERS} USING (doc_id)""")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of confidences above 0, more for many people and for patterns that occur."""
    return _confidence(papers(spark, sf_dir), _checked(spark, sf_dir))


def _confidence(docs: DataFrame, checked: DataFrame) -> DataFrame:
    own = checked.groupBy("doc_id").agg(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("a"), F.count("*").alias("n"))
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(p)).cast("int") for p in ("officer", "controller", "approve")), F.lit(0))
    both = docs.select("doc_id", "text").join(own, "doc_id")
    value = F.least(F.lit(1.0), F.col("a") + F.least(F.col("n") * 0.1, F.lit(0.3)) + F.least(hits * 0.1, F.lit(0.2)))
    return both.select("doc_id", F.round(F.when(F.col("a").isNull(), 0.3).otherwise(value), 3).alias("confidence"))


_BAD = {"Missing document_id": "doc_id IS NULL", "Missing source_document": "source IS NULL OR source = ''", "Missing fingerprint": "text IS NULL OR text = ''", "Invalid extraction_confidence": "n_chars < 0 OR n_chars > 100000"}


@query(f"SELECT doc_id, {sql.joined(sql.labels_where(_BAD), '; ')} AS issues FROM (SELECT doc_id, source, text, n_chars FROM documents UNION ALL VALUES (NULL, '', NULL, -1), (-9, 's', 'x', 1))")
def metadata_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metadata of a document lacks."""
    own = load(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars").unionByName(literal(spark, [(None, "", None, -1), (-9, "s", "x", 1)], "doc_id long, source string, text string, n_chars long"))
    issues = F.array_compact(F.array(*[F.when(F.expr(v), F.lit(k)) for k, v in _BAD.items()]))
    return own.select("doc_id", F.array_join(issues, "; ").alias("issues"))


def _of_documents(name: str) -> str:
    """The SQL of a query about people, with those found in the documents in place of the literal ones."""
    from . import registry

    out = registry.ORACLE[name].replace(_PEOPLE, _FOUND)
    assert out != registry.ORACLE[name]
    return out


@query(_of_documents("entity_checks"))
def entity_checks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People that documents name with a title, checked."""
    return _found(spark, sf_dir)


@query(_of_documents("entity_statistics"))
def entity_statistics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(_found(spark, sf_dir))


@query(_of_documents("entity_domains"))
def entity_domains_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields_of_work(_found(spark, sf_dir))


@query(_of_documents("extraction_confidence"))
def extraction_confidence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(papers(spark, sf_dir), _found(spark, sf_dir))
